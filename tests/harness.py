"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return ("n", round(v, 6) + 0.0)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(_cell(r[i]) for i in order)) for r in rows))


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def compare(spark, folder: str, name: str, query, sql: str | None) -> tuple[str, float, int]:
    """("ok" or what differs, seconds on Spark, rows)."""
    start = time.time()
    df = query(spark, folder)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return ("rows-only" if rows else "EMPTY"), seconds, len(rows)
    con = duck(folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", seconds, len(rows)
    a, b = _rows(df.columns, rows), _rows(names, want)
    if a == b:
        return ("ok" if a else "EMPTY"), seconds, len(rows)
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
    only_a, only_b = [x[:300] for x in only_a], [x[:300] for x in only_b]
    return (f"DIFF spark={len(a)} sql={len(b)} differing={len(sa - sb)}\n   spark {only_a}\n   sql   {only_b}",
            seconds, len(rows))


def main(argv):
    from featforge.plans import catalog
    from featforge.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, q in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            verdict, seconds, n = compare(spark, folder, name, q, catalog.ORACLES.get(name))
        except Exception as e:  # show every failing query, not only the first
            verdict, seconds, n = f"ERROR {type(e).__name__} {str(e)[:1500]}", 0.0, 0
        if verdict not in ("ok", "rows-only"):
            bad += 1
        print(f"{name:40s} {seconds:6.2f}s {n:7d} {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
