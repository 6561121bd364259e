import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from featforge.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The one node that remains, and for every first node its siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            paths[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        nodes = [h("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def plain(rows):
    """{(key, leaf): [(path, subroot)]} and the root, for (doc_id, text, lang, source, n_chars) rows."""
    groups = defaultdict(list)
    for k, text, lang, source, n in rows:
        groups[lang].append(((k is not None, k or 0), leaf_of((k, source, lang, n, text)), k))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: r[:2])
        subs[lang] = climb([r[1] for r in groups[lang]])
    root, tops = climb([subs[x][0] for x in langs])
    found = defaultdict(list)
    for lang, top in zip(langs, tops):
        for (_, leaf, k), path in zip(groups[lang], subs[lang][1]):
            found[(k, leaf)].append((path + top, subs[lang][0]))
    return found, root


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k, rng.choice([None, "", "Für A", "b" * 30_000, f"Text {k}"]), lang, rng.choice(["s", None, ""]), None))
            k += rng.choice([1, 1, 7])
    rng.shuffle(rows)
    return rows


SIZES = [
    {"en": 1}, {None: 1, "en": 1}, {"en": 8, "de": 9}, {"en": 65, None: 64, "": 2, "é": 1, "z": 7},
    {f"l{i:02d}": i % 4 + 1 for i in range(20)}, {"hot": 600, "x": 3},
]


@pytest.mark.parametrize("sizes", SIZES)
def test_trees_against_plain_python(docs_of, clashing, sizes):
    rows = rows_of(sizes)
    want, root = plain(rows)
    got = manifest.manifest(clashing(docs_of([r[:4] for r in rows]))).collect()
    assert len(got) == len(rows) and {r["root"] for r in got} == {root}
    seen = defaultdict(list)
    for r in got:
        seen[(r["k"], r["leaf"])].append(([(s["left"], s["right"]) for s in r["path"]], r["subroot"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_repeated_rows_and_null_keys(docs_of):
    rows = [(1, "a", "en", "s", None)] * 20 + [(None, "a", "en", "s", None)] * 3 + [(1, "A", "en", "s", None), (None, None, None, None, None)]
    want, root = plain(rows)
    got = manifest.manifest(docs_of([r[:4] for r in rows])).collect()
    assert {r["root"] for r in got} == {root}
    assert sorted(r["subroot"] for r in got) == sorted(s for v in want.values() for _, s in v)


def test_proofs_hold_and_changes_show(docs_of):
    rows = rows_of({"en": 70, "fr": 5})
    columns = [F.col(c) for c in FIELDS[:-1]]
    changed = F.when(F.col("doc_id") % 3 == 0, manifest.digest([*columns, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))]))
    got = manifest.manifest(docs_of([r[:4] for r in rows]), claimed=changed).select(
        "k", "root", manifest.folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded"),
        manifest.proof_digest(F.col("path")).alias("proof"), "path").collect()
    for r in got:
        assert (r["folded"] == r["root"]) == (r["k"] % 3 != 0)
        assert r["proof"] == h("".join(s["left"] + s["right"] for s in r["path"]))


def test_lone_leaf_is_the_root_and_empty_table_has_none(docs_of):
    only = manifest.manifest(docs_of([(5, "x")])).collect()
    assert [(r["leaf"], r["path"]) for r in only] == [(only[0]["root"], [])]
    assert manifest.manifest(docs_of([(5, "x")]).filter("false")).collect() == []


def test_any_change_of_the_table_changes_the_root(docs_of):
    rows = [r[:4] for r in rows_of({"en": 30, "de": 12})]
    root = lambda x: manifest.manifest(docs_of(x)).first()["root"]
    first = root(rows)
    assert first == root(rows[::-1])
    assert first != root(rows[1:])
    assert first != root([(rows[0][0], "other", *rows[0][2:]), *rows[1:]])
    assert first != root([*rows, rows[0]])
