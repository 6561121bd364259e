import random
from collections import Counter

import pytest

from featforge.llm import common, near


def brute(rows, size, percent=80):
    """Set sizes and smallest reachable keys, by comparing all pairs."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i:i + size]) for i in range(len(w) - size + 1)])
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where = {}
    for k in sorted(sets):
        shared = Counter(o for s in sets[k] for o in where.get(s, ()))
        for o, n in shared.items():
            if 100 * n >= percent * len(sets[k] | sets[o]):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
        for s in sets[k]:
            where.setdefault(s, []).append(k)
    return {k: (len(sets[k]), root(k)) for k in sets}


def corpus(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        text = rng.choices(vocabulary, k=rng.choice([1, 2, 6, 30, 120, 300]))
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(text)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.04, 0.06]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
    chain = rng.choices(vocabulary, k=200)  # each is close to the next only
    for _ in range(15):
        rows.append((k, " ".join(chain)))
        k += 1
        for _ in range(8):
            chain[rng.randrange(200)] = rng.choice(vocabulary)
    return rows + [(k, None), (k + 1, ""), (k + 2, "one"), (k + 3, "ONE "), (k + 4, " \n")]


@pytest.mark.parametrize("size", [2, 5])
def test_groups_against_all_pairs(docs_of, size):
    rows = corpus()
    want = brute(rows, size)
    got = {r["k"]: (r["n_shingles"], r["component_id"]) for r in near.near_groups(docs_of(rows), size=size).collect()}
    assert got == want
    kept = {r["doc_id"] for r in near.drop_near_duplicates(docs_of(rows), size=size).collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c}


def test_second_pass_finds_what_leaders_miss(spark, docs_of, monkeypatch):
    """All texts in one bucket under one leader that is linked with none: every link is left to the second pass."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near, "PART_ROWS", 8)
    rows = [r for r in corpus(9) if r[1] and len(r[1].split()) > 100]
    docs = docs_of(rows)
    signed = near.signatures(docs, "doc_id", "text", 2).dropDuplicates(["node"])
    classes = signed.withColumn("bands", F.concat(F.array(F.lit(5).cast("long")), F.array_repeat(F.col("k") + 100, near.BANDS - 1)))
    members = classes.select("node", F.lit(5).cast("long").alias("bucket"), F.lit(b"none").alias("leader"))
    nothing = spark.createDataFrame([], "id binary, component binary")
    links = near._second_pass(members, nothing, docs, "doc_id", "text", 2, classes, 80).collect()
    key_of = {bytes(r["node"]): r["k"] for r in classes.select("node", "k").collect()}
    assert len(links) < len(key_of) * 8
    parent = {k: k for k in key_of.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in links:
        a, b = sorted((root(key_of[bytes(r["a"])]), root(key_of[bytes(r["b"])])))
        parent[b] = a
    want = brute([(k, t) for k, t in rows if k in parent], 2)
    assert {k: root(k) for k in parent} == {k: c for k, (_, c) in want.items()}


def test_repeated_rows_null_keys_and_clashing_names(docs_of, clashing):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text), (7, text), (9, text + " more"), (None, text), (3, "other words here now then")]
    docs = clashing(docs_of(rows))
    out = near.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 7]
    assert {r["component_id"] for r in near.near_groups(docs).collect()} == {3, 7}


def test_empty_table(docs_of):
    assert near.near_groups(docs_of([])).count() == 0
    assert near.drop_near_duplicates(docs_of([])).count() == 0


def test_beyond_the_small_table(docs_of, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(near, "SMALL_TABLE", 2)
    want = brute(rows, 5)
    kept = {r["doc_id"] for r in near.drop_near_duplicates(docs_of(rows)).collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c}


def test_odd_sketches_estimate_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.8, 0.9, 0.95):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            n = int(2000 * share)
            rest = rng.integers(0, 1 << 63, 2000 - n).astype(np.uint64)
            a, b = np.unique(both), np.unique(np.concatenate([both[:n], rest]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sketch = near.odd_sketches(np.stack([near.min_hashes(a), near.min_hashes(b)])).view(np.uint64)
            z = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            flips = -near.SKETCH_BITS / 2 * np.log(1 - 2 * z / near.SKETCH_BITS)
            errors.append(abs(1 - flips / (2 * near.BANDS * near.ROWS) - true))
    assert max(errors) < 0.16 and sum(errors) / len(errors) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 150), (150, 200)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 150, 150: 150}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
