import random
from collections import defaultdict

from pyspark.sql import functions as F

from featforge.llm import exact, mixing


def brute_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    return groups


def test_exact_groups_against_brute_force(docs_of):
    rng = random.Random(3)
    long = "same start " * 40
    texts = ["", None, "a", "b", long + "x", long + "y", "ünï", "ab" * 100, "é" * 70000]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000, "alone"), (None, "a"), (None, "zz"), (5000, "twin"), (5000, "twin")]
    groups = brute_groups(rows)
    got = exact.mark_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_key = defaultdict(list)
    for r in got:
        by_key[r["doc_id"]].append(r)
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        for key in keys:
            r = next(x for x in by_key[key] if x["group_size"] == len(keys) and x["keep_id"] == keep)
            assert r["kept"] == (key == keep)
    assert len({r["text_sha256"] for r in got}) == len(groups)
    assert [r["repeated"] for r in by_key[5000]] == [True, True]


def test_exact_drop_keeps_columns_and_one_row_per_text(docs_of, clashing):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "twin"), (6, "twin"), (None, "c")]
    docs = clashing(docs_of(rows))
    out = exact.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1, 2, 4, 5, 6]


def test_exact_beyond_the_small_table(docs_of, monkeypatch):
    rows = [(i, f"text {i % 50}") for i in range(200)]
    want = sorted(map(tuple, exact.mark_duplicates(docs_of(rows)).collect()))
    monkeypatch.setattr(exact, "SMALL_TABLE", 3)
    assert sorted(map(tuple, exact.mark_duplicates(docs_of(rows)).collect())) == want
    assert exact.drop_duplicates(docs_of(rows)).count() == 50


def test_exact_empty_table(docs_of):
    assert exact.mark_duplicates(docs_of([])).count() == 0
    assert exact.drop_duplicates(docs_of([])).count() == 0


def reshared(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    left, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if weights[i] * level > most * sizes[i]}
        if not above:
            for i in open_:
                targets[i] = weights[i] * level
            break
        for i in above:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ -= above
    return targets


def test_targets_against_resharing(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 30):
        sizes = [rng.choice([0, 1, 10, 1000, 50000]) for _ in range(n)]
        names = sorted(f"s{i}" for i in range(n - 1)) + [None]
        got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
        want = reshared(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5, 2.0)
        found = {r["source"]: r["target"] for r in got}
        for name, w in zip(names, want):
            assert abs(found[name] - w) < 1e-6 * max(1.0, w)


def test_mix_meets_targets_and_repeats(docs_of, clashing):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(9001, None, "en", "e"), (9002, "", "en", "e"), (9003, "  \n", "en", "zero")]
    docs = clashing(docs_of(rows))
    got = mixing.allot(docs)
    assert got.count() == len(rows)
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"),
                                     F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect()
    for r in sums:
        assert r["size"] == r["source_size"]
        assert abs(r["taken"] - r["target"]) <= 2
    assert got.filter("taken > 2 * size").count() == 0
    again = mixing.allot(docs.repartition(7))
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    want = {r["doc_id"]: r["copies"] for r in got.collect() if r["copies"]}
    assert {r["doc_id"]: r["copies"] for r in mixed.collect()} == want


def test_weights_change_inclusion(docs_of):
    rows = [(i, "a b c d", "en", s) for i in range(2000) for s in ("x",)] + [(i, "a b", "en", "y") for i in range(2000, 2100)]
    docs = docs_of(rows).withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = mixing.allot(docs, share=0.5, weight="weight").filter("source = 'x'")
    even, odd = (got.filter(f"doc_id % 2 = {i}").agg(F.sum("copies")).first()[0] for i in (0, 1))
    total = got.agg(F.sum("taken"), F.first("target")).first()
    assert even > 2 * odd > 0
    assert abs(total[0] - total[1]) <= 4


def test_mix_repeated_rows_and_empty(docs_of):
    docs = docs_of([(1, "a b c", "en", "s")] * 5 + [(None, "d e", "en", "s")])
    got = mixing.allot(docs).collect()
    assert len(got) == 6 and len({r["copies"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.allot(docs_of([])).count() == 0
    assert mixing.mix(docs_of([])).count() == 0
