import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.operators import trees


def number(use, seed, tree, node, feature):
    return int(hashlib.md5(f"{use}:{seed}:{tree}:{node}:{feature}".encode()).hexdigest()[:8], 16) / 2**32


def twin(rows, n_features, classes, tree, depth, tries, min_rows, seed):
    """The same tree grown row by row in plain Python: nested (feature, cut, left, right) or class counts."""
    low = [min(x[j] for x, _ in rows) for j in range(n_features)]
    high = [max(x[j] for x, _ in rows) for j in range(n_features)]

    def impurity(part):
        n = len(part)
        return n - sum(sum(y == c for _, y in part) ** 2 for c in classes) / n if n else 0.0

    def node(part, at, level, low, high):
        counts = [sum(y == c for _, y in part) for c in classes]
        if level == depth or len(part) < min_rows or max(counts) == len(part):
            return counts
        best = None
        for j in sorted(range(n_features), key=lambda j: (number("feature", seed, tree, at, j), j))[:tries]:
            cut = low[j] + number("cut", seed, tree, at, j) * (high[j] - low[j])
            left, right = [r for r in part if r[0][j] <= cut], [r for r in part if r[0][j] > cut]
            if left and right and (best is None or impurity(left) + impurity(right) < best[0]):
                best = impurity(left) + impurity(right), j, cut, left, right
        if best is None:
            return counts
        _, j, cut, left, right = best
        return (j, cut, node(left, at * 2, level + 1, low, [*high[:j], cut, *high[j + 1:]]),
                node(right, at * 2 + 1, level + 1, [*low[:j], cut, *low[j + 1:]], high))
    return node(rows, 1, 0, low, high)


def unfolded(tree, at=0):
    if tree.feature[at] < 0:
        return tree.counts[at].tolist()
    return (int(tree.feature[at]), float(tree.cut[at]), unfolded(tree, tree.left[at]), unfolded(tree, tree.left[at] + 1))


def table(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.gauss(0, 1), rng.uniform(0, 5), float(rng.randrange(3)), 1.0]
        rows.append((x, "b" if x[0] + 0.4 * x[2] + rng.gauss(0, 0.3) > 0.5 else "a" if x[1] > 1 else "c"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, y) for x, y in rows], "f0 double, f1 double, f2 double, f3 double, y string").repartition(4)


@pytest.mark.parametrize("pass_nodes", [4096, 3])
def test_trees_equal_a_plain_twin(spark, monkeypatch, pass_nodes):
    monkeypatch.setattr(trees, "PASS_NODES", pass_nodes)
    rows = table()
    got = trees.fit(frame(spark, rows), ["f0", "f1", "f2", "f3"], "y", trees=4, depth=5, tries=2, min_rows=5, seed=9)
    assert got.labels == ["a", "b", "c"]
    for t in range(4):
        assert unfolded(got.trees[t]) == twin(rows, 4, got.labels, t, 5, 2, 5, 9)


def test_predictions_beat_the_largest_class(spark):
    rows = table(600)
    model = trees.fit(frame(spark, rows[:400]), ["f0", "f1", "f2", "f3"], "y", trees=20, depth=8)
    out = trees.predict(model, frame(spark, rows[400:])).select("y", "prediction", "confidence").toPandas()
    share = (out["y"] == out["prediction"]).mean()
    largest = max(sum(y == c for _, y in rows[400:]) for c in "abc") / 200
    assert 1 - share < 0.5 * (1 - largest) and out["confidence"].between(1 / 3, 1).all()


def test_gaps_one_class_and_no_rows(spark):
    rows = [([1.0, float("nan"), 0.0, 0.0], "a"), ([None, 2.0, 0.0, 0.0], "b"), ([3.0, None, 0.0, 0.0], "a"), ([4.0, 1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame([(*x, y) for x, y in rows], "f0 double, f1 double, f2 double, f3 double, y string")
    model = trees.fit(df, ["f0", "f1"], "y", trees=3, depth=3, min_rows=2)
    assert model.fill == [2.0, 2.0]
    assert {r["prediction"] for r in trees.predict(model, df).collect()} <= {"a", "b"}
    one = trees.fit(df.filter("y = 'a'"), ["f0", "f1"], "y", trees=2)
    assert [r["confidence"] for r in trees.predict(one, df).collect()] == [1.0] * 4
    assert trees.fit(df.filter("false"), ["f0"], "y").labels == []


def test_counts_sum_up_on_every_level(spark):
    rows = table(200)
    model = trees.fit(frame(spark, rows).withColumn("y", F.col("y")), ["f0", "f1", "f2", "f3"], "y", trees=3, depth=6)
    for tree in model.trees:
        for at in np.flatnonzero(tree.feature >= 0):
            assert (tree.counts[at] == tree.counts[tree.left[at]] + tree.counts[tree.left[at] + 1]).all()
