"""Extremely randomised trees (Geurts et al., 2006), grown level by level over the rows of a table.

Every open node draws a few features and one cut for each by hash, so that a tree is a function of the data and the
seed. One pass over the rows counts classes on both sides of all cuts of all trees; the driver sees those counts, whose
number the size of a pass bounds, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Open nodes whose cuts are counted in one pass over the rows.
PASS_NODES = 4096


class Tree(NamedTuple):
    """Nodes as arrays: feature (-1: leaf), cut, left child (the right one follows it), rows of every class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray


class ExtraTrees(NamedTuple):
    features: list[str]
    labels: list[str]
    fill: list[float]
    trees: list[Tree]


def draw(seed: int, tree: int, node: int, feature: int, use: str) -> float:
    """A number in [0, 1) from the md5 of its arguments, which any SQL engine can repeat."""
    return int(hashlib.md5(f"{use}:{seed}:{tree}:{node}:{feature}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _route(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype="int64")
    while (going := np.flatnonzero(tree.feature[at] >= 0)).size:
        here = at[going]
        at[going] = tree.left[here] + (x[going, tree.feature[here]] > tree.cut[here])
    return at


def _gini(counts: np.ndarray) -> np.ndarray:
    """Rows times impurity, for class counts in the last axis."""
    n = counts.sum(axis=-1)
    return n - np.divide((counts.astype("float64") ** 2).sum(axis=-1), n, out=np.zeros(n.shape), where=n > 0)


def feature_vector(features: Sequence[str], fill: Sequence[float]) -> Column:
    """Array of the features; NULL and NaN take the fill value."""
    return F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(float(m))) for f, m in zip(features, fill)])


class _Open(NamedTuple):
    tree: int
    at: int  # place in the arrays of the tree
    number: int  # heap number: 1 is the root, 2n and 2n + 1 the children of n
    low: np.ndarray
    high: np.ndarray


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int = 30, depth: int = 10, tries: int | None = None,
        min_rows: int = 4, seed: int = 42) -> ExtraTrees:
    """Grow ``trees`` trees on all rows with a label.

    A node with fewer than ``min_rows`` rows, of one class, or at ``depth`` is a leaf. Others draw ``tries`` features
    (default: the root of their number) and for each a cut, even between the bounds that the cuts above leave of the
    feature's range; the cut with the lowest Gini impurity splits, of equal ones the first drawn; none that leaves a
    side empty. Missing values take the feature's mean. Labels are compared as text; their number must be small.
    """
    features, f = list(features), len(features)
    tries = min(f, tries or max(1, round(f ** 0.5)))
    known = df.filter(F.col(label).isNotNull())
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features}
    bounds = known.agg(*[g(clean[c]).alias(f"{n}_{i}") for i, c in enumerate(features) for n, g in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
    fill = [0.0 if bounds[f"m_{i}"] is None else bounds[f"m_{i}"] for i in range(f)]
    low, high = (np.array([fill[i] if bounds[f"{n}_{i}"] is None else bounds[f"{n}_{i}"] for i in range(f)]) for n in "ab")
    labels = sorted(r[0] for r in known.select(F.col(label).cast("string")).distinct().collect())
    classes = F.array(*[F.lit(x) for x in labels])
    rows = stored(known.select((F.array_position(classes, F.col(label).cast("string")) - 1).cast("int").alias("y"),
                               feature_vector(features, fill).alias("x")), "features")
    grown = [{"feature": [-1], "cut": [0.0], "left": [-1], "counts": [np.zeros(len(labels), dtype="int64")]} for _ in range(trees)]
    level = [_Open(t, 0, 1, low, high) for t in range(trees)] if labels else []
    for _ in range(depth):
        following = []
        for i in range(0, len(level), PASS_NODES):
            following += _grow(rows, grown, level[i:i + PASS_NODES], tries, len(labels), min_rows, seed)
        level = following
        if not level:
            break
    if labels and depth == 0:
        n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        for g in grown:
            g["counts"][0] = np.array([n.get(c, 0) for c in range(len(labels))])
    return ExtraTrees(features, labels, fill, [_frozen(g) for g in grown])


def _frozen(g: dict) -> Tree:
    return Tree(np.array(g["feature"]), np.array(g["cut"]), np.array(g["left"]), np.array(g["counts"]))


def _grow(rows: DataFrame, grown: list[dict], level: list[_Open], tries: int, classes: int, min_rows: int, seed: int) -> list[_Open]:
    """Split some open nodes by one pass over the rows; their children that may split again."""
    drawn = np.empty((len(level), tries), dtype="int64")
    cuts = np.empty((len(level), tries))
    for s, node in enumerate(level):
        order = sorted(range(len(node.low)), key=lambda j: (draw(seed, node.tree, node.number, j, "feature"), j))
        drawn[s] = order[:tries]
        for k, j in enumerate(order[:tries]):
            cuts[s, k] = node.low[j] + draw(seed, node.tree, node.number, j, "cut") * (node.high[j] - node.low[j])
    slots = {}
    for s, node in enumerate(level):
        slots.setdefault(node.tree, np.full(len(grown[node.tree]["feature"]), -1))[node.at] = s
    shared = rows.sparkSession.sparkContext.broadcast(({t: _frozen(grown[t]) for t in slots}, slots, drawn, cuts))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, slots, drawn, cuts = shared.value
        total = np.zeros(drawn.size * 2 * classes, dtype="int64")
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(y), -1)
            for t, tree in trees.items():
                slot = slots[t][_route(tree, x)]
                here = np.flatnonzero(slot >= 0)
                slot = slot[here]
                for k in range(drawn.shape[1]):
                    side = x[here, drawn[slot, k]] > cuts[slot, k]
                    total += np.bincount(((slot * drawn.shape[1] + k) * 2 + side) * classes + y[here], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["i", "n"])

    counts = np.zeros(drawn.size * 2 * classes, dtype="int64")
    for r in rows.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r["i"]] = r["n"]
    shared.unpersist()
    counts = counts.reshape(len(level), tries, 2, classes)
    impurity = _gini(counts).sum(axis=2)
    impurity[(counts.sum(axis=3) == 0).any(axis=2)] = np.inf
    following = []
    for s, node in enumerate(level):
        g = grown[node.tree]
        whole = counts[s, 0].sum(axis=0)
        g["counts"][node.at] = whole
        k = int(impurity[s].argmin())
        if whole.sum() < min_rows or whole.max() == whole.sum() or not np.isfinite(impurity[s, k]):
            continue
        j, cut, left = int(drawn[s, k]), float(cuts[s, k]), len(g["feature"])
        g["feature"][node.at], g["cut"][node.at], g["left"][node.at] = j, cut, left
        for side in (0, 1):
            own = counts[s, k, side]
            g["feature"].append(-1)
            g["cut"].append(0.0)
            g["left"].append(-1)
            g["counts"].append(own)
            if own.sum() >= min_rows and own.max() < own.sum():
                low, high = node.low.copy(), node.high.copy()
                (high if side == 0 else low)[j] = cut
                following.append(_Open(node.tree, left + side, node.number * 2 + side, low, high))
    return following


def probabilities(forest: ExtraTrees, x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the class shares in the leaf of each row."""
    total = np.zeros((len(x), len(forest.labels)))
    for tree in forest.trees:
        counts = tree.counts[_route(tree, x)]
        total += counts / counts.sum(axis=1, keepdims=True)
    return total / max(1, len(forest.trees))


def predict(forest: ExtraTrees, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Predicted class (as text) and ``confidence``; needs no label column. Ties go to the first class."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("struct<at: int, confidence: double>")
    def vote(x: pd.Series) -> pd.DataFrame:
        p = probabilities(shared.value, np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(shared.value.features))))
        return pd.DataFrame({"at": p.argmax(axis=1) + 1, "confidence": p.max(axis=1)})

    names = F.array(*[F.lit(x) for x in forest.labels])
    voted = df.withColumn("_vote", vote(feature_vector(forest.features, forest.fill)))
    return (voted.withColumn(out, F.element_at(names, F.col("_vote.at"))).withColumn("confidence", F.col("_vote.confidence")).drop("_vote"))
