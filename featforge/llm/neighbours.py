"""Nearest neighbours by inner product: random-projection trees, one priority queue over all of them, exact reranking.

The forest is small and travels; the vectors do not. Each tree deals the vectors to its leaves, runs of leaves are
shelves of bounded bytes, and a query goes once to every shelf on which the queue has named leaves.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import spread_join

#: Trees; vectors they are fitted on (those of smallest digest, a uniform choice); sample vectors in a leaf at most.
TREES, SAMPLE_ROWS, LEAF_ROWS = 4, 8192, 32
#: Recall the stop of the search is set for, and how many sample vectors ask to set it.
RECALL, ASKED = 0.96, 256
#: Bytes of vectors on a shelf, scores computed at a time.
SHELF_BYTES, BLOCK_SCORES = 4 << 20, 1 << 21
#: Relative rounding error that no inner product of the first pass exceeds; what lies within it is reranked too.
SLACK = 1e-11

_CELL = "shelf int, kind int, leaf int, q binary, vec binary, numbers array<long>"


class Tree(NamedTuple):
    """Inner nodes as arrays: ``child`` holds node numbers, or leaf numbers as their complement."""

    normal: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaves: int


class Forest(NamedTuple):
    trees: list[Tree]
    length: float  # of the longest vector
    share: float  # of the table, the rows of a leaf counted for each tree, after which a search stops

    @property
    def first_leaf(self) -> np.ndarray:
        return np.cumsum([0, *[t.leaves for t in self.trees]])


def lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """Vectors divided by the greatest length, with one more component that gives all of them length 1.

    With 0 there for a query, the nearest points are those of largest inner product.
    """
    x = vectors / length
    with np.errstate(invalid="ignore"):
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.nan_to_num(np.column_stack([x, rest]))


def asking(vectors: np.ndarray) -> np.ndarray:
    """Query vectors of length 1, with the added component 0."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.column_stack([x, np.zeros(len(x))])


def grow(points: np.ndarray, rng: np.random.Generator, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree whose nodes cut at the median of the projection on the line through two of their points."""
    normals, cuts, children = [], [], []
    leaves = 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        split = None
        for _ in range(8 if len(rows) > leaf_rows else 0):
            a, b = points[rng.choice(rows, 2, replace=False)]
            norm = np.sqrt(((a - b) ** 2).sum())
            if norm == 0:
                continue
            along = points[rows] @ ((a - b) / norm)
            cut = np.median(along)
            if cut >= along.max():
                cut = along[along < along.max()].max(initial=cut)
            if (along > cut).any() and (along <= cut).any():
                split = (a - b) / norm, cut, along > cut
                break
        if split is None:
            leaves += 1
            return ~(leaves - 1)
        at = len(cuts)
        normals.append(split[0])
        cuts.append(split[1])
        children.append(None)
        children[at] = [node(rows[~split[2]]), node(rows[split[2]])]
        return at

    node(np.arange(len(points)))
    width = points.shape[1]
    return Tree(np.array(normals).reshape(-1, width), np.array(cuts), np.array(children, dtype="int64").reshape(-1, 2), leaves)


def route(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of every point."""
    at = np.zeros(len(points), dtype="int64") if len(tree.cut) else np.full(len(points), ~0)
    while (going := np.flatnonzero(at >= 0)).size:
        here = at[going]
        above = (points[going] * tree.normal[here]).sum(axis=1) > tree.cut[here]
        at[going] = tree.child[here, above.astype(int)]
    return ~at


def visits(forest: Forest, points: np.ndarray) -> Iterator[Iterator[int]]:
    """For every query the leaves of all trees (numbered through), nearest first.

    One queue holds nodes of all trees under the squared distance to the cuts that were crossed to reach them.
    """
    first, nodes = forest.first_leaf, np.cumsum([0, *[len(t.cut) for t in forest.trees]])
    margins = np.concatenate([points @ t.normal.T - t.cut for t in forest.trees], axis=1)
    child = []
    for t, tree in enumerate(forest.trees):
        child += [[int(c) + int(nodes[t]) if c >= 0 else int(c) - int(first[t]) for c in pair] for pair in tree.child]
    roots = [int(nodes[t]) if len(tree.cut) else ~int(first[t]) for t, tree in enumerate(forest.trees)]

    def walk(margin: list[float]) -> Iterator[int]:
        queue = [(0.0, r) for r in roots]
        heapq.heapify(queue)
        while queue:
            cost, at = heapq.heappop(queue)
            while at >= 0:
                m = margin[at]
                low, high = child[at]
                heapq.heappush(queue, (cost + m * m, low if m > 0 else high))
                at = high if m > 0 else low
            yield ~at

    for row in margins:
        yield walk(row.tolist())


def fit(sample: np.ndarray, length: float, k: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL,
        seed: int = 42) -> Forest:
    """A forest on a sample, and the share of the rows a search must see for the wanted recall.

    The share comes from exact neighbours inside the sample. In the full table neighbours are nearer than there, so
    they are met earlier.
    """
    rng = np.random.default_rng(seed)
    points = lifted(sample, length)
    forest = Forest([grow(points, rng, leaf_rows) for _ in range(trees)], length, 1.0)
    n = len(sample)
    if n <= k + 1:
        return forest._replace(share=float(trees))
    probes = rng.permutation(n)[:ASKED]
    leaf = np.array([route(t, points) + f for t, f in zip(forest.trees, forest.first_leaf)])
    rows = np.bincount(leaf.ravel(), minlength=forest.first_leaf[-1])
    queries = asking(sample[probes])
    scores = queries[:, :-1] @ points[:, :-1].T
    scores[np.arange(len(probes)), probes] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    needed = []
    for i, leaves in enumerate(visits(forest, queries)):
        order = np.fromiter(leaves, dtype="int64")
        seen = np.empty(len(rows))
        seen[order] = np.cumsum(rows[order])
        needed.append(seen[leaf[:, best[i]]].min(axis=0) / n)
    return forest._replace(share=float(np.quantile(np.concatenate(needed), recall, method="higher")))


def _packed(df: DataFrame, key: str, vector: str, asks: Column) -> tuple[DataFrame, str]:
    """Rows (id, asks, vkey, vec, width, length) of the vectors that take part, and the type of their bytes.

    ``vec`` holds the components as little-endian bytes (float stays float, other types become double), ``vkey``
    its 16-byte BLAKE2 digest, which stands for the vector.
    """
    single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    names = ["id", "asks", "vkey", "vec", "width", "length"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # a NULL component becomes NaN
            start = lists.offsets.to_numpy()
            width = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(start), 0)
            found = []
            for w in np.unique(width[width > 0]):
                rows = np.flatnonzero(width == w)
                m = values[start[rows][:, None] + np.arange(w)] + 0.0
                good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                for i, v in zip(rows[good], m[good]):
                    big = np.abs(v).max().astype("float64")
                    with np.errstate(over="ignore"):
                        length = big * np.sqrt(((v / big) ** 2).sum(dtype="float64"))
                    data = v.tobytes()
                    found.append((i, hashlib.blake2b(data, digest_size=16).digest(), data, int(w), float(length)))
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([f[1] for f in found], pa.binary()),
                 pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.int32()),
                 pa.array([f[4] for f in found], pa.float64())], names)

    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"),
                     F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    return rows.filter("id IS NOT NULL AND v IS NOT NULL").mapInArrow(
        pack, "id long, asks boolean, vkey binary, vec binary, width int, length double"), kind


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1).astype("float64")


def _best(queries: np.ndarray, wanted: list[list[int]], rows: np.ndarray, start: dict[int, slice], keep: int,
          longest: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) for the ``keep`` best rows of each query among the leaves it asks for, ties included."""
    step = max(1, BLOCK_SCORES // len(rows))
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        asked: dict[int, list[int]] = {}
        for i, leaves in enumerate(wanted[at:at + step]):
            for leaf in leaves:
                asked.setdefault(leaf, []).append(i)
        scores = np.full((len(q), len(rows)), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            for leaf, who in asked.items():
                if leaf in start:
                    scores[who, start[leaf]] = q[who] @ rows[start[leaf]].T
            scores[np.isnan(scores)] = -np.inf
            least = np.partition(scores, len(rows) - min(keep, len(rows)), axis=1)[:, len(rows) - min(keep, len(rows))]
            least = least - np.nan_to_num(SLACK * longest * np.sqrt((q * q).sum(axis=1)))
            who, which = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            for i in range(0, len(who), 1 << 16):
                a, b = who[i:i + (1 << 16)], which[i:i + (1 << 16)]
                yield a + at, b, (q[a] * rows[b]).sum(axis=1)


def nearest(df: DataFrame, key: str, vector: str, asks: Column, k: int = 20, trees: int = TREES, sample_rows: int = SAMPLE_ROWS,
            leaf_rows: int = LEAF_ROWS, recall: float = RECALL, shelf_bytes: int = SHELF_BYTES) -> DataFrame:
    """The ``k`` rows of largest inner product found for every row where ``asks`` holds: (query_id, rank, vec_id, score).

    ``key`` is an integer. A row is not its own neighbour. Nearest first, ties to the smaller id; fewer than ``k`` only
    if there are no more candidates. Scores are inner products in double precision, summed in one order, so reruns and
    copies agree. Vectors that are NULL or zero, that hold NULL or a value that is not finite, of another length than
    the longest, or without an id take no part. Equal vectors are searched for and compared once; of their ids the
    ``k + 1`` smallest can be among the nearest. Repeated rows count once. An id with several vectors asks with each
    and is as near as the nearest. Other columns, whatever their names, are not read. An empty table gives no rows.

    The forest is fitted on at most ``sample_rows`` vectors, every vector is indexed. A search follows one queue over
    all trees until it has seen the share of rows that reaches ``recall`` on the sample; the bytes of a shelf bound
    what a task holds, large leaves are cut into several shelves. Nearest rows of each shelf are reranked exactly and
    merged. Fewer than ``trees * sample_rows / leaf_rows * 2`` leaves exist, whatever the size of the table: raise
    ``sample_rows`` for tables of many millions with structure.
    """
    rows, kind = _packed(df, key, vector, asks)
    rows = stored(rows, "vectors")
    width, length = rows.agg(F.max("width"), F.max("length")).first()
    width, length = width or 1, min(length or 1.0, float(np.finfo("float64").max))
    rows = rows.filter(F.col("width") == width)
    by_id = Window.partitionBy("vkey").orderBy("id")
    ids = (rows.select("vkey", "id").distinct().withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1)
           .groupBy("vkey").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = stored(ids.join(rows.select("vkey", "vec").dropDuplicates(["vkey"]), "vkey"), "distinct_vectors")
    sample = [bytes(r["vec"]) for r in index.select("vkey", "vec").orderBy("vkey").limit(sample_rows).collect()]
    sample = np.frombuffer(b"".join(sample), dtype=kind).reshape(-1, width).astype("float64")
    share = rows.sparkSession.sparkContext.broadcast
    forest = share(fit(sample, length, k, trees, leaf_rows, recall))

    def leaves_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
        points = lifted(_matrix(batch.column(at), kind), length)
        return np.array([route(t, points) + f for t, f in zip(forest.value.trees, forest.value.first_leaf)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.value.first_leaf[-1], dtype="int64")
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(leaves_of(batch, 0).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), pa.array(total)], ["leaf", "n"])

    # One figure per leaf; the number of leaves is bounded by the sample.
    sizes = np.zeros(forest.value.first_leaf[-1], dtype="int64")
    for r in index.select("vec").mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    most = max(1, shelf_bytes // (width * np.dtype(kind).itemsize))
    plan = share((*_shelves(sizes, most, forest.value.first_leaf), sizes, int(sizes.sum()) // trees))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, parts, _, _ = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = leaves_of(batch, 1)
            dealt = np.array([int.from_bytes(k[:4], "big") for k in batch.column(0).to_pylist()], dtype="int64")
            for row in leaf:
                yield _cells((shelf[row] + dealt % parts[row]), 0, row, pa.nulls(len(row), pa.binary()), batch.column(1), batch.column(2))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, parts, sizes, n = plan.value
        enough = max(forest.value.share * n, trees * (k + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            who, where, leaves = [], [], []
            for i, walk in enumerate(visits(forest.value, asking(_matrix(batch.column(1), kind)))):
                seen, on = 0, {}
                for leaf in walk:
                    for s in range(shelf[leaf], shelf[leaf] + parts[leaf]):
                        on.setdefault(s, []).append(leaf)
                    seen += sizes[leaf]
                    if seen >= enough:
                        break
                who += [i] * len(on)
                where += on
                leaves += on.values()
            take = pa.array(who, pa.int64())
            for at in range(0, len(who), 10_000):
                part = slice(at, at + 10_000)
                chosen = take[part]
                yield _cells(np.array(where[part]), 1, np.full(len(chosen), -1), batch.column(0).take(chosen),
                             batch.column(1).take(chosen), pa.array(leaves[part], pa.list_(pa.int64())))

    queries = rows.filter("asks").select("vkey", "vec").dropDuplicates(["vkey"])
    cells = (index.select("vkey", "vec", "ids").mapInArrow(deal, _CELL).union(queries.mapInArrow(ask, _CELL))
             .repartition("shelf").sortWithinPartitions("shelf", "kind", "leaf"))
    found = cells.mapInArrow(lambda batches: _match(batches, kind, k + 1), "q binary, ids array<long>, score double")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    tops = (found.select("q", F.explode("ids").alias("id"), "score").groupBy("q", "id").agg(F.max("score").alias("score"))
            .withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1)
            .groupBy("q").agg(F.collect_list(F.struct("id", "score")).alias("top")))
    asked = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("vkey").alias("q")).distinct()
    pairs = (spread_join(asked, tops, "q", "query_id").select("query_id", F.inline("top")).filter("id <> query_id")
             .groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shelves(sizes: np.ndarray, most: int, first_leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shelf and number of shelves of every leaf: runs of leaves of one tree, or parts of a large leaf."""
    shelf, parts = np.zeros(len(sizes), dtype="int64"), np.maximum(1, -(-sizes // most))
    at, filled = -1, most
    starts = set(first_leaf.tolist())
    for leaf, n in enumerate(sizes):
        if leaf in starts or filled + n > most:
            at, filled = at + 1, 0
        shelf[leaf] = at
        filled += n
        if parts[leaf] > 1:
            at, filled = at + int(parts[leaf]) - 1, most
    return shelf, parts


def _cells(shelf: np.ndarray, kind: int, leaf: np.ndarray, q: pa.Array, vec: pa.Array, numbers: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shelf.astype("int32")), pa.array(np.full(len(shelf), kind, dtype="int32")), pa.array(leaf.astype("int32")), q, vec,
         numbers], ["shelf", "kind", "leaf", "q", "vec", "numbers"])


def _match(batches: Iterable[pa.RecordBatch], kind: str, keep: int) -> Iterator[pa.RecordBatch]:
    """Rows of a shelf come first and are held, its queries pass by; shelves follow each other."""
    on, held, shelf = None, [], None
    for batch in batches:
        numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(numbers)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if numbers[a] != on:
                on, held, shelf = numbers[a], [], None
            if kinds[a] == 0:
                held.append(part)
                continue
            if not held and shelf is None:
                continue
            if shelf is None:
                table = pa.Table.from_batches(held).combine_chunks()
                held = []
                leaf = table.column("leaf").to_numpy()
                names, first = np.unique(leaf, return_index=True)
                start = {int(x): slice(int(i), int(j)) for x, i, j in zip(names, first, [*first[1:], len(leaf)])}
                rows = _matrix(table.column("vec"), kind)
                with np.errstate(over="ignore"):
                    longest = float(np.sqrt((rows * rows).sum(axis=1)).max())
                shelf = rows, start, table.column("numbers").combine_chunks(), longest
            rows, start, ids, longest = shelf
            asked = part.column(3)
            for who, which, score in _best(_matrix(part.column(4), kind), part.column(5).to_pylist(), rows, start, keep, longest):
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(who)), ids.take(pa.array(which)), pa.array(score)],
                                                 ["q", "ids", "score"])
