"""Near duplicates: MinHash bands for candidates, odd sketches to sift them, full shingle sets to confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import components, packed

SHINGLE, PERCENT = 5, 80
#: Bands of rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^32, about 3 in a million.
BANDS, ROWS = 32, 5
#: Bits of an odd sketch, and the estimate below which a pair is not looked at: five deviations under 0.8.
SKETCH_BITS, LEAST_ESTIMATE = 512, 0.6
#: Largest number of key pairs (24 bytes each) that travels to every executor instead of shuffling texts.
SMALL_TABLE = 1_000_000
#: A bucket that is compared in full is cut into parts of about so many rows and shingles, compared two by two.
PART_ROWS, PART_SHINGLES = 2048, 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_FACTOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int) -> np.ndarray:
    """64-bit hashes of the distinct runs of ``size`` words, sorted. A shorter text is one run; no words, none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for j in range(width):
        h = h * _MIX + ids[j:j + len(h)] * _PLACE[j % 64]
        h ^= h >> np.uint64(32)
    return np.unique(_mixed(h))


def min_hashes(found: np.ndarray) -> np.ndarray:
    """One minimum per hash function over a set of shingles, in bounded pieces."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 8192):
        out = np.minimum(out, ((low[i:i + 8192, None] ^ _FLIP) * _FACTOR).min(axis=0))
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for each row of minima; the number of the band is part of the key."""
    parts = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        key = _mixed(key * _PLACE[r] + parts[:, :, r])
    return key.view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps: every (function, minimum) flips one bit. Rows of 64-bit words."""
    place = _mixed(minima.astype(np.uint64) * _MIX + np.arange(1, minima.shape[1] + 1, dtype=np.uint64) * _PLACE[0])
    place = (place % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(minima))[:, None] * SKETCH_BITS
    odd = np.bincount(place.ravel(), minlength=len(minima) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(minima), SKETCH_BITS // 64)


def most_flips(least: float = LEAST_ESTIMATE) -> int:
    """Differing bits that two sketches show on average when the sets have the given similarity."""
    differing = 2 * BANDS * ROWS * (1 - least)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(k, h, n, node, bands, sketch) per row: h a hash of the text, node a digest of the whole shingle set."""
    schema = T.StructType([
        T.StructField("k", docs.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType()))])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima, n, node = np.zeros((batch.num_rows, BANDS * ROWS), np.uint32), [], []
            for i, t in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                found = shingles(t, size)
                minima[i] = min_hashes(found)
                n.append(len(found))
                node.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            lists = (pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                     for x in (bands(minima), odd_sketches(minima)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), *lists], schema.names)

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(_content(text)).alias("h"), _content(text).alias("t"))
    return rows.mapInArrow(sign, schema)


def _flips(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _near_enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches do not speak against it."""
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.filter(fits & (_flips("sketch_a", "sketch_b") <= most_flips()))


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))


def _sets(docs: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """(node, found): full shingle sets of the wanted classes (k, h, node), from the text of one row of each.

    The wanted keys travel to the texts while their number is checked to be small; else texts meet them by shuffle.
    """
    small = wanted.count() <= SMALL_TABLE
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(_content(text)).alias("h"), _content(text).alias("t"))
    other = wanted.select(F.col("k").alias("_k"), F.col("h").alias("_h"), "node")
    joined = rows.join(F.broadcast(other) if small else other, F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h")))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    sets = stored(joined.select("node", "t").mapInArrow(read, "node binary, found array<bigint>"), "sets")
    return sets.dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(classes.select("k", "h", "node").join(nodes, "node"), "wanted")
    sets = _sets(docs, key, text, size, wanted)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("found").alias("set_b")), "b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(shared * 100 >= union * percent).select("a", "b")


def _open_rows(members: DataFrame, linked: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (bucket, i, j, own, node, c, n, sketch) of buckets with more than two rows and more than one component.

    A bucket with many rows or large sets is cut into parts by a hash; parts i and j of it meet in one group of
    bounded size. Rows that were leaders have met all others of their bucket already.
    """
    placed = (members.join(linked, F.col("node") == F.col("id"), "left").withColumn("c", F.coalesce("component", "node"))
              .join(classes.select("node", "n", "sketch"), "node"))
    parts = F.ceil(F.greatest(F.col("rows") / PART_ROWS, F.col("total") / PART_SHINGLES)).cast("int")
    open_ = (placed.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.min("c").alias("c1"), F.max("c").alias("c2"))
             .filter((F.col("rows") > 2) & (F.col("c1") != F.col("c2"))).select("bucket", parts.alias("parts")))
    return (placed.filter("node <> leader").join(open_, "bucket")
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "n", "sketch"))


def _possible(group: pd.DataFrame, label: np.ndarray, sketch: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a group the later rows it may be linked with: of another component (``label``), with fitting
    sizes and sketches, and of the other part if the group holds two."""
    n, own, limit = group["n"].to_numpy(), group["own"].to_numpy(), most_flips()
    two = group["i"].iat[0] != group["j"].iat[0]
    for x in range(len(group) - 1):
        rest = slice(x + 1, len(group))
        good = (label[rest] != label[x]) & (np.minimum(n[rest], n[x]) * 100 >= np.maximum(n[rest], n[x]) * percent)
        if two:
            good &= own[rest] != own[x]
        at = np.flatnonzero(good) + x + 1
        at = at[np.bitwise_count(sketch[at] ^ sketch[x]).sum(axis=1) <= limit]
        if len(at):
            yield x, at


def _second_pass(members: DataFrame, linked: DataFrame, docs: DataFrame, key: str, text: str, size: int,
                 classes: DataFrame, percent: int) -> DataFrame:
    """Further links (a, b), between rows of a bucket of which neither was the leader.

    First sketches alone tell which rows have anything to compare; only those meet with their full sets. Pairs are
    compared inside the task, each in the first band that both share, and not once both are connected there; what
    leaves a task are links that join two components, never more than it has rows.
    """
    slots = ["bucket", "i", "j"]
    rows = _open_rows(members, linked, classes)

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(group), bool)
        sketch = np.stack(group["sketch"].to_numpy()).view(np.uint64)
        for x, at in _possible(group, pd.factorize(group["c"])[0], sketch, percent):
            hit[x] = True
            hit[at] = True
        return group.loc[hit, [*slots, "own", "node", "c"]]

    kept = stored(rows.groupBy(*slots).applyInPandas(sift, "bucket long, i int, j int, own int, node binary, c binary"), "sifted")
    wanted = stored(classes.select("k", "h", "node").join(kept.select("node").distinct(), "node"), "wanted_again")
    sets = _sets(docs, key, text, size, wanted)
    full = kept.join(classes.select("node", "n", "sketch", "bands"), "node").join(sets, "node")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        sketch, keys = (np.stack(group[name].to_numpy()) for name in ("sketch", "bands"))
        sets = [np.asarray(x).view(np.uint64) for x in group["found"]]
        sizes, node, label = np.array([len(x) for x in sets]), group["node"].to_numpy(), pd.factorize(group["c"])[0]
        band = int(np.flatnonzero((keys == group["bucket"].iat[0]).all(axis=0))[0])
        a, b = [], []
        for x, at in _possible(group, label, sketch.view(np.uint64), percent):
            at = at[~(keys[at, :band] == keys[x, :band]).any(axis=1)]
            if not len(at):
                continue
            joined = np.concatenate([sets[y] for y in at])
            place = np.minimum(np.searchsorted(sets[x], joined), len(sets[x]) - 1)
            shared = np.bincount(np.repeat(np.arange(len(at)), sizes[at])[sets[x][place] == joined], minlength=len(at))
            for y in at[shared * 100 >= (sizes[x] + sizes[at] - shared) * percent]:
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    a.append(node[x])
                    b.append(node[y])
        return pd.DataFrame({"a": a, "b": b})

    return full.groupBy(*slots).applyInPandas(link, "a binary, b binary")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: (k, h, n_shingles, component_id, first, times).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a document's set holds its distinct runs
    of ``size`` words, the whole text as one run if it is shorter, nothing if it has no words. Sets are linked if
    100 * shared >= ``percent`` * union. ``component_id`` is the smallest key reachable over links; ``first`` tells
    the row that stands for the component, ``times`` how often that row (key and text) occurs. NULL text counts
    as empty; empty sets link with nothing. Rows with equal sets are one class: copies are never paired.

    Candidates are (row, leader) for each shared band, one leader per bucket, so their number is linear. What
    passes the odd sketches is confirmed on full sets. Buckets whose rows then lie in several components are
    compared in full in a second pass, so that a link between two rows is found though neither is the leader.
    No step emits the pairs of a group.
    """
    rows = stored(signatures(docs, key, text, size), "signatures")
    classes = stored(rows.filter("n > 0").dropDuplicates(["node"]), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    leaders = (buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
               .filter("leader <> last").drop("last"))
    members = stored(buckets.join(leaders, "bucket"), "members")
    pairs = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = stored(_near_enough(pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b"), percent).select("a", "b"), "pairs")
    links = stored(_confirmed(near, docs, key, text, size, classes, percent), "links")
    linked = stored(components(links), "components")
    added = stored(_second_pass(members, linked, docs, key, text, size, classes, percent), "more_links")
    if added.limit(1).count():
        linked = stored(components(links.union(added)), "components")
    placed = (rows.select("k", "h", "n", "node").join(linked, F.col("node") == F.col("id"), "left")
              .select("k", "h", "n", F.coalesce("component", "node").alias("c")))
    filled = placed.filter("n > 0")
    least = (filled.groupBy("c", "k", "h").agg(F.count("*").alias("times"))
             .groupBy("c").agg(F.min("k").alias("component_id"), F.min(F.struct(F.col("k").isNull(), "k", "h", "times")).alias("m")))
    found = filled.join(least, "c").select(
        "k", "h", F.col("n").alias("n_shingles"), "component_id",
        (F.col("k").eqNullSafe(F.col("m.k")) & (F.col("h") == F.col("m.h"))).alias("first"), F.col("m.times").alias("times"))
    empty = placed.filter("n = 0").select("k", "h", F.col("n").alias("n_shingles"), F.col("k").alias("component_id"),
                                          F.lit(True).alias("first"), F.lit(1).cast("long").alias("times"))
    return found.unionByName(empty)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                         percent: int = PERCENT) -> DataFrame:
    """One document of each group, that with the smallest key, with all its columns.

    The rows to drop travel to the texts while their number is checked to be small; else both meet by shuffle. Of
    whole rows that repeat (key and text) one stays.
    """
    groups = stored(near_groups(docs, key, text, size, percent), "groups")
    mine = packed(docs, k=F.col(key), h=F.xxhash64(_content(text)))

    def listed(which: DataFrame) -> tuple[DataFrame, Column]:
        other = stored(which.select(F.col("k").alias("_k"), F.col("h").alias("_h")).distinct(), "listed")
        return (F.broadcast(other) if other.count() <= SMALL_TABLE else other,
                mine["k"].eqNullSafe(other["_k"]) & (mine["h"] == other["_h"]))

    kept = mine.join(*listed(groups.filter("not first")), "left_anti")
    again = groups.filter("first and times > 1")
    if not again.limit(1).count():
        return kept.select("row.*")
    repeated = listed(again)
    return (kept.join(*repeated, "left_anti").select("row.*")
            .union(kept.join(*repeated, "left_semi").dropDuplicates(["k", "h"]).select("row.*")))
