"""Segments, chunks, windows and frames over ordered rows or arrays.

Row series are cut by a dense position, so every later group (segment, chunk,
frame) is bounded by its own length whatever the size of the series. Sequences
that already sit in one array cell are cut inside the row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import no_nan
from .ordered import BLOCK, BLOCK_ROWS, dense_position, in_order, running_total, whole_runs, with_halo


def segment_rows(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Tumbling segments of ``size`` rows; the last one of a group may be short.

    Adds ``pos`` (in the group), ``seg`` and ``t`` (in the segment).
    """
    placed = dense_position(df, group, order, "pos")
    return (placed.withColumn("seg", F.floor(F.col("pos") / size))
            .withColumn("t", F.col("pos") % size))


def segment_labels(segments: DataFrame, group: list[str], label: str) -> DataFrame:
    """Label of a segment = label of its first row."""
    return segments.filter(F.col("t") == 0).select(*group, "seg", F.col(label).alias("label"))


def running_segment_ids(segments: DataFrame, file: str, size: int, out: str = "segment_id") -> DataFrame:
    """Number segments through all files in sorted file order; rows without a file come first.

    Only the per-file segment counts are ordered globally, not the rows.
    """
    files = segments.groupBy(F.col(file).alias("_file")).agg(F.ceil(F.count(F.lit(1)) / size).alias("_k"))
    placed = running_total(in_order(files, [], ["_file"]), [], F.col("_k"), "_end")
    first = placed.select("_file", (F.col("_end") - F.col("_k")).alias("_first"))
    return (segments.join(first, F.col(file).eqNullSafe(F.col("_file")), "left")
            .withColumn(out, F.col("_first") + F.col("seg")).drop("_first", "_file"))


def renumber(df: DataFrame, order: list[str], out: str = "id", first: int = 0) -> DataFrame:
    """Consecutive numbers in key order over the whole table."""
    return dense_position(df, [], order, out).withColumn(out, F.col(out) + first)


def first_rows(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.filter(F.col(pos) < n)


# --- arrays inside a row -------------------------------------------------------


def chunk_array(tokens: Column, size: int) -> Column:
    """Array of consecutive chunks; the last one may be short, none for an empty array."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(tokens) / size).cast("int") - 1)
    chunks = F.transform(starts, lambda i: F.slice(tokens, i * size + 1, size))
    return F.when(F.size(tokens) > 0, chunks).otherwise(
        F.array().cast("array<array<string>>"))


def chunk_rows(df: DataFrame, tokens: str, size: int) -> DataFrame:
    """One row per chunk with its number."""
    return df.select(*[c for c in df.columns if c != tokens],
                     F.posexplode(chunk_array(F.col(tokens), size)).alias("chunk", tokens))


def chunk_long(df: DataFrame, group: list[str], pos: str, value: str, size: int) -> DataFrame:
    """Chunks of a long token table that already has positions."""
    return (df.withColumn("chunk", F.floor(F.col(pos) / size))
            .groupBy(*group, "chunk")
            .agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("_items"))
            .select(*group, "chunk", F.col(f"_items.{value}").alias("tokens")))


def chunk_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def clip(array: Column, length: int) -> Column:
    """Symmetric cut to ``length``; an odd surplus loses one more element on the left.

    NULL for an array that is too short (see ``clean.quarantine``).
    """
    surplus = F.size(array) - length
    left = F.when(surplus % 2 == 0, (surplus / 2).cast("int")).otherwise(
        F.floor(surplus / 2).cast("int") + 1)
    return F.when(surplus >= 0, F.slice(array, F.least(left, surplus) + 1, length))


def pad(array: Column, length: Column | int, value) -> Column:
    """Fill an array at its end up to ``length``."""
    length = length if isinstance(length, Column) else F.lit(length)
    missing = F.greatest(length - F.size(array), F.lit(0))
    filler = value if isinstance(value, Column) else F.lit(value)
    return F.concat(array, F.array_repeat(filler, missing))


def positioned(df: DataFrame, keys: list, array: str, pos: str = "pos",
               value: str = "value") -> DataFrame:
    """One row per element of a computed array column.

    The outer form with its NULL rows removed: the plain form makes the optimizer
    test the array before exploding it, which computes the column again.
    """
    return (df.select(*keys, F.posexplode_outer(array).alias(pos, value))
            .filter(F.col(pos).isNotNull()))


def explode_sequence(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per element of parallel arrays: keys, ``pos`` and one column per array."""
    zipped = F.arrays_zip(*[F.col(a).alias(out) for out, a in columns.items()])
    return (df.select(*keys, F.posexplode(zipped).alias("pos", "_e"))
            .select(*keys, "pos", *[F.col("_e").getField(out).alias(out) for out in columns]))


def flatten_chunks(df: DataFrame, keys: list[str], chunks: str, value: str = "value",
                   keep: Column | None = None) -> DataFrame:
    """Chunks of each row back to positioned elements, cut at ``keep`` elements."""
    out = df.select(*keys, *([keep.alias("_keep")] if keep is not None else []),
                    F.posexplode(F.flatten(F.col(chunks))).alias("pos", value))
    if keep is not None:
        out = out.filter(F.col("pos") < F.col("_keep")).drop("_keep")
    return out


def flatten_map_predictions(df: DataFrame, keys: list[str], predictions: str) -> DataFrame:
    """List of lists of one-entry maps to one value per token."""
    return (df.select(*keys, F.posexplode(F.flatten(F.col(predictions))).alias("pos", "_m"))
            .select(*keys, "pos", F.map_values("_m")[0].alias("value")))


def ordinals(df: DataFrame, key: str, items: str, out_key: str = "id", out: str = "name") -> DataFrame:
    """Elements with a 1-based ordinal appended to the key: ``key_1``, ``key_2``."""
    return (positioned(df, [F.col(key).alias("_k")], items, "_p", out)
            .select(F.concat_ws("_", F.col("_k").cast("string"), (F.col("_p") + 1).cast("string"))
                    .alias(out_key), out))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == index).cast("int"))


def argmax(array: Column) -> Column:
    """0-based index of the largest element, the lowest one on ties."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def argmax_rows(df: DataFrame, group: list[str], index: str, score: str) -> DataFrame:
    """Per group the index of the best score, the lowest index on ties."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(index)).alias("i"))).alias("_b")
    return df.groupBy(*group).agg(best).select(
        *group, (-F.col("_b.i")).alias(index), F.col("_b.s").alias(score))


def transpose(matrix: Column) -> Column:
    """(time, channel) nested array to (channel, time) and back."""
    width = F.size(F.get(matrix, F.lit(0)))
    return F.when(F.size(matrix) > 0, F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda c: F.transform(matrix, lambda row: F.get(row, c)))).otherwise(matrix)


# --- windows over positioned rows --------------------------------------------------


#: Values of the windows that leave a task at a time.
SLIDING_VALUES = 1 << 20


def sliding(df: DataFrame, group: list[str], pos: str, value: Column, size: int, out: str, kind: T.DataType,
            make: Callable[[pa.Array, np.ndarray], pa.Array], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``make(values, first)`` for every window of ``size`` rows, step 1: group, ``frame`` (its first row) and ``out``.

    ``first`` are places in ``values`` at which windows begin; the result has one value of type ``kind`` for each. The
    window that ends with the last row of the series is not made: a series of N rows has N - size frames. Rows are sent
    and held once, by blocks with ``size`` rows of the next; what is made for windows leaves in bounded batches.
    """
    shared = with_halo(df.select(*group, F.col(pos).cast("long").alias("_at"), value.alias("_value")), "_at", 0, size, block_rows)
    placed = shared.repartition(*group, BLOCK).sortWithinPartitions(*group, BLOCK, "_at").select(
        *group, F.col("_at").alias("frame"), F.col(BLOCK).cast("long").alias(BLOCK), "_own", "_value")
    schema = T.StructType([*placed.schema.fields[:len(group) + 1], T.StructField(out, kind)])
    keys, width = len(group), max(block_rows, size, 1)

    def starts(t: pa.RecordBatch) -> np.ndarray:
        return t.column(keys).to_numpy() == t.column(keys + 1).to_numpy() * width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, starts):
            runs, own = np.cumsum(starts(t)), t.column(keys + 2).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(own[:-size] & (runs[size:] == runs[:-size])) if size < len(own) else np.zeros(0, int)
            for part in np.array_split(first, max(1, -(-len(first) * size // SLIDING_VALUES))):
                if len(part):
                    rows = t.select(range(keys + 1)).take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([*rows.columns, make(t.column(keys + 3), part)], schema.names)

    return placed.mapInArrow(run, schema)


def sliding_windows(df: DataFrame, group: list[str], pos: str, value: str, size: int,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every window of ``size`` rows, step 1, as an array ``window``; see ``sliding``. Missing values stay in place."""
    def window(values: pa.Array, first: np.ndarray) -> pa.Array:
        cut = values.take(pa.array((first[:, None] + np.arange(size)).ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int32()), cut)

    return sliding(df, group, pos, F.col(value), size, "window", T.ArrayType(df.schema[value].dataType), window, block_rows)


def overlapping_frames(df: DataFrame, group: list[str], pos: str, value: str, size: int | Column,
                       hop: int | Column, zero_edges: bool = False) -> DataFrame:
    """Frames of ``size`` rows that start every ``hop`` rows, as arrays. Missing values stay in place as NULL.

    Only complete frames, or with ``zero_edges`` all frames of the series extended
    by half a frame of zeros on both sides. A row is copied ``size / hop`` times. Size and hop may be
    columns, constant in a group (see ``frame_size``).
    """
    size, hop = (x if isinstance(x, Column) else F.lit(x) for x in (size, hop))
    base = df.select(*group, F.col(pos).alias("_p"), F.col(value).cast("double").alias("_v"),
                     size.cast("long").alias("_size"), hop.cast("long").alias("_hop"))
    p = F.col("_p") + (F.floor(F.col("_size") / 2) if zero_edges else F.lit(0))
    last = F.floor(p / F.col("_hop"))
    first = F.greatest(F.floor((p - F.col("_size") + F.col("_hop")) / F.col("_hop")), F.lit(0))
    # A row between two frames (hop > size) belongs to none.
    covering = F.when(first <= last, F.sequence(first, last))
    rows = base.select(*group, "_size", "_hop", p.alias("_p"), "_v", F.explode(covering).alias("frame"))
    item = F.struct((F.col("_p") - F.col("frame") * F.col("_hop")).cast("int").alias("o"), F.col("_v").alias("v"))
    framed = rows.groupBy(*group, "_size", "frame").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    if zero_edges:
        at = F.map_from_entries("_i")
        window = F.transform(F.sequence(F.lit(0), F.col("_size").cast("int") - 1),
                             lambda o: F.when(F.map_contains_key(at, o), F.try_element_at(at, o)).otherwise(F.lit(0.0)))
        return framed.select(*group, "frame", window.alias("window"))
    return framed.filter(F.size("_i") == F.col("_size")).select(*group, "frame", F.col("_i.v").alias("window"))


def frame_size(df: DataFrame, group: list[str], pos: str, size: int, out: str = "_frame") -> DataFrame:
    """Add the frame length of each series: ``size``, or all of a shorter series."""
    lengths = df.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg((F.max(pos) + 1).alias("_n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (df.join(lengths, same).withColumn(out, F.least(F.lit(size).cast("long"), F.col("_n")))
            .drop("_n", *[f"_g_{g}" for g in group]))


def pack(df: DataFrame, keys: Sequence[str], t: str, value: str, out: str = "series") -> DataFrame:
    """Rows of a (bounded) segment as one array in time order."""
    return (df.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(t, value))).alias("_i"))
            .select(*keys, F.col(f"_i.{value}").alias(out)))


def z_scores(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """(value - mean) / population deviation per key; 0 where the deviation is 0. NULL is a key, NaN is missing.

    Statistics are aggregated first and joined back, so a large group is not sorted.
    """
    v = no_nan(F.col(value))
    stats = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    z = F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")).when(v.isNotNull(), F.lit(0.0))
    return df.join(stats, same, "left").withColumn(out, z).drop("_m", "_s", *[f"_k_{k}" for k in keys])
