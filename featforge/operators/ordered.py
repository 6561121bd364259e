"""Order-dependent building blocks that never put one whole group in one task.

A plain ``row_number() over (partition by g order by t)`` sends every row of
``g`` to one task. When one group holds a third of a large table that task is
the job. Here rows are range-partitioned by group and order columns, sorted in
their partition, numbered there and written to the shared folder: one shuffle,
whatever the sizes of the groups, and partitions of even size. A partition is a
*block*. Results are built in two levels: a window inside each block, and a
small table that carries totals or neighbours from earlier blocks of a group.

Only the first group of a block can have begun in an earlier one, so the carried
table has at most one row per block; there are no more blocks than shuffle
partitions, which bounds what is sent to every executor. Whole keys are compared
by Spark's own ordering (NULL first, NaN last). Rows that agree in all order
columns stay together, so the order should be total.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BLOCK, PLACE = "_block", "_place"
#: Rows per block where rows have a dense position already.
BLOCK_ROWS = 1 << 20
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in the partition below


def in_order(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows in blocks: adds ``_block`` and ``_place`` (rising within and over blocks)."""
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = stored(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "ordered")
    return placed.withColumn(BLOCK, F.shiftright(PLACE, _ROW_BITS))


def _upto(group: list[str]) -> Window:
    return Window.partitionBy(*group, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _other_blocks(group: list[str], later: bool = False) -> Window:
    step = F.col(BLOCK).desc() if later else F.col(BLOCK)
    keys = [F.col(g) for g in group] or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    """Join per-block figures; a NULL group meets its own. At most one row per block travels."""
    names = {g: f"_c_{g}" for g in [*group, BLOCK]}
    other = carried.select(*[F.col(g).alias(n) for g, n in names.items()],
                           *[c for c in carried.columns if c not in names])
    same = F.lit(True)
    for g, n in names.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    return df.join(F.broadcast(other), same, "left").drop(*names.values())


def running_total(placed: DataFrame, group: list[str], value: Column, out: str) -> DataFrame:
    """Inclusive running total of ``value``, NULL as nothing, over a table from ``in_order``."""
    before = (placed.groupBy(*group, BLOCK).agg(F.sum(value).alias("_sum"))
              .withColumn("_before", F.sum("_sum").over(_other_blocks(group)))
              .filter(F.col("_before").isNotNull()).drop("_sum"))
    local = F.coalesce(F.sum(value).over(_upto(group)), F.lit(0))
    joined = _attach(placed.withColumn(out, local), before, group)
    return joined.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before")


def dense_position(df: DataFrame, group: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """0-based position of every row in its group; ``order`` must be total."""
    return number_rows(in_order(df, group, order), group, out).drop(BLOCK, PLACE)


def number_rows(placed: DataFrame, group: list[str], out: str) -> DataFrame:
    """0-based positions of a table from ``in_order``. Without groups the row's number in its block and the
    sizes of earlier blocks are all it takes: no second shuffle."""
    before = (placed.groupBy(*group, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(_other_blocks(group)))
              .filter(F.col("_before").isNotNull()).drop("_n"))
    if group:
        local = F.row_number().over(Window.partitionBy(*group, BLOCK).orderBy(PLACE)).cast("long") - 1
    else:
        local = F.col(PLACE).bitwiseAND((1 << _ROW_BITS) - 1)
    return (_attach(placed.withColumn(out, local), before, group)
            .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before"))


def nearest_known(placed: DataFrame, group: list[str], pos: str, value: Column, before: str = "_before",
                  after: str | None = None) -> DataFrame:
    """Nearest row with a non-null ``value`` at or before / at or after each row.

    Adds structs ``(p, v)`` to a table in blocks. The look-ahead runs as a look-back over the
    descending order: an unbounded-following frame would cost a rescan per row.
    """
    df = placed.withColumn("_known", F.when(value.isNotNull(), F.struct(F.col(pos).alias("p"), value.alias("v"))))
    ahead = Window.partitionBy(*group, BLOCK).orderBy(F.col(PLACE).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carried = (df.groupBy(*group, BLOCK).agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
               .withColumn("_earlier", F.last("_last", ignorenulls=True).over(_other_blocks(group)))
               .withColumn("_later", F.last("_first", ignorenulls=True).over(_other_blocks(group, later=True)))
               .filter(F.col("_earlier").isNotNull() | F.col("_later").isNotNull()).drop("_first", "_last"))
    out = df.withColumn(before, F.last("_known", ignorenulls=True).over(_upto(group)))
    if after:
        out = out.withColumn(after, F.last("_known", ignorenulls=True).over(ahead))
    out = _attach(out, carried, group).withColumn(before, F.coalesce(before, "_earlier"))
    if after:
        out = out.withColumn(after, F.coalesce(after, "_later"))
    return out.drop("_known", "_earlier", "_later")


def with_halo(df: DataFrame, pos: str, behind: int, ahead: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows near a block border into the neighbouring block as well.

    For rows with a dense position. After this, windows over ``(group, _block)``
    that look at most ``behind`` rows back and ``ahead`` rows forward see all they
    need; keep rows with ``_own``.
    """
    width = max(rows, behind, ahead, 1)
    p = F.col(pos)
    own = F.floor(p / width)
    border = (p % width < ahead) | (p % width >= width - behind)
    targets = F.when(border, F.array_distinct(F.array(
        F.floor(F.greatest(p - ahead, F.lit(0)) / width), own, F.floor((p + behind) / width)))).otherwise(F.array(own))
    return (df.withColumn(BLOCK, F.explode(targets))
            .withColumn("_own", F.col(BLOCK) == own))


def whole_runs(batches: Iterable[pa.RecordBatch], starts: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut anew so that each holds whole runs of rows; ``starts`` marks the first row of every run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(starts(batch))
        if len(first) and (held or first[-1]):
            yield pa.concat_batches([*held, batch.slice(0, first[-1])])
            held, batch = [], batch.slice(first[-1])
        held.append(batch)
    if held:
        yield pa.concat_batches(held)
