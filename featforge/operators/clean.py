"""Filling and quarantining of missing or broken values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import no_nan
from .ordered import BLOCK, PLACE, in_order, nearest_known, number_rows


def interpolate(df: DataFrame, group: list[str], order: list[str], value: str, out: str | None = None) -> DataFrame:
    """Linear interpolation by row position inside each group. NULL and NaN are gaps.

    Leading gaps stay NULL, trailing gaps take the last value.
    """
    pos, v = "_pos", no_nan(F.col(value))
    placed = number_rows(in_order(df, group, order), group, pos)
    df = nearest_known(placed, group, pos, v, "_prev", "_next")
    p0, v0 = F.col("_prev.p"), F.col("_prev.v")
    p1, v1 = F.col("_next.p"), F.col("_next.v")
    filled = (
        F.when(v.isNotNull(), v)
        .when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(),
              v0 + (v1 - v0) * (F.col(pos) - p0) / (p1 - p0))
        .otherwise(v0)
    )
    return df.withColumn(out or value, filled).drop(pos, "_prev", "_next", BLOCK, PLACE)


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """One mean per column, NULL and NaN left out; a single row, so it may come to the driver."""
    row = df.agg(*[F.avg(no_nan(F.col(c))).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols if row[c] is not None}


def fill_means(df: DataFrame, cols: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill gaps with column means of ``fitted_on`` (the table itself by default)."""
    means = column_means(fitted_on if fitted_on is not None else df, cols)
    filled = {c: F.coalesce(no_nan(F.col(c)).cast("double"), F.lit(m)) for c, m in means.items()}
    return df.withColumns(filled)


def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(cols) if cols else None)


def quarantine(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the first failing reason.

    ``checks`` maps a reason to a condition that marks a bad row.
    """
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(
        F.col("reason").isNotNull())
