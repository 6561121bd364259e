"""Table profiles: counts, statistics, quantiles, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import no_nan
from .ordered import BLOCK, PLACE, dense_position, in_order, running_total

QUARTILES = (0.25, 0.5, 0.75)
# Up to this many rows the built-in exact percentile (a map of all values) is used.
DIRECT_ROWS = 1 << 16


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _melt(df: DataFrame, cols: Sequence[str], dtype: str) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), F.when(~_missing(df, c), F.col(f"`{c}`").cast(dtype)).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*items)))


@dataclass
class _Target:
    """Values wanted at ``ranks`` (0-based) among the ``n`` values of a column in a range."""

    column: str
    ranks: tuple[int, ...]
    n: int
    above: float | None = None       # values > above
    upto: float | None = None        # values <= upto, or < upto
    closed: bool = True
    n_below: int = 0                 # values of the column below the range

    def values(self) -> Column:
        v = F.col(f"`{self.column}`").cast("double")
        inside = F.lit(True)
        if self.above is not None:
            inside = inside & (v > self.above)
        if self.upto is not None:
            inside = inside & ((v <= self.upto) if self.closed else (v < self.upto))
        return F.when(inside & ~F.isnan(v), v)


MARGIN = 0.002


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES,
                    direct_rows: int = DIRECT_ROWS) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles without gathering a column in one task.

    A sketch proposes a value range around each wanted rank, one pass counts the rows
    below and inside, and the next round looks only at the range that holds the rank.
    The counts prove it, so the answer is exact whatever the sketch said. All
    columns and ranks share the passes of a round (two per round, rarely more than two
    rounds); a fixed number of values per column reaches the driver.
    """
    marks = [m for p in probs for m in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    aggs = []
    for c in cols:
        v = _Target(c, (), 0).values()
        aggs += [F.count(v), F.percentile_approx(v, marks, 5000)]
    first = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    counts, sketches = first[0::2], first[1::2]
    places: dict[tuple[str, float], float] = {}
    open_targets: list[_Target] = []
    for i, c in enumerate(cols):
        n = counts[i]
        for p in probs:
            rank = p * (n - 1)
            places[c, p] = rank
            low = int(rank)
            if n:
                open_targets.append(_Target(c, (low,) if rank == low else (low, low + 1), n))
    values: dict[tuple[str, int], float] = {}
    ends = {(c, p): sketches[i][2 * k:2 * k + 2] for i, c in enumerate(cols) if counts[i]
            for k, p in enumerate(probs)}
    proposed = [ends[c, p] for c in cols for p in probs if (c, p) in ends]
    while any(t.n > direct_rows for t in open_targets):
        open_targets = _narrow(df, open_targets, proposed, direct_rows, values)
        proposed = None
    if open_targets:
        row = df.agg(*[F.percentile(t.values(), [r / max(t.n - 1, 1) for r in t.ranks]).alias(f"q{i}")
                       for i, t in enumerate(open_targets)]).first()
        for t, found in zip(open_targets, row):
            values.update({(t.column, r + t.n_below): v for r, v in zip(t.ranks, found)})
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            if not counts[i]:
                out[c].append(None)
                continue
            low, part = int(places[c, p]), places[c, p] - int(places[c, p])
            a = values[c, low]
            out[c].append(a if part == 0 else a + (values[c, low + 1] - a) * part)
    return out


def _narrow(df: DataFrame, targets: list[_Target], proposed: list | None, direct_rows: int,
            values: dict[tuple[str, int], float]) -> list[_Target]:
    """One round: every large target gets a smaller range or its values.

    ``proposed`` holds the ends of a range per target where they are known already.
    """
    large = [t for t in targets if t.n > direct_rows]
    done = [t for t in targets if t.n <= direct_rows]
    if proposed is None:
        sketches = [F.percentile_approx(t.values(), [
            max(t.ranks[0] / t.n - MARGIN, 0.0), min((t.ranks[-1] + 1) / t.n + MARGIN, 1.0)], 5000)
            for t in large]
        ends = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first()
    else:
        ends = [e for t, e in zip(targets, proposed) if t.n > direct_rows]
    aggs = []
    for i, t in enumerate(large):
        (a, b), v = ends[i], t.values()
        aggs += [F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v <= b))]
    numbers = df.agg(*[x.alias(f"n{i}") for i, x in enumerate(aggs)]).first()
    for i, t in enumerate(large):
        a, b = ends[i]
        below, equal, inside = numbers[3 * i:3 * i + 3]
        parts: dict[str, list[int]] = {}
        for r in t.ranks:
            where = ("below" if r < below else "equal" if r < below + equal
                     else "inside" if r < below + equal + inside else "beyond")
            parts.setdefault(where, []).append(r)
        for where, ranks in parts.items():
            if where == "equal":
                values.update({(t.column, r + t.n_below): a for r in ranks})
            elif where == "below":
                done.append(_Target(t.column, tuple(ranks), below, t.above, a, False, t.n_below))
            elif where == "inside":
                done.append(_Target(t.column, tuple(r - below - equal for r in ranks), inside, a, b, True,
                                    t.n_below + below + equal))
            else:
                skipped = below + equal + inside
                done.append(_Target(t.column, tuple(r - skipped for r in ranks), t.n - skipped, b, t.upto,
                                    t.closed, t.n_below + skipped))
    return done


def describe(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False,
             direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per numeric column."""
    cols = list(cols or numeric_columns(df))
    melted_stats = []
    for c in cols:
        v = no_nan(F.col(f"`{c}`").cast("double"))
        melted_stats.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            (F.percentile_approx(v, list(QUARTILES), 10000) if approximate
             else F.lit(None).cast("array<double>")).alias("q")))
    stats = df.agg(F.array(*melted_stats).alias("s")).select(F.inline("s"))
    if approximate:
        q = [F.get("q", F.lit(i)) for i in range(3)]
    else:
        exact = exact_quantiles(df, cols, QUARTILES, direct_rows)
        branch = [None, None, None]
        for i in range(3):
            col: Column = F.lit(None).cast("double")
            for c in cols:
                col = F.when(F.col("column") == c, F.lit(exact[c][i]).cast("double")).otherwise(col)
            branch[i] = col
        q = branch
    return stats.select("column", "count", "mean", "std", "min", q[0].alias("q25"),
                        q[1].alias("q50"), q[2].alias("q75"), "max")


#: Sizes of the sketches: ranks err by some 0.5 %, numbers of distinct values by some 0.7 % (one standard error).
KLL_SIZE, HLL_BITS = 1024, 14


def sketches(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """What a profile needs of each numeric column, in a form that can be kept and merged; one pass.

    One row per column and value of ``by`` (such as the name of a file): (column, n, n_missing, total, squares, least,
    greatest, ranks, values); ``ranks`` is a KLL sketch of the values, ``values`` a HyperLogLog sketch. ``squares`` is
    the sum of squared deviations from the mean. Missing values (NULL, NaN) are only counted.
    """
    cols = list(cols or numeric_columns(df))
    parts = []
    for c in cols:
        v = no_nan(F.col(f"`{c}`").cast("double"))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.sum(v).alias("total"),
            (F.var_pop(v) * F.count(v)).alias("squares"), F.min(v).alias("least"), F.max(v).alias("greatest"),
            F.kll_sketch_agg_double(v, KLL_SIZE).alias("ranks"), F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), HLL_BITS).alias("values")))
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(F.array(*parts).alias("_s")).select(*by, F.inline("_s"))


def merged_sketches(tables: Sequence[DataFrame]) -> DataFrame:
    """One row per column for all the tables of ``sketches`` together; the rows behind them are not read again."""
    every = tables[0].select(*SKETCH)
    for t in tables[1:]:
        every = every.unionByName(t.select(*SKETCH))
    filled = F.col("n") > 0
    mean = F.sum("total") / F.sum("n")
    return every.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.sum("total").alias("total"),
        # Deviations of the parts, and of their means from the mean of all.
        (F.sum("squares") + F.sum(F.try_divide(F.col("total") * F.col("total"), F.col("n"))) - mean * F.sum("total")).alias("squares"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double(F.when(filled, F.col("ranks"))).alias("ranks"), F.hll_union_agg(F.when(filled, F.col("values"))).alias("values"))


SKETCH = ("column", "n", "n_missing", "total", "squares", "least", "greatest", "ranks", "values")


def sketch_profile(merged: DataFrame, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """count, missing, mean, std, min, quantiles (within the sketch's error), max and the estimated number of distinct values."""
    filled, n = F.col("n") > 0, F.col("n")
    quantiles = F.when(filled, F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(float(p))) for p in probs]))
    return merged.select(
        "column", n.alias("count"), "n_missing", F.try_divide("total", n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / (n - 1))).alias("std"), F.col("least").alias("min"),
        quantiles.alias("quantiles"), F.col("greatest").alias("max"),
        F.when(filled, F.hll_sketch_estimate("values")).otherwise(F.lit(0).cast("long")).alias("n_distinct"))


def value_counts(df: DataFrame, cols: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Row count per value of every listed column, in one pass. Missing values (NULL, NaN) are left out."""
    long = _melt(df, cols, "string")
    if not keep_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values (NULL or NaN) per column, one pass over the table."""
    cols = list(cols or df.columns)
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"),
                                    F.count_if(_missing(df, c)).alias("n_null"))
                           for c in cols]).alias("s"))
    return one.select(F.inline("s"))


def null_positions(df: DataFrame, col: str, pos: str) -> DataFrame:
    return df.filter(_missing(df, col)).select(pos)


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; a missing value counts as one value.

    The exact form counts after a distinct of (column, value), so no task holds a
    set of all values of a column.
    """
    if approximate:
        one = df.agg(F.array(*[F.struct(
            F.lit(c).alias("column"),
            (F.approx_count_distinct(f"`{c}`")
             + F.max(_missing(df, c).cast("int"))).alias("n_distinct")) for c in cols]).alias("s"))
        return one.select(F.inline("s"))
    return (_melt(df, cols, "string").distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample variance and sample standard deviation per column."""
    aggs = []
    for c in cols:
        v = no_nan(F.col(f"`{c}`").cast("double"))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.var_samp(v).alias(f"{c}_var"),
                 F.stddev_samp(v).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def length_range(df: DataFrame, length: Column) -> DataFrame:
    return df.agg(F.min(length).cast("long").alias("min_len"),
                  F.max(length).cast("long").alias("max_len"))


def vocabulary(tokens: DataFrame, word: str = "word", first_index: int = 1) -> DataFrame:
    """Distinct words with counts and an index by word order.

    ``first_index`` is 1 by default: 0 stays free for padding.
    """
    words = (tokens.filter(F.col(word).isNotNull())
             .groupBy(word).agg(F.count(F.lit(1)).alias("n")))
    numbered = dense_position(words, [], [word], "idx")
    return numbered.withColumn("idx", F.col("idx") + first_index)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("long").alias("n_cols"))


def running_mean(df: DataFrame, group: list[str], order: list[str], value: str, out: str = "running_mean") -> DataFrame:
    """Mean of all values up to each row, NULL and NaN not counted."""
    v = no_nan(F.col(value))
    summed = running_total(in_order(df, group, order), group, v, "_sum")
    counted = running_total(summed, group, v.isNotNull().cast("int"), "_cnt")
    return (counted.withColumn(out, F.when(F.col("_cnt") > 0, F.col("_sum") / F.col("_cnt")))
            .drop("_sum", "_cnt", BLOCK, PLACE))
