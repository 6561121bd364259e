"""Joins: aligning tables on an explicit key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_target(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Features with their target column; features without a target stay."""
    return features.join(target, key, "left")


def fill_template(template: DataFrame, predictions: DataFrame, key: str, fill: str = "") -> DataFrame:
    """Predictions in the row set of a template; missing text becomes ``fill``."""
    return template.select(key).join(predictions, key, "left").na.fill(fill)


def manifest(files: DataFrame, key: str, kind: str, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """One row per key with one path column per kind (an outer alignment).

    One shuffle instead of a chain of outer joins. ``dup`` counts surplus files of
    a (key, kind), which an alignment cannot place.
    """
    cols = [F.min(F.when(F.col(kind) == k, F.col(path))).alias(name) for k, name in kinds.items()]
    seen = F.count_if(F.col(kind).isin(*kinds))
    filled = sum(((F.count_if(F.col(kind) == k) > 0).cast("int") for k in kinds), F.lit(0))
    return files.groupBy(key).agg(*cols, (seen - filled).alias("dup"))


def exists_flag(df: DataFrame, names: DataFrame, name: str, out: str = "class") -> DataFrame:
    """1 when the row's name occurs in ``names``, else 0; row count unchanged."""
    known = names.select(name).distinct().withColumn("_hit", F.lit(1))
    return df.join(known, name, "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def lookup_strict(df: DataFrame, codes: DataFrame, key: str, value: str) -> DataFrame:
    """Every row must find its code: a missing one fails the job."""
    hit = codes.select(key, F.col(value), F.lit(True).alias("_hit"))
    joined = df.join(hit, key, "left")
    message = F.concat(F.lit("no code for "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    checked = F.when(F.col("_hit"), F.col(value)).otherwise(
        F.raise_error(message).cast(codes.schema[value].dataType))
    return joined.withColumn(value, checked).drop("_hit")


def lookup_default(df: DataFrame, codes: DataFrame, key: str, value: str, default: str = "0") -> DataFrame:
    """Code of every row, ``default`` when there is none."""
    return df.join(codes.select(key, value), key, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default)))


def rows_predicted(df: DataFrame, predictions: DataFrame, key: str, label: str, value) -> DataFrame:
    """Rows whose prediction has the given value, matched by key."""
    return df.join(predictions.filter(F.col(label) == value).select(key), key, "left_semi")


def rows_not_predicted(df: DataFrame, predictions: DataFrame, key: str, label: str, value) -> DataFrame:
    return df.join(predictions.filter(F.col(label) == value).select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values replace old ones; unknown keys add rows."""
    values = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in values])
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_new"))
    merged = [F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)
              for c in values]
    return o.join(n, key, "full_outer").select(key, *merged)


def zip_tables(a: DataFrame, b: DataFrame, pos: str) -> DataFrame:
    """Rows side by side by position, cut to the shorter table."""
    return a.join(b, pos, "inner")


def changed_rows(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """Rows whose text differs between two versions; NULL equals NULL."""
    x = a.select(key, F.col(col).alias("before"))
    y = b.select(key, F.col(col).alias("after"))
    return x.join(y, key, "inner").filter(~F.col("before").eqNullSafe(F.col("after")))


def tag_name(tag_id: Column, tags: Sequence[str]) -> Column:
    """Tag by 0-based id; NULL outside the list."""
    names = F.array(*[F.lit(t) for t in tags]).cast(T.ArrayType(T.StringType()))
    return F.get(names, tag_id.cast("int"))


def assign_by_key(template: DataFrame, values: DataFrame, key: str, col: str) -> DataFrame:
    """Set one column of a template from another table, by key and not by row order."""
    base = template.drop(col)
    return base.join(values.select(key, col), key, "left")


def union_rows(*tables: DataFrame) -> DataFrame:
    """Bag union by column name; a column missing in one table is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
