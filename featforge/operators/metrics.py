"""Evaluation of predictions against truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import no_nan
from .ordered import BLOCK_ROWS
from .tags import entity_spans


def accuracy(df: DataFrame, pred: str, truth: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"))


def mean_absolute_error(df: DataFrame, pred: str, truth: str, fold: str | None = None) -> DataFrame:
    """One value, or one per fold."""
    error = F.avg(no_nan(F.abs(F.col(pred) - F.col(truth)))).alias("mae")
    return df.groupBy(fold).agg(error) if fold else df.agg(error)


def mean_of_folds(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("mae").alias("mae"))


def class_scores(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    # Pre-aggregated cells: the later grouping sees at most classes x classes rows.
    cells = df.groupBy(F.col(pred).alias("p"), F.col(truth).alias("y")).agg(
        F.count(F.lit(1)).alias("n"))
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("p") == F.col("y"), n).otherwise(zero)
    both = F.array(
        F.struct(F.col("p").alias("c"), n.alias("predicted"), zero.alias("support"), hit.alias("hit")),
        F.struct(F.col("y").alias("c"), zero.alias("predicted"), n.alias("support"), zero.alias("hit")))
    per = cells.select(F.inline(both)).groupBy("c").agg(
        F.sum("predicted").alias("predicted"), F.sum("support").alias("support"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    return (per.withColumn("precision", F.coalesce(F.try_divide("hit", "predicted"), zero))
            .withColumn("recall", F.coalesce(F.try_divide("hit", "support"), zero))
            .withColumn("f1", F.coalesce(F.try_divide(
                2 * F.col("hit"), F.col("predicted") + F.col("support")), zero))
            .select(F.col("c").alias("class"), "precision", "recall", "f1", "support"))


def weighted_f1(df: DataFrame, pred: str, truth: str) -> DataFrame:
    return class_scores(df, pred, truth).agg(
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def confusion(df: DataFrame, pred: str, truth: str, classes: Sequence | None = None) -> DataFrame:
    """Rows are predictions; with ``classes`` one column per true class, else long form."""
    if classes is None:
        return df.groupBy(pred, truth).agg(F.count(F.lit(1)).alias("n"))
    return (df.groupBy(pred).pivot(truth, list(classes)).agg(F.count(F.lit(1))).na.fill(0))


def entity_scores(df: DataFrame, group: list[str], pos: str, pred: str, truth: str,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Entity-level precision, recall and F1: a hit is the same type, start and end."""
    spans = entity_spans(df.select(*group, pos, F.col(pred).alias("p"), F.col(truth).alias("y")), group, pos, ["p", "y"], block_rows)
    spans = spans.groupBy(*group, "type", "start", "end").agg(
        F.max((F.col("column") == "p").cast("int")).alias("p"),
        F.max((F.col("column") == "y").cast("int")).alias("y"))
    total = spans.agg(F.sum(F.col("p") * F.col("y")).alias("n_hit"), F.sum("p").alias("n_pred"),
                      F.sum("y").alias("n_true"))
    zero = F.lit(0.0)
    return total.select(
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
        F.coalesce("n_true", F.lit(0)).alias("n_true"),
        F.coalesce(F.try_divide("n_hit", "n_pred"), zero).alias("precision"),
        F.coalesce(F.try_divide("n_hit", "n_true"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("n_hit"), F.col("n_pred") + F.col("n_true")), zero).alias("f1"))
