"""Segment statistics on a stream of sensor rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def window_statistics(df: DataFrame, time: str, keys: Sequence[str], value: str, length: str,
                      delay: str | None = None) -> DataFrame:
    """Count, mean, sample std and var per time window and key.

    The same plan for a batch and for a stream. With ``delay`` the table gets a
    watermark: rows later than that are dropped, and append mode emits each window
    once it can no longer change.
    """
    if delay:
        df = df.withWatermark(time, delay)
    return (df.groupBy(F.window(time, length).alias("_w"), *keys)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                 F.stddev_samp(value).alias("std"), F.var_samp(value).alias("var"))
            .select(*keys, F.col("_w.start").alias("window_start"), "n", "mean", "std", "var"))


def without_duplicates(df: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Rows of a stream whose keys have not come before within ``delay`` of event time; state is kept no longer."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def late_rows(df: DataFrame, time: str, batch: str, length: str, delay: str) -> DataFrame:
    """The rows that ``window_statistics`` drops in append mode when rows arrive in the batches that ``batch`` numbers.

    A batch's watermark is the greatest time of all earlier batches less ``delay``; a row is late when its window ends
    at or before it. A batch is what one run of ``write_available`` reads; inside a run of several micro-batches the
    mark lags by one more. For checking a stream against its input; there is one figure for each batch.
    """
    greatest = df.groupBy(F.col(batch).alias("_b")).agg(F.max(time).alias("_t"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = greatest.select("_b", (F.max("_t").over(earlier) - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    end = F.window(F.col(time), length)["end"]
    return df.join(marks, F.col(batch) == F.col("_b")).filter(end <= F.col("_mark")).drop("_b", "_mark")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None,
                pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                    timeout: int | None = None) -> None:
    """Run the stream over all data present and stop; restarts continue from ``checkpoint``.

    Raises if the data are not read through within ``timeout`` seconds.
    """
    query = (df.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _finish(query, timeout)


def write_latest(df: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Like ``write_available`` for results that still change: every batch writes what it updated, with its number.

    The last version of each row (see ``latest``) equals the batch result, windows that are still open included.
    """
    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (df.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _finish(query, timeout)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each row of a table from ``write_latest``."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")


def _finish(query, timeout: int | None) -> None:
    done = query.awaitTermination(timeout)
    if timeout is not None and not done:
        query.stop()
        raise TimeoutError(f"the stream has not read all data within {timeout} s")
