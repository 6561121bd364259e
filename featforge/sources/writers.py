"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header. ``single_file`` is for small final tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_by_label(df: DataFrame, path: str, label: str, mode: str = "errorifexists",
                   max_rows_per_file: int = 5_000_000) -> None:
    """Parquet below ``label=value`` directories.

    Rows stay in the tasks they are in, so a large label is written by many tasks.
    """
    (df.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file)
     .partitionBy(label).parquet(path))


def write_nested(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Array columns stay arrays (CSV would turn them into text)."""
    df.write.mode(mode).parquet(path)


def write_sorted(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """Range-partitioned by key and sorted inside: files in key order."""
    (df.repartitionByRange(key).sortWithinPartitions(key)
     .write.mode(mode).option("header", True).csv(path))
