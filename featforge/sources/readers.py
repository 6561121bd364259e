"""Reading tables, file sets, line files and array files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, blank_to_mark, extension, lines, matches, stem, strip_line
from ..operators.align import exists_flag
from ..operators.ordered import dense_position
from .named_files import list_files

SOURCE = "source_file"


def read_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    """CSV with a header. Empty fields are NULL. Without a schema it is inferred (slow)."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_csv_files(spark: SparkSession, path, schema, recursive: bool = False) -> DataFrame:
    """Many CSV files as one table; the file path of each row is ``source_file``.

    The header of every file must name the columns of the schema in its order; another order is an error, so
    that no column is read under a wrong name.
    """
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("recursiveFileLookup", recursive).csv(path)
            .withColumn(SOURCE, F.col("_metadata.file_path")))


def directory_value(path: Column, levels_up: int = 1) -> Column:
    """Name of a directory above the file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-1 - levels_up))


def read_by_label(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet below ``label=value`` directories; the value returns as a column."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def line_table(texts: DataFrame, key: str, text: str, drop_last: bool = False,
               mark_blank: bool = True) -> DataFrame:
    """One row per line with its number, trimmed, blank lines marked."""
    out = texts.select(key, F.posexplode(lines(F.col(text), drop_last)).alias("pos", "word"))
    word = strip_line(F.col("word"))
    return out.withColumn("word", blank_to_mark(word) if mark_blank else word)


def read_lines(spark: SparkSession, path, drop_last: bool = False, by_folder: bool = False) -> DataFrame:
    """Line files to rows (source_file, pos, word), as ``line_table`` gives for whole texts.

    Files are split like any text; lines are put in order by file, by the start of their split and by their
    place in it, so a file of any size is numbered without being one row or one task. A file that ends with a
    line feed has an empty last line. With ``by_folder`` the lines of a folder are numbered through its files in the
    order of their names, and ``source_file`` is still the file.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_block_start").alias("_start"),
        (F.monotonically_increasing_id() * 2).alias("_line"), F.col("_metadata.file_size").alias("_size"), "value")
    folder = F.regexp_replace(SOURCE, "/[^/]*$", "") if by_folder else F.col(SOURCE)
    rows = rows.withColumn("_sequence", folder)
    ends = rows.groupBy("_sequence", SOURCE, "_size").agg(
        F.max(F.struct("_start", "_line")).alias("_last"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    open_end = F.col("_bytes") > F.col("_size")  # the last line has no line feed
    if drop_last:
        last = ends.filter(open_end).select(SOURCE, F.col("_last._start").alias("_start"), F.col("_last._line").alias("_line"))
        rows = rows.join(last, [SOURCE, "_start", "_line"], "left_anti")
    else:
        rows = rows.unionByName(ends.filter(~open_end).select(
            SOURCE, F.col("_last._start").alias("_start"), (F.col("_last._line") + 1).alias("_line"), "_size", F.lit("").alias("value"), "_sequence"))
    placed = dense_position(rows, ["_sequence"], [SOURCE, "_start", "_line"], "pos")
    return placed.select(SOURCE, "pos", blank_to_mark(strip_line(F.col("value"))).alias("word"))


def decode_arrays(files: DataFrame) -> DataFrame:
    """Rows (id, t, channel, value) of binary array files with columns path and content.

    The id is the file name without extension. One file is decoded at a time.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                matrix = array.reshape(len(array), -1) if array.ndim else array.reshape(1, 1)
                rows, cols = matrix.shape
                name = path.rsplit("/", 1)[-1]
                yield pd.DataFrame({
                    "id": name.rsplit(".", 1)[0],
                    "t": np.repeat(np.arange(rows), cols),
                    "channel": np.tile(np.arange(cols), rows).astype("int32"),
                    "value": matrix.astype("float64").ravel()})

    return files.select("path", "content").mapInPandas(
        decode, "id string, t long, channel int, value double")


def read_array_files(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    return decode_arrays(spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                         .option("recursiveFileLookup", True).load(path))


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table with array columns."""
    return spark.read.parquet(path)


def image_manifest(files: DataFrame, label_files: DataFrame | None, path: str = "path",
                   separator: str = "/") -> DataFrame:
    """One row per image file: name, byte length, and 1 when a label file of its stem exists.

    Without label files (a test set) the flag is 0 everywhere.
    """
    name = base_name(F.col(path), separator)
    images = files.select(name.alias("file_name"), stem(name).alias("stem"), "length")
    if label_files is None:
        return images.withColumn("class", F.lit(0)).drop("stem")
    known = label_files.select(stem(base_name(F.col(path), separator)).alias("stem"))
    return exists_flag(images, known, "stem").drop("stem")


def read_image_manifest(spark: SparkSession, images: str, labels: str | None = None,
                        pattern: str = "*.jpg", recursive: bool = False) -> DataFrame:
    """Manifest of a folder, with ``recursive`` of those below it, too; tasks list the files and open none."""
    def listing(folder: str, glob: str) -> DataFrame:
        return list_files(spark, folder, recursive).filter(matches(F.col("name"), glob)).select("path", "length")

    return image_manifest(listing(images, pattern), listing(labels, "*.txt") if labels else None)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key before CPU-bound work: a file may hold one split, however many cores there are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def table_of(spark: SparkSession, rows, schema) -> DataFrame:
    """A small in-memory table."""
    return spark.createDataFrame(rows, schema)
