"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import packed

#: Leading characters that the second step looks at.
PREFIX = 128
#: So many (length, prefix hash) pairs of 16 bytes at most are sent to every executor.
SMALL_TABLE = 1_000_000


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _crowded(docs: DataFrame, text: str, prefix: int) -> DataFrame:
    """The (length, prefix hash) pairs that at least two rows share; counted before the shuffle."""
    return stored(
        docs.select(F.octet_length(_content(text)).alias("size"),
                    F.xxhash64(F.substring(_content(text), 1, prefix)).alias("head"))
        .groupBy("size", "head").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "crowded")


def _suspects(rows: DataFrame, crowded: DataFrame, prefix: int) -> DataFrame:
    """Rows (…, t) with the flag ``suspect``: another row has this length and prefix.

    The pairs travel to the rows while their number is checked to be small. Beyond that every row counts as a
    suspect, which costs hashing but changes no result; texts are never shuffled to find out.
    """
    if crowded.count() > SMALL_TABLE:
        return rows.withColumn("suspect", F.lit(True))
    keyed = rows.withColumns({"size": F.octet_length("t"), "head": F.xxhash64(F.substring("t", 1, prefix))})
    found = keyed.join(F.broadcast(crowded.withColumn("hit", F.lit(True))), ["size", "head"], "left")
    return found.withColumn("suspect", F.col("hit").isNotNull()).drop("size", "head", "hit")


def _groups(rows: DataFrame) -> DataFrame:
    """Suspect rows (k, t) to groups of equal whole texts."""
    per_key = (rows.filter("suspect").select("k", F.sha2("t", 256).alias("digest"))
               .groupBy("digest", "k").agg(F.count("*").alias("c")))
    return (per_key.groupBy("digest")
            .agg(F.max("k").alias("keep"), F.sum("c").alias("n"),
                 F.max(F.struct("k", "c"))["c"].alias("n_keep"))
            .filter("n > 1"))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """Groups of rows with identical text: (digest, keep, n, n_keep); texts that occur once have no row.

    Rows are grouped by the byte length of the text, inside that by a hash of the leading characters, and only
    where both agree with another row the whole text is hashed (SHA-256, lower-case hex). ``keep`` is the
    largest key of the group, ``n`` its rows, ``n_keep`` those of them with that key (more than one when whole
    rows repeat). NULL text counts as empty. A NULL key is never kept beside another one. An empty table has no
    groups. No step gathers a group: each is a count or a maximum, combined before the shuffle.
    """
    crowded = _crowded(docs, text, prefix)
    return _groups(_suspects(docs.select(F.col(key).alias("k"), _content(text).alias("t")), crowded, prefix))


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per input row: (key, text_sha256, keep_id, group_size, kept, repeated), dropped ones too.

    ``kept`` holds for the row with the largest key of its group. When key and text both repeat, each repeat is
    reported as kept and ``repeated`` is true; ``drop_duplicates`` keeps one of them. Only keys and digests are
    shuffled.
    """
    groups = duplicate_groups(docs, key, text, prefix)
    rows = docs.select(F.col(key).alias("k"), F.sha2(_content(text), 256).alias("d"))
    joined = rows.join(groups, F.col("d") == F.col("digest"), "left")
    alone = F.col("digest").isNull()
    return joined.select(
        F.col("k").alias(key), F.col("d").alias("text_sha256"),
        F.when(alone, F.col("k")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("k").eqNullSafe(F.col("keep"))).alias("kept"),
        (F.coalesce("n_keep", F.lit(1).cast("long")) > 1).alias("repeated"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns: one per distinct text, that with the largest key.

    Rows without a suspect length and prefix pass straight through; only the others meet the groups. Whole rows
    that repeat are reduced to one (which one is not defined if they differ in another column than key and text).
    """
    crowded = _crowded(docs, text, prefix)
    rows = _suspects(packed(docs, k=F.col(key), t=_content(text)), crowded, prefix)
    groups = _groups(_suspects(docs.select(F.col(key).alias("k"), _content(text).alias("t")), crowded, prefix))
    alone = rows.filter(~F.col("suspect")).select("row.*")
    met = (rows.filter("suspect").select("row", "k", F.sha2("t", 256).alias("d"))
           .join(groups, F.col("d") == F.col("digest"), "left")
           .filter(F.col("digest").isNull() | F.col("k").eqNullSafe(F.col("keep"))))
    single = met.filter(F.coalesce("n_keep", F.lit(1)) == 1).select("row.*")
    again = met.filter("n_keep > 1").dropDuplicates(["d"]).select("row.*")
    return alone.union(single).union(again)
