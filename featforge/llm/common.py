"""What several corpus operators need: fold flags, word patterns, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Runs of anything but the six ASCII white-space characters.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Letters and digits (lower case) and everything beyond ASCII; the second also takes A-Z.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same as a table for ``bytes.translate``: A-Z to a-z, other characters between words to a blank.
PLAIN_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def packed(df: DataFrame, **working: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside working columns, so that no name of the table can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in working.items()])


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: rows (id, component), component the smallest id reachable.

    Every id points to a smaller id it is connected with. In each round the larger neighbours of an id, then all
    smaller ones, are handed the smallest id among them (large star, small star). Edges are distinct pairs, so a
    hub costs one row per neighbour. Ends when a round changes nothing. Loops and NULL ends are ignored; an empty
    list gives no rows.
    """
    links = stored(edges.filter(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        links = stored(small, "edges")
        before, state = state, _state(links)
        if before == state:
            roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, rows: int = 4096) -> DataFrame:
    """Inner join of ``many`` with ``one``, which holds each key once; a key with many rows is not one task.

    Keys with more than ``rows`` rows get a part for each ``rows`` of them: their row of ``one`` is copied to every
    part, their rows of ``many`` are dealt by the hash of ``by``. Their list is at most as long as ``many`` divided by
    ``rows``. NULL keys join with nothing.
    """
    heavy = stored(many.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / rows).alias("_parts"))
                   .filter("_parts > 1"), "heavy")
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = (many.join(heavy, F.col(key) == F.col("_key"), "left")
            .withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_key", "_parts"))
    right = (one.join(heavy, F.col(key) == F.col("_key"), "left")
             .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_key", "_parts"))
    return left.join(right, [key, "_part"]).drop("_part")
