"""Mixing sources to target weights: shares of words, whole copies, and Pareto order sampling for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, packed

#: A source's ranks are cut into so many ranges, and the range with the cut again into so many.
RANGES = 1 << 10
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for NULL."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of an md5; the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size) to (source, sid, source_size, target).

    Sources stand in code point order, NULL last, and weigh ``weights`` in turn. ``share`` times all words is
    dealt out by weight; a target stops at ``most`` times the source's size and the excess goes to the others by
    weight, until none is above. In closed form: by rising (cap / weight), a source is capped when its cap is at
    most its weight times what is left over the weight that is left. The table has one row per source.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    everything = W.partitionBy(F.lit(0))
    t = (sizes.withColumn("w", weigh).withColumn("cap", F.col("source_size") * F.lit(float(most)))
         .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))))
    rising = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    earlier = rising.rowsBetween(W.unboundedPreceding, -1)
    t = (t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
         .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.col("w_left"))
         .withColumn("capped", F.col("cap") <= F.col("w") * F.col("level")))
    # Up to the first source that is not capped the level rises, after it it falls.
    open_level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return t.select("source", F.row_number().over(order).alias("sid"), "source_size",
                    F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * open_level).alias("target"))




def _ranked(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Rows (…, source, k, size, u, w) with their source's figures, certain copies and rank ``q`` in (0, 1).

    q is odds / (1 + odds) of Pareto's ranking number: the odds of the random number over the odds of inclusion.
    """
    joined = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    expected = F.least(F.lit(float(most)), F.col("ratio") * F.col("w"))
    fraction = F.least(F.greatest(F.col("expected") - F.col("certain"), F.lit(1e-9)), F.lit(1 - 1e-9))
    ahead = F.col("u") * (1 - F.col("p"))
    return (joined.withColumn("expected", F.coalesce(expected, F.lit(0.0)))
            .withColumn("certain", F.floor("expected"))
            .withColumn("p", fraction)
            .withColumn("q", ahead / (ahead + F.col("p") * (1 - F.col("u"))))
            .withColumn("open", F.col("certain") < F.lit(int(most))))


def _narrow(docs: DataFrame, key: str, source: str, text: str, weight: str | None, seed: str) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(F.col(key).alias("k"), F.col(source).alias("source"), word_count(text).alias("size"),
                       uniform(F.col(key), seed).alias("u"), w.alias("w"))


def _passing(sums: DataFrame, gaps: DataFrame) -> DataFrame:
    """Word sums (sid, bucket, s) and gaps (sid, gap): the bucket in which the gap is filled, with what is left."""
    upto = F.sum("s").over(W.partitionBy("sid").orderBy("bucket"))
    return (sums.join(gaps, "sid").withColumn("upto", upto)
            .filter((F.col("upto") - F.col("s") < F.col("gap")) & (F.col("gap") <= F.col("upto")))
            .select("sid", "bucket", (F.col("gap") - F.col("upto") + F.col("s")).alias("gap")))


def _sums(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.groupBy("sid", bucket.alias("bucket")).agg(F.sum("size").alias("s"))


def _plan(narrow: DataFrame, weights, share: float, most: float) -> DataFrame:
    """One row per source: (source, sid, source_size, target, ratio, cut, close).

    ``cut`` is the last (q, k) of the sample, ``close`` the one row beyond it that brings the words closest to
    the target, if any does.
    """
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"),
                                         F.sum(F.col("w") * F.col("size")).alias("weighed"))
    dealt = targets(sizes.drop("weighed"), weights, share, most).withColumnRenamed("source", "_s")
    ratio = F.when(F.col("weighed") > 0, F.col("target") / F.col("weighed")).otherwise(F.lit(0.0))
    base = stored(dealt.join(sizes.drop("source_size"), F.col("_s").eqNullSafe(F.col("source")))
                  .select("source", "sid", "source_size", "target", ratio.alias("ratio")), "targets")
    rows = _ranked(narrow, base, most)
    certain = rows.groupBy("sid").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    gaps = stored(base.join(certain, "sid").select("sid", (F.col("target") - F.col("sure")).alias("gap")), "gaps")
    free = rows.filter("open").select("sid", "size", "q", "k")
    coarse, fine = F.floor(F.col("q") * RANGES), F.floor(F.col("q") * (RANGES * RANGES))
    first = stored(_passing(_sums(free, coarse), gaps), "first")
    inside = free.join(first.withColumnRenamed("gap", "rest"), "sid").filter(coarse == F.col("bucket")).drop("bucket", "rest")
    second = stored(_passing(_sums(inside, fine), first.select("sid", "gap")), "second")
    last = free.join(second, "sid").filter(fine == F.col("bucket"))
    upto = F.sum("size").over(W.partitionBy("sid").orderBy("q", "k"))
    last = (last.withColumn("upto", upto).groupBy("sid", "bucket")
            .agg(F.max(F.when(F.col("upto") <= F.col("gap"), F.struct("q", "k"))).alias("cut"),
                 F.first("gap").alias("gap"),
                 F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("got")))
    none = F.struct((F.col("bucket") / F.lit(float(RANGES * RANGES))).alias("q"), F.lit(None).cast(narrow.schema["k"].dataType).alias("k"))
    cuts = stored(last.select("sid", F.coalesce("cut", none).alias("cut"),
                              (F.col("gap") - F.coalesce("got", F.lit(0))).alias("missing")), "cuts")
    beyond = free.join(cuts, "sid").filter(F.struct("q", "k") > F.col("cut"))
    off = F.abs(F.col("size") - F.col("missing"))
    close = (beyond.filter(off < F.col("missing")).groupBy("sid")
             .agg(F.min(F.struct(off.alias("off"), F.col("q"), F.col("k"))).alias("c"))
             .select("sid", F.struct("c.q", "c.k").alias("close")))
    return stored(base.join(gaps, "sid").join(cuts.drop("missing"), "sid", "left").join(close, "sid", "left"), "mix")


def _copies(ranked: DataFrame) -> DataFrame:
    own = F.struct("q", "k")
    chosen = F.col("open") & F.coalesce(
        (own <= F.col("cut")) | own.eqNullSafe(F.col("close")), F.col("gap") > 0)
    return ranked.withColumn("copies", F.coalesce(F.col("certain"), F.lit(0)).cast("long") + F.coalesce(chosen, F.lit(False)).cast("long"))


def allot(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
          share: float = SHARE, most: float = MOST, weight: str | None = None, seed: str = "mix") -> DataFrame:
    """One row per document: (key, source, size, source_size, target, copies, taken).

    Size is the number of words. ``targets`` says how many words each source gives. Inside a source a document
    is expected target / source_size times, or in proportion to the column ``weight``, at most ``most`` times.
    The whole part of that are certain copies; the rest is a Pareto order sample of fixed size, in words: rows
    are ranked by the odds of a random number over the odds of their remaining fraction and taken from the top
    until the target is reached; one more row, whose size is closest to what is then missing, closes the gap.

    The random number is an md5 of the key, so reruns agree and rows that share a key are treated alike. NULL
    text has size 0, NULL source is a source, a NULL key is one key. A source without words takes none. An
    empty table gives no rows. Ranks are never sorted as a whole: words are summed by range of rank, twice, and
    only the rows of one range in a million are put in order.
    """
    narrow = stored(_narrow(docs, key, source, text, weight, seed), "sizes")
    ranked = _copies(_ranked(narrow, _plan(narrow, weights, share, most), most))
    return ranked.select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, weight: str | None = None, seed: str = "mix",
        copies: str = "copies") -> DataFrame:
    """The documents that the mix takes, with all their columns and the number of copies (see ``allot``).

    Texts are not shuffled: each row meets the few figures of its source.
    """
    narrow = stored(_narrow(docs, key, source, text, weight, seed), "sizes")
    plan = _plan(narrow, weights, share, most)
    again = packed(docs, k=F.col(key), source=F.col(source), u=uniform(F.col(key), seed),
                   w=F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)))
    taken = _copies(_ranked(again, plan, most)).filter("copies > 0")
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != copies], F.col("copies").alias(copies))
