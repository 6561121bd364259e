"""Two-level windows equal plain loops when groups are cut into small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featforge.operators import clean, profile, sequence
from featforge.operators.ordered import dense_position, in_order


def groups(df):
    pdf = df.toPandas()
    pdf["g"] = pdf["g"].where(pdf["g"].notna(), "none")
    return {k: p.sort_values(["ts", "id"]) for k, p in pdf.groupby("g")}


@pytest.fixture(params=[1, 8, 40])
def blocks(request, spark):
    """So many range partitions, whatever the size of the table."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dense_position(skewed, blocks):
    got = dense_position(skewed, ["g"], ["ts", "id"], "pos")
    for part in groups(got).values():
        assert part["pos"].tolist() == list(range(len(part)))


def test_blocks_are_even_and_in_order(skewed, blocks):
    placed = in_order(skewed, ["g"], ["ts", "id"]).orderBy("_place").toPandas()
    assert placed["_block"].is_monotonic_increasing and placed["_block"].nunique() == blocks
    assert placed.groupby("_block").size().max() <= 3 * len(placed) / blocks + 5
    want = placed.sort_values(["g", "ts", "id"], na_position="first", kind="stable")
    assert placed["id"].tolist() == want["id"].tolist()


def test_rows_without_order_value_come_first(spark, blocks):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"),
                                 F.when(F.col("id") % 7 != 0, F.col("id")).alias("ts"))
    got = dense_position(df, ["g"], ["ts", "id"], "pos").toPandas()
    assert len(got) == 300
    for _, part in got.groupby("g"):
        want = part.sort_values(["ts", "id"], na_position="first")
        assert want["pos"].tolist() == list(range(len(part)))


def test_keys_that_are_hard_to_cut(spark, blocks):
    """Bursts, a long common prefix, NaN and NULL keys, equal leading values: all spread over the blocks."""
    n = F.col("id")
    late = spark.range(2000).select(F.lit("g").alias("g"), "id", F.when(n < 10, n * 10**9).otherwise(10**10 + n).alias("ts"))
    words = spark.range(2000).select("id", F.concat(F.lit("https://example.org/a/very/long/common/way/"), F.lpad(n.cast("string"), 6, "0")).alias("word"))
    numbers = spark.range(2000).select(F.lit(None).cast("string").alias("g"), "id", F.when(n == 5, F.lit(float("nan"))).when(n != 7, n.cast("double")).alias("ts"))
    equal = spark.range(2000).select(F.lit(1).alias("g"), F.lit(3).alias("ts"), "id")
    for df, group, order in ((late, ["g"], ["ts"]), (words, [], ["word"]), (numbers, ["g"], ["ts", "id"]), (equal, ["g"], ["ts", "id"])):
        placed = in_order(df, group, order)
        assert placed.groupBy("_block").count().agg(F.max("count")).first()[0] <= 3 * 2000 / blocks
        got = dense_position(df, group, order, "pos").orderBy("pos").toPandas()
        assert got["pos"].tolist() == list(range(2000))
        if order != ["ts", "id"] or df is equal:
            assert got[order[-1]].tolist() == sorted(got[order[-1]])
        elif df is numbers:
            assert got["id"].tolist() == [7, *[i for i in range(2000) if i not in (5, 7)], 5]


@pytest.mark.parametrize("lead", ["id", "word"])
def test_global_position(spark, lead, blocks):
    df = spark.range(200).select("id", F.concat(F.lit("/data/x"), F.col("id").cast("string")).alias("word"))
    got = dense_position(df, [], [lead], "pos").orderBy("pos").toPandas()
    assert got["pos"].tolist() == list(range(200))
    assert got[lead].tolist() == sorted(got[lead].tolist())


def test_no_rows(spark, blocks):
    df = spark.createDataFrame([], "g string, ts long")
    assert dense_position(df, ["g"], ["ts"]).count() == 0
    assert clean.interpolate(df.withColumn("v", F.lit(1.0)), ["g"], ["ts"], "v").count() == 0


def test_interpolate(skewed, blocks):
    with_nan = skewed.withColumn("v", F.when(F.col("v").isNull() & (F.col("id") % 2 == 0), F.lit(float("nan"))).otherwise(F.col("v")))
    got = groups(clean.interpolate(with_nan, ["g"], ["ts", "id"], "v", "filled"))
    for part in got.values():
        want = part["v"].astype("float64").reset_index(drop=True).interpolate()
        np.testing.assert_allclose(part["filled"].astype("float64"), want, atol=1e-9)


def test_interpolate_edges(spark):
    rows = [(0, "a", None), (1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (4, "a", None), (0, "b", None), (1, "b", None)]
    df = spark.createDataFrame(rows, "t int, g string, v double")
    got = clean.interpolate(df, ["g"], ["t"], "v").orderBy("g", "t").collect()
    assert [r["v"] for r in got] == [None, 1.0, 2.0, 3.0, 3.0, None, None]


def test_running_mean(skewed, blocks):
    for part in groups(profile.running_mean(skewed, ["g"], ["ts", "id"], "v")).values():
        want = part["v"].astype("float64").expanding().mean()
        np.testing.assert_allclose(part["running_mean"].astype("float64"), want, atol=1e-9)


@pytest.mark.parametrize("size", [5, 13, 1 << 20])
def test_sliding_windows(skewed, size):
    placed = dense_position(skewed, ["g"], ["ts", "id"], "pos")
    frames = sequence.sliding_windows(placed, ["g"], "pos", "v", 10, size).toPandas()
    frames["g"] = frames["g"].where(frames["g"].notna(), "none")
    for name, part in groups(placed).items():
        mine = frames[frames["g"] == name].sort_values("frame")
        values = [None if pd.isna(v) else v for v in part["v"]]
        want = [values[i:i + 10] for i in range(max(0, len(values) - 10))]
        assert [[None if pd.isna(v) else v for v in w] for w in mine["window"]] == want


def test_segments_round_trip(skewed, blocks):
    segs = sequence.segment_rows(skewed, ["g"], ["ts", "id"], 32)
    back = sequence.pack(segs, ["g", "seg"], "t", "id").toPandas()
    back["g"] = back["g"].where(back["g"].notna(), "none")
    for name, part in groups(skewed).items():
        joined = sum((list(s) for s in back[back["g"] == name].sort_values("seg")["series"]), [])
        assert joined == part["id"].tolist()


def test_running_segment_ids(spark, blocks):
    rows = [(f"f{f}.csv", i) for f in (1, 9, 10) for i in range(5)]
    df = spark.createDataFrame(rows, "file string, i int")
    segs = sequence.segment_rows(df, ["file"], ["i"], 2)
    got = sequence.running_segment_ids(segs, "file", 2).orderBy("file", "i").collect()
    assert [r["segment_id"] for r in got] == [0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 6, 6, 7, 7, 8]
    assert [r["file"] for r in got][0::5] == ["f1.csv", "f10.csv", "f9.csv"]
    unnamed = spark.createDataFrame([*rows, (None, 0), (None, 1), (None, 2)], "file string, i int")
    segs = sequence.segment_rows(unnamed, ["file"], ["i"], 2)
    got = sequence.running_segment_ids(segs, "file", 2).orderBy("file", "i").collect()
    assert [r["segment_id"] for r in got][:5] == [0, 0, 1, 2, 2]


def test_frames_equal_slices(spark):
    df = spark.range(37).select(F.lit(1).alias("g"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    for size, hop in ((16, 8), (16, 14), (8, 8), (4, 6)):
        got = sequence.overlapping_frames(df, ["g"], "pos", "v", size, hop).orderBy("frame").collect()
        want = [list(map(float, range(s, s + size))) for s in range(0, 37 - size + 1, hop)]
        assert [r["window"] for r in got] == want, (size, hop)


def test_z_scores_constant_group(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, None)], "g int, v double")
    got = sequence.z_scores(df, ["g"], "v").orderBy("g", "v").collect()
    assert [r["z"] for r in got] == [0.0, 0.0, None, -1.0, 1.0]
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, float("nan"))], "g int, v double")
    got = sequence.z_scores(df, ["g"], "v").orderBy("g", "v").collect()
    assert [r["z"] for r in got] == [-1.0, 1.0, None]


def test_missing_values_in_frames(spark):
    df = spark.createDataFrame([(1, i, None if i == 2 else float(i)) for i in range(6)], "g int, pos long, v double")
    got = sequence.overlapping_frames(df, ["g"], "pos", "v", 4, 2).orderBy("frame").collect()
    assert [r["window"] for r in got] == [[0.0, 1.0, None, 3.0], [None, 3.0, 4.0, 5.0]]
    got = sequence.overlapping_frames(df, ["g"], "pos", "v", 4, 2, zero_edges=True).orderBy("frame").collect()
    assert got[0]["window"] == [0.0, 0.0, 0.0, 1.0] and got[1]["window"] == [0.0, 1.0, None, 3.0]


@pytest.mark.parametrize("direct", [10, 100, 1 << 20])
def test_exact_quantiles(spark, direct):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=3000), "b": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 30, 3000))})
    got = profile.exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], (0.0, 0.25, 0.5, 0.9, 1.0), direct)
    for c in "ab":
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], [0, 0.25, 0.5, 0.9, 1]), atol=1e-9)
