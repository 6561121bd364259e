"""Sources, sinks, joins, cleaning, profiles, stream and models on small rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.functions import columns as C
from featforge.functions import fixed_values as V
from featforge.operators import align, clean, metrics, model, profile
from featforge.session import scratch_path
from featforge.sources import readers, writers
from featforge.streaming import segments as stream


def test_array_files(spark, tmp_path):
    a = np.arange(12, dtype="float32").reshape(4, 3)
    os.makedirs(tmp_path / "sub")
    np.save(tmp_path / "s1.v2.npy", a)
    np.save(tmp_path / "sub" / "flat.npy", np.array([5, 6]))
    (tmp_path / "note.txt").write_text("x")
    got = readers.read_array_files(spark, str(tmp_path)).collect()
    wide = {(r["t"], r["channel"]): r["value"] for r in got if r["id"] == "s1.v2"}
    assert wide == {(i, j): float(a[i, j]) for i in range(4) for j in range(3)}
    assert sorted((r["t"], r["channel"], r["value"]) for r in got if r["id"] == "flat") == [(0, 0, 5.0), (1, 0, 6.0)]


def test_image_manifest_files(spark, tmp_path):
    os.makedirs(tmp_path / "images"), os.makedirs(tmp_path / "labels")
    for n in ("a.jpg", "b.v1.jpg", "c.png"):
        (tmp_path / "images" / n).write_bytes(b"12345")
    (tmp_path / "labels" / "b.txt").write_text("1")
    got = readers.read_image_manifest(spark, str(tmp_path / "images"), str(tmp_path / "labels"))
    assert sorted(map(tuple, got.select("file_name", "length", "class").collect())) == [("a.jpg", 5, 0), ("b.v1.jpg", 5, 1)]
    test = readers.read_image_manifest(spark, str(tmp_path / "images"))
    assert [r["class"] for r in test.collect()] == [0, 0]


def test_csv_files(spark, tmp_path):
    for n, rows in (("x.csv", "a,ค่า\n1,\n2,b\n"), ("y.csv", "a,ค่า\n3,c\n")):
        (tmp_path / n).write_text(rows, encoding="utf-8")
    df = readers.read_csv_files(spark, str(tmp_path), "a int, `ค่า` string")
    got = sorted((r["a"], r["ค่า"], r[readers.SOURCE].rsplit("/", 1)[1]) for r in df.collect())
    assert got == [(1, None, "x.csv"), (2, "b", "x.csv"), (3, "c", "y.csv")]
    assert readers.read_csv(spark, str(tmp_path)).schema["a"].dataType.simpleString() == "int"
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "swapped.csv").write_text("b,a\nx,1\n", encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        readers.read_csv_files(spark, str(tmp_path / "z"), "a int, b string").collect()
    assert C.missing_codes_to_null(df, (2,)).filter("a is null").count() == 1


def test_writers(spark):
    path = scratch_path(spark, "test")
    df = spark.range(100).select("id", (F.col("id") % 3).alias("label"))
    writers.write_by_label(df, f"{path}/l", "label")
    assert readers.read_by_label(spark, f"{path}/l").filter("label = 1").count() == 33
    writers.write_sorted(df.repartition(4), f"{path}/s", "id")
    assert readers.read_csv(spark, f"{path}/s", "id long, label long").count() == 100
    writers.write_csv(df, f"{path}/one", single_file=True)
    assert len(spark.read.csv(f"{path}/one").inputFiles()) == 1


def test_missing_codes(spark):
    df = spark.createDataFrame([(888, "888", 999.0, True), (1, "x", None, None), (None, None, 2.5, False)],
                               "i int, s string, d double, b boolean")
    got = [tuple(r) for r in C.missing_codes_to_null(df).collect()]
    assert got == [(None, None, None, True), (1, "x", None, None), (None, None, 2.5, False)]


def test_columns(spark):
    df = spark.createDataFrame([("DEF", 1), ("odd", 2), (None, 3)], "c string, n int")
    yes, no = C.split_on_value(df, "c", "DEF")
    assert (yes.count(), no.count()) == (1, 2)
    assert [r[0] for r in df.select(C.encode(F.col("c"), V.FOREST_CODES)).collect()] == [2, None, None]
    assert [tuple(r) for r in C.unknown_codes(df, "c", V.FOREST_CODES).collect()] == [("odd", 1)]
    with pytest.raises(ValueError):
        C.drop_columns(df, ["nope"])
    codes = spark.createDataFrame([([110, 150, 7],)], "a array<int>")
    assert codes.select(C.encode_array(F.col("a"), V.IMAGERY_CODES).alias("x")).first()["x"] == [0, 2, None]
    names = spark.createDataFrame([("s1_d2_p002_002_data_time_series.npy",), ("readme",)], "n string")
    got = [r[0] for r in names.select(C.recording_name_parts(F.col("n"))).collect()]
    assert tuple(got[0]) == ("s1_d2_p002_002", "s1_d2_p002", "002", "data", "series") and got[1] is None
    t = spark.createDataFrame([("2023-07-09 13:05:00",), ("bad",)], "t string")
    assert [tuple(r) for r in t.select(*C.date_parts(F.col("t"))).collect()] == [(7, 9, 13), (None, None, None)]
    ints = spark.createDataFrame([(" 12 ",), ("x",), ("1.5",), (None,)], "t string")
    assert [r[0] for r in ints.select(C.text_to_int(F.col("t"))).collect()] == [12, None, None, None]


def test_ratio_indices_guards(spark):
    df = spark.createDataFrame([(0.0,) * 7, (0.1, 0.2, 0.5, 0.4, 0.1, 0.3, 0.2)], "b2 double, b3 double, b4 double, b5 double, b8 double, b11 double, b12 double")
    cols = C.ratio_indices({b: F.col(b) for b in df.columns}, extended=True)
    zero, row = df.select(*cols).collect()
    assert zero["NDVI"] is None and zero["MCARI"] is None and zero["TVI"] == 0.0 and zero["MSAVI"] == 0.0
    assert row["TVI"] is None and row["NDVI"] == pytest.approx(-0.4 / 0.6) and row["RVI"] == pytest.approx(0.2)
    assert not any(isinstance(v, float) and v != v for r in (zero, row) for v in r)


def test_joins(spark):
    template = spark.createDataFrame([("a_1",), ("a_2",), ("a_2",)], "id string")
    pred = spark.createDataFrame([("a_2", "x"), ("a_9", "y")], "id string, name string")
    assert sorted(map(tuple, align.fill_template(template, pred, "id").collect())) == [("a_1", ""), ("a_2", "x"), ("a_2", "x")]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, align.upsert(old, new, "k").collect())) == [(1, "a"), (2, None), (3, "c")]
    changed = align.changed_rows(old, new.union(old.filter("k = 1")), "k", "v").collect()
    assert [tuple(r) for r in changed] == [(2, "b", None)]
    with pytest.raises(Exception, match="no code for b"):
        align.lookup_strict(old, spark.createDataFrame([("a", 1)], "v string, c int"), "v", "c").collect()
    files = spark.createDataFrame([("r1", "s", "p1"), ("r1", "s", "p0"), ("r2", "t", "p2")], "id string, kind string, path string")
    got = sorted(map(tuple, align.manifest(files, "id", "kind", "path", {"s": "series", "t": "stamps"}).collect()))
    assert got == [("r1", "p0", None, 1), ("r2", None, "p2", 0)]
    assert align.lookup_default(pred.withColumnRenamed("name", "v"), old, "v", "k", "0").count() == 2


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a")], "x double, s string")
    assert {r["column"]: r["n_null"] for r in profile.null_counts(df).collect()} == {"x": 2, "s": 1}
    assert {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df, ["s"]).collect()} == {"s": 2}
    assert {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df, ["s"], approximate=True).collect()} == {"s": 2}
    assert [tuple(r) for r in profile.value_counts(df, ["s"]).collect()] == [("s", "a", 2)]
    assert [tuple(r) for r in profile.value_counts(df, ["x"]).collect()] == [("x", "1.0", 1)]
    assert [tuple(r) for r in profile.distinct_counts(df, ["x"]).collect()] == [("x", 2)]
    assert [tuple(r)[1:5] for r in profile.describe(df, ["x"]).collect()] == [(1, 1.0, None, 1.0)]
    assert [r["x"] for r in clean.fill_means(df, ["x"]).collect()] == [1.0, 1.0, 1.0]
    assert profile.moments(df, ["x"]).first()["x_mean"] == 1.0
    got = profile.describe(spark.range(1, 102).select(F.col("id").cast("double").alias("v"))).first()
    assert (got["q25"], got["q50"], got["q75"], got["count"]) == (26.0, 51.0, 76.0, 101)
    near = profile.describe(spark.range(1, 102), approximate=True).first()
    assert abs(near["q50"] - 51) <= 1
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "word string")
    assert sorted(map(tuple, profile.vocabulary(words).collect())) == [("a", 1, 1), ("b", 2, 2)]


def test_filling(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    assert [r["v"] for r in clean.fill_means(df, ["v"]).orderBy("k").collect()] == [1.0, 2.0, 3.0]
    assert [r["v"] for r in clean.fill_means(df, ["v"], df.filter("k = 3")).orderBy("k").collect()] == [1.0, 3.0, 3.0]
    good, bad = clean.quarantine(df, {"missing": F.col("v").isNull(), "large": F.col("v") > 2})
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["large", "missing"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "p string, y string")
    assert metrics.accuracy(df, "p", "y").first()[0] == 0.5
    s = {r["class"]: r for r in metrics.class_scores(df, "p", "y").collect()}
    assert s["c"]["precision"] == 0.0 and s["c"]["support"] == 0 and s["b"]["recall"] == pytest.approx(1 / 3)
    assert metrics.weighted_f1(df, "p", "y").first()[0] == pytest.approx((2 / 3 * 1 + 0.5 * 3) / 4)
    m = {r["p"]: (r["a"], r["b"]) for r in metrics.confusion(df, "p", "y", ["a", "b"]).collect()}
    assert m == {"a": (1, 1), "b": (0, 1), "c": (0, 1)}


def test_stream_equals_batch_and_drops_late_rows(spark):
    path = scratch_path(spark, "stream-test")
    def batch(rows, n):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k, float(v)) for s, k, v in rows],
                              "ts timestamp, k string, v double").coalesce(1).write.parquet(f"{path}/in/{n}")
    batch([(1, "a", 1), (2, "a", 3), (31, "b", 5)], 0)
    schema = spark.read.parquet(f"{path}/in/0").schema
    def run():
        rows = stream.read_stream(spark, f"{path}/in/*", schema)
        stats = stream.window_statistics(rows, "ts", ["k"], "v", "30 seconds", "10 seconds")
        stream.write_available(stats, f"{path}/out", f"{path}/state", timeout=120)
    run()
    batch([(200, "a", 7)], 1)
    run()
    batch([(3, "a", 100), (400, "a", 1)], 2)  # the first row comes after its window was closed
    run()
    got = {(r["k"], int(r["window_start"].timestamp())): (r["n"], r["mean"]) for r in spark.read.parquet(f"{path}/out").collect()}
    whole = spark.read.parquet(f"{path}/in/0", f"{path}/in/1")
    want = {(r["k"], int(r["window_start"].timestamp())): (r["n"], r["mean"])
            for r in stream.window_statistics(whole, "ts", ["k"], "v", "30 seconds").collect()}
    assert got == want and len(got) == 3


def test_updated_windows_equal_batch(spark):
    path = scratch_path(spark, "stream-update")
    def batch(rows, n):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k, float(v)) for s, k, v in rows],
                              "ts timestamp, k string, v double").coalesce(1).write.parquet(f"{path}/in/{n}")
    batch([(1, "a", 1), (2, "a", 3), (31, "b", 5)], 0)
    batch([(3, "a", 7), (40, "b", 7), (400, "a", 1)], 1)
    whole = spark.read.parquet(f"{path}/in/0", f"{path}/in/1")
    rows = stream.read_stream(spark, f"{path}/in/*", whole.schema, files_per_trigger=1)
    stats = stream.window_statistics(rows, "ts", ["k"], "v", "30 seconds", "10 minutes")
    stream.write_latest(stats, f"{path}/out", f"{path}/state", timeout=120)
    got = stream.latest(spark.read.parquet(f"{path}/out"), ["k", "window_start"])
    want = stream.window_statistics(whole, "ts", ["k"], "v", "30 seconds")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 3


def test_cascade_refuses_other_classes(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    first = spark.createDataFrame([(1, "en"), (2, "xx")], "k int, prediction string")
    with pytest.raises(Exception, match="neither class: xx"):
        model.cascade(df, first, "k", "en", "rest", lambda rows: rows.withColumn("prediction", F.lit("de"))).collect()


def test_gaps_in_features(spark):
    rows = [(float(i), None if i % 7 == 0 else float(i % 5), "a" if i < 50 else "b") for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, c string")
    for kind in ("forest", "logistic"):
        out = model.predict(model.classifier(["x", "y"], "c", kind, trees=5, depth=3).fit(df), df)
        assert metrics.accuracy(out, "prediction", "c").first()[0] > 0.9 and set(out.columns) == {"x", "y", "c", "prediction", "confidence"}


def test_model_quality_floor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang", *model.text_ratios(F.col("text")))
    names = [c for c in rows.columns if c.startswith("r_")]
    train, test = rows.filter("doc_id % 4 <> 0"), rows.filter("doc_id % 4 = 0")
    fitted = model.classifier(names, "lang", trees=10, depth=6).fit(train)
    assert metrics.accuracy(model.predict(fitted, test), "prediction", "lang").first()[0] > 0.85
    importance = model.permutation_importance(lambda d: model.predict(fitted, d), train.limit(200), "doc_id", names, "lang", repeats=2).collect()
    assert len(importance) == len(names) and max(r["importance"] for r in importance) > 0.05
    assert sum(model.model_importance(fitted, names).values()) == pytest.approx(1.0)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 257, 1000])
def test_every_row_gives_once(spark, n):
    """A bijection for every size, another one for another key."""
    rows = spark.range(n).withColumnRenamed("id", "_at")
    found = [r[0] for r in rows.select(model.permuted(F.col("_at"), n, "a")).collect()]
    assert sorted(found) == list(range(n))
    if n > 16:
        other = [r[0] for r in rows.select(model.permuted(F.col("_at"), n, "b")).collect()]
        assert found != other and sum(i == x for i, x in enumerate(found)) < 10


def test_halving_keeps_the_best_and_sees_all_rows(spark):
    """Candidates that learn nothing but the rows' number: who goes on, and on which rows."""
    seen = {}

    def candidate(name, wrong):
        def fit(rows):
            seen.setdefault(name, []).append({r["k"] for r in rows.collect()})
            return lambda df: df.withColumn("prediction", F.when(F.col("k") % 10 < wrong, "no").otherwise(F.col("y")))
        return model.Candidate(name, fit)

    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("yes").alias("y"))
    train, valid = df.filter("k < 800"), df.filter("k >= 800")
    scores, chosen = model.successive_halving(train, valid, [candidate(f"c{w}", w) for w in (5, 3, 1, 4, 2)], "k", "y", 0.2)
    with pytest.raises(ValueError, match="repeat"):
        model.successive_halving(train, valid, [candidate("c", 1)] * 2, "k", "y")
    assert chosen.name == "c1" and max(seen["c1"], key=len) == set(range(800))
    got = {(r["rung"], r["name"]): (r["n_valid"], r["n_right"]) for r in scores.collect()}
    assert got[(1, "c5")] == (200, 100) and got[(1, "c3")] == (200, 140) and (2, "c5") not in got
    sizes = sorted(seen["c1"], key=len)
    assert all(a <= b for a, b in zip(sizes, sizes[1:]))
    model.refit(chosen, train, valid)
    assert len(seen["c1"][-1]) == 1000


def test_regression_beats_the_mean(spark):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_retailprice")
    train, test = part.filter("p_partkey % 4 <> 0"), part.filter("p_partkey % 4 = 0")
    out = model.blended_regression(train, test, ["p_partkey"], "p_retailprice", trees=10)
    mean = train.agg(F.avg("p_retailprice")).first()[0]
    mae = metrics.mean_absolute_error(out, "prediction", "p_retailprice").first()[0]
    base = metrics.mean_absolute_error(out.withColumn("m", F.lit(mean)), "m", "p_retailprice").first()[0]
    assert mae < 0.8 * base


def test_sketches_merge_to_the_profile_of_the_whole(spark):
    """Parts of any size, empty and missing ones included, give the figures of all rows."""
    from featforge.operators import profile

    rows = [(i % 3, float(i), None if i % 5 == 0 else float(i % 10), None) for i in range(9000)] + [(3, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "part int, x double, y double, z double")
    parts = [profile.sketches(df.filter(F.col("part") == p), ["x", "y", "z"]) for p in (0, 1, 2, 3, 4)]
    got = {r["column"]: r for r in profile.sketch_profile(profile.merged_sketches(parts)).collect()}
    assert (got["x"]["count"], got["x"]["n_missing"], got["x"]["min"], got["x"]["max"]) == (9000, 1, 0.0, 8999.0)
    assert got["x"]["mean"] == pytest.approx(4499.5) and got["x"]["std"] == pytest.approx(2598.2206)
    assert all(abs(q - p * 9000) < 180 for q, p in zip(got["x"]["quantiles"], (0.25, 0.5, 0.75)))
    assert abs(got["x"]["n_distinct"] - 9000) < 450 and got["y"]["n_distinct"] == 8
    assert (got["z"]["count"], got["z"]["n_missing"], got["z"]["quantiles"], got["z"]["n_distinct"]) == (0, 9001, None, 0)
    by_part = profile.merged_sketches([profile.sketches(df, ["x"], by=["part"])])
    assert profile.sketch_profile(by_part).first()["count"] == 9000
