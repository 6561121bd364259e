import numpy as np
import pytest
from pyspark.sql import functions as F

from featforge.operators import balance, search, split


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    rows[5] = (5, rows[2][1])       # a tie between gallery rows
    rows[60] = (60, [0.0] * 4)      # no direction
    return rows, spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("tile_bytes", [1 << 20, 100])
def test_top_match(vectors, tile_bytes):
    rows, df = vectors
    gallery, probes = df.filter("id < 20"), df.filter("id >= 20")
    got = {r["id"]: r for r in search.top_match(
        probes, gallery, "id", "id", "v", 0.75, tile_bytes=tile_bytes).collect()}
    g = {i: np.array(v) for i, v in rows[:20] if np.any(v)}
    assert len(got) == 130
    for i, v in rows[20:]:
        v = np.array(v)
        if not v.any():
            assert got[i]["idx"] is None and got[i]["class"] == 20
            continue
        sims = {k: round(float(x @ v / np.sqrt((x @ x) * (v @ v))), 9) for k, x in g.items()}
        best = max(sims.values())
        want = min(k for k, s in sims.items() if s == best)
        assert got[i]["idx"] == want and got[i]["sim"] == pytest.approx(best)
        assert got[i]["class"] == (want if best >= 0.75 else 20)


@pytest.mark.parametrize("tile_bytes", [1 << 20, 16])
def test_top_match_of_odd_rows(spark, tile_bytes):
    """NULL and repeated probe ids keep their rows; sparse, NULL and short gallery vectors; an empty gallery."""
    probes = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [1.0, 0.1]), (7, [0.1, 1.0]), (8, None), (9, [1.0])], "id long, v array<double>")
    gallery = spark.createDataFrame([(10**12, [2.0, 0.0]), (3, [0.0, 5.0]), (None, [1.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<double>")
    got = sorted(map(str, search.top_match(probes, gallery, "id", "id", "v", 0.5, tile_bytes=tile_bytes).select("id", "idx", "class").collect()))
    want = [(None, 10**12), (None, 3), (7, 10**12), (7, 3), (8, None), (9, None)]
    assert got == sorted(f"Row(id={i}, idx={x}, class={x if x is not None else 5})" for i, x in want)
    assert {r["class"] for r in search.top_match(probes, gallery.limit(0), "id", "id", "v").collect()} == {0}


def test_tiles_out_of_reach_are_skipped(spark, monkeypatch):
    """Probes and gallery in five directions: a block meets the tiles of its own, and the result is that of all pairs."""
    rng = np.random.default_rng(6)
    centres = np.linalg.qr(rng.normal(size=(8, 8)))[0][:5]
    x = centres[np.arange(1000) % 5] + rng.normal(size=(1000, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    gallery, probes = df.filter("id < 500"), df.filter("id >= 500")
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 8 * 20)
    tiles = search._tiles(gallery, "id", "v", 8, 32)
    assert tiles.selectExpr("sum(size(keys))").first()[0] == 500 and tiles.selectExpr("max(size(keys))").first()[0] <= 32
    for pages in (1, 3):
        visits = search._visits(probes, "id", "v", 8, tiles, pages)
        assert visits.filter("tile IS NOT NULL").count() < visits.select("keys").distinct().count() * tiles.count() / (3 if pages == 1 else 1)
    got = {r["id"]: r["idx"] for r in search.top_match(probes, gallery, "id", "id", "v", tile_bytes=8 * 8 * 32).collect()}
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = np.round(unit[500:] @ unit[:500].T, 9).argmax(axis=1)
    assert got == {500 + i: int(j) for i, j in enumerate(want)}


def test_repeated_gallery_ids_and_other_probe_types(spark):
    probes = spark.createDataFrame([("a", [1.0, 0.2]), ("a", [0.0, 2.0]), (None, [1.0, float("nan")])], "id string, v array<double>")
    gallery = spark.createDataFrame([(4, [1.0, 0.0])] * 50 + [(4, [0.0, 1.0]), (2, [0.0, 3.0]), (None, [0.0, 1.0])], "g int, v array<double>")
    for tile_bytes in (16, 1 << 20):
        got = search.top_match(probes, gallery, "id", "g", "v", tile_bytes=tile_bytes).collect()
        assert sorted((str(r["id"]), str(r["idx"]), r["class"]) for r in got) == [("None", "None", 53), ("a", "2", 2), ("a", "4", 4)]


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(0.5 ** 0.5)


def table(spark, sizes, dim=3, grid=4):
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label, rng.integers(0, grid, dim).astype(float).tolist()))
            i += 1
    return rows, spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(5)


@pytest.mark.parametrize("tile", [8, 32, 1024])
def test_neighbours_equal_brute_force(spark, tile):
    """A small grid: many equal distances and exact copies, and one class with most rows."""
    rows, df = table(spark, {"hot": 150, "b": 12, "c": 4, "one": 1})
    got = balance.class_neighbours(df, "id", "label", "v", F.lit(True), 5, tile).collect()
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    for i, label, v in rows:
        others = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, m, w in rows if m == label and j != i)
        assert have.get(i, []) == others[:5], (i, label)


def test_far_tiles_are_skipped_and_results_stay(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "a", [float(x), 0.0]) for i, x in enumerate(rng.permutation(400))]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>")
    got = balance.class_neighbours(df, "id", "label", "v", F.lit(True), 2, 16).filter("rank = 1").collect()
    assert len(got) == 400 and all(r["distance"] == 1.0 for r in got)


@pytest.mark.parametrize("dim, most", [(16, 0.2), (64, 0.35)])
def test_clusters_meet_few_other_rows(spark, dim, most):
    """Of all pairs of rows only a small share is looked at, and the neighbours are those of all pairs."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, dim))[rng.integers(0, 20, 2000)] * 2 + rng.normal(size=(2000, dim)) * 0.2
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "_k long, _l string, _v array<double>").withColumn("_w", F.lit(True))
    points = x[:64]
    tiles = balance._tiles(df, points, 64)
    assert tiles.agg(F.max("n")).first()[0] <= 64 and tiles.agg(F.sum("n")).first()[0] == 2000
    asking = balance._asking(tiles, points, 5)
    visits = balance._visitors(asking, balance._meetings(asking, tiles), points)
    looked = visits.join(tiles.select(F.col("tile").alias("other"), "n"), "other").agg(F.sum(F.size("keys") * F.col("n"))).first()[0]
    assert looked < most * 2000 ** 2
    got = balance.class_neighbours(df, "_k", "_l", "_v", F.col("_k") < 100, 3, 64).toPandas().sort_values(["_k", "rank"])
    d = np.round(((x[:100, None] - x[None]) ** 2).sum(axis=2), 9)
    d[np.arange(100), np.arange(100)] = np.inf
    assert (got["neighbour"].to_numpy().reshape(100, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_neighbours_of_null_labels_missing_vectors_and_other_keys(spark):
    rows = [(f"k{i}", None if i % 2 else "x", [float(i * i)] if i != 4 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, label string, v array<double>")
    got = {r["id"]: r["neighbour"] for r in balance.class_neighbours(df, "id", "label", "v", F.col("id") != "k0", 1, 2).collect()}
    assert got == {"k1": "k3", "k3": "k1", "k5": "k3", "k7": "k5", "k9": "k7", "k11": "k9", "k2": "k0", "k6": "k8", "k8": "k6", "k10": "k8"}
    assert balance.class_neighbours(df.filter("false"), "id", "label", "v", F.lit(True)).collect() == []


def test_oversample(spark):
    rows, df = table(spark, {"hot": 60, "b": 17, "c": 4, "one": 1}, grid=50)
    out = balance.oversample(df, "id", "label", "v", tile_rows=8)
    again = balance.oversample(df.repartition(2), "id", "label", "v")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == dict.fromkeys(["hot", "b", "c", "one"], 60)
    def key(d):
        return sorted((r["label"], r["synthetic"], tuple(round(x, 6) for x in r["v"])) for r in d.collect())
    assert key(out) == key(again)
    lo = {c: np.min([v for _, m, v in rows if m == c], axis=0) for c in "bc"}
    hi = {c: np.max([v for _, m, v in rows if m == c], axis=0) for c in "bc"}
    for r in out.filter("synthetic = 1 and label in ('b', 'c')").collect():
        assert (np.array(r["v"]) >= lo[r["label"]] - 1e-9).all() and (np.array(r["v"]) <= hi[r["label"]] + 1e-9).all()


def test_splits(spark):
    df = spark.range(1003)
    a, b = split.hash_split(df, "id", 0.8)
    assert a.intersect(b).count() == 0 and a.union(b).distinct().count() == 1003
    exact = split.exact_split(df, "id", 0.8)
    assert exact.agg(F.sum("is_train")).first()[0] == 802
    folds = {r["fold"]: r["count"] for r in split.with_folds(df, "id", 5).groupBy("fold").count().collect()}
    assert folds == {0: 201, 1: 201, 2: 201, 3: 200, 4: 200}
    small = {r["id"]: r["fold"] for r in split.with_folds(df, "id", 5).collect()}
    assert small == {r["id"]: r["fold"] for r in split.with_folds(df.repartition(7), "id", 5).collect()}


def test_what_probes_travel_follows_the_rows(spark, monkeypatch):
    """Vectors without structure in a gallery of many small tiles: larger ones take their place, the result stays."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 6))
    x[100:120] = x[0]  # equal gallery rows: the lowest wins
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(2)
    seen, visits = [], search._visits
    monkeypatch.setattr(search, "_visits", lambda *a: seen.append(visits(*a)) or seen[-1])
    got = {r["id"]: (r["idx"], r["sim"]) for r in search.top_match(
        df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), "id", "id", "v", -1.0, tile_bytes=6 * 8 * 2).collect()}
    travelled = seen[0].filter("tile IS NOT NULL").selectExpr("sum(size(keys))").first()[0]
    assert travelled <= 3000 * 4 * search.TILES  # 1500 tiles of two rows before
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.round(unit[1::2] @ unit[::2].T, 9)
    assert {i: v[0] for i, v in got.items()} == {2 * i + 1: 2 * int(j) for i, j in enumerate(s.argmax(axis=1))}
    assert all(abs(got[2 * i + 1][1] - m) < 2e-9 for i, m in enumerate(s.max(axis=1)))


def test_rows_travel_to_few_tiles(spark):
    """A class without structure, cut into many small tiles before: rows go to a bounded number of larger ones."""
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(3000, 32)), 3)
    x[50:70] = x[7]  # more copies than neighbours
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "_k long, _l string, _v array<double>").withColumn("_w", F.lit(True))
    points = x[:64]
    tiles = balance._tiles(df, points, 8)
    assert tiles.agg(F.sum("n")).first()[0] == 3000
    asking = balance._asking(tiles, points, 5)
    visits = balance._visitors(asking, balance._meetings(asking, tiles), points)
    assert visits.agg(F.sum(F.size("keys"))).first()[0] <= 3000 * 4 * balance.TILES  # 375 tiles and more before
    got = balance.class_neighbours(df, "_k", "_l", "_v", F.lit(True), 5, 8).toPandas().sort_values(["_k", "rank"])
    d = np.array([np.round(((x - v) ** 2).sum(axis=1), 9) for v in x])
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (got["neighbour"].to_numpy().reshape(3000, 5) == want).all()
    assert np.allclose(got["distance"].to_numpy().reshape(3000, 5), np.take_along_axis(d, want, axis=1))


def test_pairs_below_a_limit_far_from_the_origin_and_without_numbers():
    """Close rows with a large common part, components that overflow when squared, NaN."""
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(size=(60, 3)), 2) + 1e6
    limit = rng.uniform(0, 2, 60)
    odd = np.array([[1e200, 0, 0], [1e200, 0, 0], [1, 0, 0], [1.5, 0, 0], [np.nan, 0, 0]])
    for a, most in ((x, limit), (odd, np.full(5, np.inf))):
        with np.errstate(all="ignore"):
            d = np.array([np.round(((a - v) ** 2).sum(axis=1), 9) for v in a])
        got = {(int(i), int(j)): v for row, col, near in balance._below(a, a, most) for i, j, v in zip(row, col, near)}
        assert got == {(i, j): d[i, j] for i in range(len(a)) for j in range(len(a)) if np.isfinite(d[i, j]) and np.sqrt(d[i, j]) <= most[i]}
