"""Spectral operators against numpy, and their edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featforge.functions import spectra as S
from featforge.operators import signal, sequence


@pytest.fixture(scope="module")
def arrays(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([64, 64, 51, 8, 1])]
    rows += [(90, []), (91, None), (92, [1.0, None, 2.0])]
    return spark.createDataFrame(rows, "id long, a array<double>")


def collected(df, col):
    return {r["id"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("name, fn", [
    ("magnitudes", lambda a: np.abs(np.fft.fft(a))),
    ("autocorrelation", lambda a: [np.dot(a, np.roll(a, -k)) for k in range(len(a))]),
])
def test_array_functions(arrays, name, fn):
    src = collected(arrays, "a")
    got = collected(arrays.select("id", getattr(S, name)(F.col("a")).alias("x")), "x")
    for i, a in src.items():
        if i >= 90:
            assert got[i] is None
        else:
            np.testing.assert_allclose(got[i], fn(np.array(a)), atol=1e-9)


def test_resample_half(arrays):
    src = collected(arrays, "a")
    got = collected(arrays.select("id", S.resample_half(F.col("a")).alias("x")), "x")
    assert [len(got[i]) for i in (0, 2, 3)] == [32, 25, 4] and got[4] is None
    t = np.arange(64)
    slow = np.cos(2 * np.pi * 3 * t / 64)
    df = arrays.sparkSession.createDataFrame([(0, slow.tolist())], "id long, a array<double>")
    np.testing.assert_allclose(collected(df.select("id", S.resample_half(F.col("a")).alias("x")), "x")[0], slow[::2], atol=1e-9)
    assert len(src[2]) == 51


def test_band_pass_keeps_the_band(spark):
    n, fs = 500, 250.0
    t = np.arange(n) / fs
    parts = {f: np.sin(2 * np.pi * f * t) for f in (4, 20, 60)}
    df = spark.createDataFrame([(0, sum(parts.values()).tolist())], "id long, a array<double>")
    got = np.array(collected(df.select("id", S.band_pass(F.col("a"), 13, 32, fs).alias("x")), "x")[0])
    np.testing.assert_allclose(got, parts[20], atol=0.02)


def test_segment_features(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, *rng.normal(size=2).tolist(), "AB"[t % 2]) for s, n in enumerate([40, 12, 11, 1]) for t in range(n)]
    df = spark.createDataFrame(rows, "seg int, t int, x double, y double, stage string").repartition(3)
    got = signal.segment_features(df, ["seg"], "t", ["x", "y"], "stage").toPandas().set_index("seg")
    pdf = pd.DataFrame(rows, columns=["seg", "t", "x", "y", "stage"])
    for seg, part in pdf.groupby("seg"):
        for c in ("x", "y"):
            v = part[c].to_numpy()
            mags = np.abs(np.fft.fft(v))[5:len(v) // 2]
            assert got.loc[seg, f"{c}_mean"] == pytest.approx(v.mean())
            if len(v) > 1:
                assert got.loc[seg, f"{c}_var"] == pytest.approx(v.var(ddof=1))
            else:
                assert pd.isna(got.loc[seg, f"{c}_std"])
            if len(mags):
                assert got.loc[seg, f"{c}_fourier_mean"] == pytest.approx(mags.mean())
                assert got.loc[seg, f"{c}_fourier_std"] == pytest.approx(mags.std())
            else:
                assert pd.isna(got.loc[seg, f"{c}_fourier_mean"])
        assert got.loc[seg, "label"] == "A"
    nan = signal.segment_features(df, ["seg"], "t", ["x"]).filter(F.isnan("x_fourier_mean")).count()
    assert nan == 0


def test_psd_of_a_tone(spark):
    n, fs, size = 256, 64.0, 64
    v = 3 * np.sin(2 * np.pi * 8 * np.arange(n) / fs)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "g int, pos long, v double")
    psd = signal.power_spectral_density(df, ["g"], "pos", "v", fs, size).orderBy("k").toPandas()
    assert psd["k"].tolist() == list(range(33))
    assert psd.loc[psd["psd"].idxmax(), "freq"] == 8.0
    assert psd["psd"].sum() * fs / size == pytest.approx((v ** 2).mean(), rel=1e-6)


def test_stft_frames_reach_both_ends(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(21)], "g int, pos long, v double")
    frames = sequence.overlapping_frames(df, ["g"], "pos", "v", 8, 4, zero_edges=True).orderBy("frame").collect()
    extended = [0.0] * 4 + [1.0] * 21 + [0.0] * 20
    assert [r["window"] for r in frames] == [extended[i * 4:i * 4 + 8] for i in range(7)]


def test_sliding_spectrum_rows(spark):
    df = spark.createDataFrame([(1, i, float(i % 3)) for i in range(20)], "g int, pos long, v double")
    got = signal.sliding_spectrum(df, ["g"], "pos", "v", 5)
    assert got.count() == (20 - 5) * 5
    assert [r["row"] for r in got.orderBy("row").collect()] == list(range(75))


def test_preprocess_orders_and_quarantine(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=n).tolist()) for i, n in enumerate([60, 61, 49])], "id long, a array<double>")
    one = collected(signal.preprocess_chunks(df, "a", 50, 13, 32, 125.0), "a")
    two = collected(signal.preprocess_chunks(df, "a", 50, 13, 32, 250.0, steps=("clip", "down", "band", "autocorrelate")), "a")
    assert [one[i] and len(one[i]) for i in range(3)] == [25, 25, None]
    assert len(two[0]) == 25 and two[2] is None
    with pytest.raises(ValueError):
        signal.preprocess_chunks(df, "a", 50, 13, 32, 125.0, steps=("melt",))


@pytest.mark.parametrize("steps", [("clip", "band", "down"), ("clip", "down", "band", "autocorrelate"), ("clip", "stft")])
def test_channels_equal_single_arrays(spark, steps):
    rng = np.random.default_rng(8)
    data = [rng.normal(size=(n, 3)) for n in (50, 57, 63)]
    args = (50, 13, 32, 125.0)
    both = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(data)] + [(9, data[0][:20].tolist())], "i int, a array<array<double>>")
    got = {r["i"]: r["a"] for r in signal.preprocess_chunks(both, "a", *args, steps=steps, frame=16).collect()}
    assert got[9] is None
    for c in range(3):
        one = spark.createDataFrame([(i, d[:, c].tolist()) for i, d in enumerate(data)], "i int, a array<double>")
        for r in signal.preprocess_chunks(one, "a", *args, steps=steps, frame=16).collect():
            np.testing.assert_allclose(np.array(got[r["i"]])[..., c], np.array(r["a"]), atol=1e-9)


def test_sections_have_the_gain_of_the_filter():
    """Squared gain 1 / (1 + x ** 2n) at every frequency, for narrow, wide and odd bands."""
    for low, high, fs, order in ((13, 32, 125.0, 5), (0.5, 60, 125.0, 4), (10, 10.5, 250.0, 2), (1, 40, 100.0, 1), (1, 49, 100.0, 3)):
        sections = S.band_pass_sections(low, high, fs, order)
        assert sections.shape == (order, 5)
        freq = np.linspace(0.01, fs / 2 - 0.01, 200)
        z = np.exp(-2j * np.pi * freq / fs)
        gain = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections], axis=0)
        w, w1, w2 = np.tan(np.pi * freq / fs), np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
        assert np.allclose(np.abs(gain) ** 2, 1 / (1 + ((w * w - w1 * w2) / ((w2 - w1) * w)) ** (2 * order)), atol=1e-8)


def test_recursive_band_pass_keeps_the_band_and_drops_the_rest(spark):
    t = np.arange(500) / 125.0
    inside, outside = np.sin(2 * np.pi * 20 * t), np.sin(2 * np.pi * 3 * t) + 5
    rows = [(0, (inside + outside).tolist()), (1, [7.0] * 500), (2, [1.0] * 33), (3, None), (4, [1.0, None] * 250)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r["b"] for r in df.select("id", S.recursive_band_pass(F.col("v"), 13, 32, 125.0, 5).alias("b")).collect()}
    assert np.abs(np.array(got[0])[100:-100] - inside[100:-100]).max() < 0.02
    assert np.abs(np.array(got[1])).max() < 1e-9 and got[2] is None and got[3] is None and got[4] is None
    both = spark.createDataFrame([(np.stack([inside + outside, inside], axis=1).tolist(),)], "v array<array<double>>")
    two = np.array(both.select(S.recursive_band_pass(F.col("v"), 13, 32, 125.0, 5, channels=True).alias("b")).first()["b"])
    assert two.shape == (500, 2) and np.allclose(two[:, 0], got[0])
