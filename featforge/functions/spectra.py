"""Fourier helpers as Arrow functions over array columns.

Each call gets one batch of arrays, groups equal lengths and transforms them as
one matrix. Arrays are segments, frames or chunks: bounded by their own length.
An array with a missing value gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
MATRIX = T.ArrayType(DOUBLES)


def _usable(a) -> bool:
    return a is not None and len(a) > 0


def _apply(series: pd.Series, fn: Callable[[np.ndarray], list]) -> pd.Series:
    """``fn`` on a (rows, length) matrix per array length; NULL for unusable arrays."""
    out: list = [None] * len(series)
    by_length: dict[int, list[int]] = {}
    for i, a in enumerate(series):
        if _usable(a):
            by_length.setdefault(len(a), []).append(i)
    for rows in by_length.values():
        matrix = np.array([np.asarray(series.iloc[i], dtype="float64") for i in rows])
        whole = ~np.isnan(matrix).any(axis=1)
        if whole.any():
            results = fn(matrix[whole])
            for i, r in zip(np.asarray(rows)[whole], results):
                out[i] = r
    return pd.Series(out, dtype="object")


def _apply_channels(series: pd.Series, fn: Callable[[np.ndarray], list]) -> pd.Series:
    """The same for (time, channel) arrays: ``fn`` sees one row per channel; the result is transposed back."""
    out: list = [None] * len(series)
    for i, a in enumerate(series):
        if not _usable(a) or any(row is None or len(row) != len(a[0]) or not len(row) for row in a):
            continue
        matrix = np.array([np.asarray(row, dtype="float64") for row in a]).T
        if not np.isnan(matrix).any():
            results = fn(matrix)
            if all(r is not None for r in results):
                out[i] = np.stack(results, axis=1).tolist()
    return pd.Series(out, dtype="object")


def _each(series: Column, fn: Callable[[np.ndarray], list], channels: bool) -> Column:
    @F.pandas_udf(MATRIX if channels else DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        return _apply_channels(s, fn) if channels else _apply(s, fn)

    return run(series)


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """Periodic tapered-cosine window."""
    edge = alpha * n / 2
    distance = np.minimum(np.arange(n), n - np.arange(n))
    return np.where(distance < edge, 0.5 - 0.5 * np.cos(np.pi * distance / edge), 1.0)


def magnitudes(series: Column) -> Column:
    """Fourier magnitudes of all bins."""
    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        return _apply(s, lambda m: list(np.abs(np.fft.fft(m, axis=1))))

    return run(series)


def coefficients(series: Column) -> Column:
    """Fourier coefficients of the non-negative frequencies, real and imaginary part."""
    schema = T.StructType([T.StructField("re", DOUBLES), T.StructField("im", DOUBLES)])

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        z = _apply(s, lambda m: list(np.fft.rfft(m, axis=1)))
        return pd.DataFrame({"re": [None if c is None else c.real for c in z],
                             "im": [None if c is None else c.imag for c in z]})

    return run(series)


def spectrum_stats(series: Column, first_bin: int = 5) -> Column:
    """Mean, population deviation and variance of the magnitudes from ``first_bin`` to N // 2 - 1."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "std", "var")])

    def stats(m: np.ndarray) -> list:
        mags = np.abs(np.fft.rfft(m, axis=1))[:, first_bin:m.shape[1] // 2]
        if mags.shape[1] == 0:
            return [None] * len(m)
        return list(np.stack([mags.mean(1), mags.std(1), mags.var(1)], axis=1))

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if r is None else tuple(r) for r in _apply(s, stats)]
        return pd.DataFrame(rows, columns=["mean", "std", "var"]).astype("float64")

    out = run(series)
    return F.struct(*[F.when(~F.isnan(out[n]), out[n]).alias(n) for n in ("mean", "std", "var")])


def power_density(frame: Column, fs: float, window: str = "hann") -> Column:
    """One-sided power density of one frame after removal of its mean."""
    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        def density(m: np.ndarray) -> list:
            n = m.shape[1]
            w = hann(n) if window == "hann" else tukey(n)
            power = np.abs(np.fft.rfft((m - m.mean(1, keepdims=True)) * w, axis=1)) ** 2
            power /= fs * (w ** 2).sum()
            power[:, 1:(n + 1) // 2] *= 2
            return list(power)
        return _apply(s, density)

    return run(frame)


def windowed_magnitude(frame: Column) -> Column:
    """Short-time Fourier magnitude of one frame (Hann, scaled by the window sum)."""
    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        def mag(m: np.ndarray) -> list:
            w = hann(m.shape[1])
            return list(np.abs(np.fft.rfft(m * w, axis=1)) / w.sum())
        return _apply(s, mag)

    return run(frame)


def autocorrelation(series: Column, channels: bool = False) -> Column:
    """Circular autocorrelation: inverse transform of the squared magnitudes.

    With ``channels`` an array holds (time, channel) and every channel is transformed, here and below.
    """
    return _each(series, lambda m: list(np.fft.irfft(
        np.abs(np.fft.rfft(m, axis=1)) ** 2, n=m.shape[1], axis=1)), channels)


def band_pass(series: Column, low: float, high: float, fs: float, order: int = 5, channels: bool = False) -> Column:
    """Zero-phase Butterworth band-pass in the frequency domain.

    Bins are multiplied with the squared gain of the digital filter (bilinear
    form), which is what a forward and backward run gives away from the edges.
    """
    w1, w2 = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)

    def filtered(m: np.ndarray) -> list:
        n = m.shape[1]
        warped = np.tan(np.pi * np.minimum(np.arange(n // 2 + 1) / n, 0.5 - 1e-12))
        with np.errstate(divide="ignore"):
            x = (warped ** 2 - w1 * w2) / ((w2 - w1) * warped)
            gain = 1.0 / (1.0 + x ** (2 * order))
        return list(np.fft.irfft(np.fft.rfft(m, axis=1) * gain, n=n, axis=1))

    return _each(series, filtered, channels)


def band_pass_sections(low: float, high: float, fs: float, order: int = 5) -> np.ndarray:
    """Digital Butterworth band-pass as ``order`` rows (b0, b1, b2, a1, a2): bilinear transform of the analogue poles.

    Every section has its zeros at 1 and -1, so that a constant gives 0; the gain at the centre is 1.
    """
    w1, w2 = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = prototype * (w2 - w1) / 2
    root = np.sqrt(half ** 2 - w1 * w2 + 0j)
    s = np.concatenate([half + root, half - root])
    z = (1 + s) / (1 - s)
    upper = z[z.imag > 1e-12]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    rows = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    centre = np.exp(-2j * np.arctan(np.sqrt(w1 * w2)))
    gain = np.prod([(1 - centre ** 2) / (1 + a1 * centre + a2 * centre ** 2) for a1, a2 in rows])
    sections = np.array([(1.0, 0.0, -1.0, a1, a2) for a1, a2 in rows])
    sections[0, :3] /= abs(gain)
    return sections


def _run_sections(m: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """All rows through the sections, as if each had held its first value for ever before."""
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        steady = m[:, 0] if i == 0 else np.zeros(len(m))  # behind the first section a constant is 0
        z2 = b2 * steady
        z1 = b1 * steady + z2
        out = np.empty_like(m)
        for t in range(m.shape[1]):
            x = m[:, t]
            y = b0 * x + z1
            z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
            out[:, t] = y
        m = out
    return m


def recursive_band_pass(series: Column, low: float, high: float, fs: float, order: int = 5, channels: bool = False) -> Column:
    """Zero-phase Butterworth band-pass by recursion: forward and backward over second-order sections.

    Both ends are extended by 3 * (2 * order + 1) values mirrored through the end value, and each run starts in the
    steady state of its first value. A series that is not longer than an extension gives NULL. All arrays of a batch
    and all their channels take a step in time together.
    """
    sections, edge = band_pass_sections(low, high, fs, order), 3 * (2 * order + 1)

    def filtered(m: np.ndarray) -> list:
        if m.shape[1] <= edge:
            return [None] * len(m)
        m = np.concatenate([2 * m[:, :1] - m[:, edge:0:-1], m, 2 * m[:, -1:] - m[:, -2:-edge - 2:-1]], axis=1)
        forward = _run_sections(m, sections)
        return list(_run_sections(forward[:, ::-1], sections)[:, ::-1][:, edge:-edge])

    return _each(series, filtered, channels)


def resample_half(series: Column, channels: bool = False) -> Column:
    """Fourier resampling to N // 2 points."""
    def half(m: np.ndarray) -> list:
        n = m.shape[1]
        num = n // 2
        if num == 0:
            return [None] * len(m)
        spectrum = np.fft.rfft(m, axis=1)[:, :num // 2 + 1].copy()
        if num % 2 == 0:
            spectrum[:, num // 2] *= 2
        return list(np.fft.irfft(spectrum, n=num, axis=1) * num / n)

    return _each(series, half, channels)


def short_time_magnitude(series: Column, size: int, channels: bool = False) -> Column:
    """Short-time Fourier magnitudes of whole arrays as (frame, bin), with ``channels`` as (frame, bin, channel).

    Hann frames that overlap by ``size // 2``, zeros beyond both ends, scaled by the window sum.
    """
    hop, half = size - size // 2, size // 2

    def frames(m: np.ndarray) -> np.ndarray:
        count = (m.shape[1] - 1 + half) // hop + 1
        padded = np.zeros((len(m), (count - 1) * hop + size))
        padded[:, half:half + m.shape[1]] = m
        cut = np.stack([padded[:, f * hop:f * hop + size] for f in range(count)], axis=1)
        return np.abs(np.fft.rfft(cut * hann(size), axis=2)) / hann(size).sum()

    @F.pandas_udf(T.ArrayType(MATRIX) if channels else MATRIX)
    def run(s: pd.Series) -> pd.Series:
        if not channels:
            return _apply(s, lambda m: [x.tolist() for x in frames(m)])
        return _apply_channels(s, lambda m: list(frames(m))).map(
            lambda x: None if x is None else np.moveaxis(np.array(x), 1, 2).tolist())

    return run(series)


def pair_means(series: Column) -> Column:
    """Mean of consecutive pairs: the down-sampling that needs no transform."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(series) / 2).cast("int") - 1),
                       lambda i: (F.get(series, 2 * i) + F.get(series, 2 * i + 1)) / 2)
