"""Features and spectra of segmented series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spectra as S
from ..functions.columns import decibel
from .ordered import BLOCK_ROWS
from .sequence import clip, frame_size, overlapping_frames, sliding


def segment_features(segments: DataFrame, keys: list[str], t: str, channels: Sequence[str],
                     label: str | None = None) -> DataFrame:
    """Per segment and channel: sample mean, std and var, and the same (population) of
    the Fourier magnitudes; the label is that of the first row.

    All channels share one shuffle: a segment is one group of bounded length.
    """
    aggs = []
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.var_samp(c).alias(f"{c}_var")]
    if label:
        aggs.append(F.min_by(label, t).alias("label"))
    items = F.array_sort(F.collect_list(F.struct(t, *channels))).alias("_i")
    packed = segments.groupBy(*keys).agg(*aggs, items)
    for c in channels:
        packed = packed.withColumn(f"_f_{c}", S.spectrum_stats(F.col(f"_i.{c}").cast(S.DOUBLES)))
    cols = list(keys) + (["label"] if label else [])
    for c in channels:
        cols += [f"{c}_mean", f"{c}_std", f"{c}_var"]
        cols += [F.col(f"_f_{c}.{s}").alias(f"{c}_fourier_{s}") for s in ("mean", "std", "var")]
    return packed.select(*cols)


def spectrum(series: DataFrame, keys: Sequence[str], array: str, fs: float) -> DataFrame:
    """Positive frequencies of each array with magnitude, real part, dB and phase."""
    z = series.select(*keys, F.size(array).alias("_n"), S.coefficients(F.col(array)).alias("_z"))
    rows = z.select(*keys, "_n", F.posexplode(F.arrays_zip(
        F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))).alias("k", "_c"))
    re, im = F.col("_c.re"), F.col("_c.im")
    mag = F.sqrt(re * re + im * im)
    # The Nyquist bin of an even length counts as negative.
    return (rows.filter((F.col("k") > 0) & (F.col("k") * 2 < F.col("_n")))
            .select(*keys, "k", (F.col("k") * fs / F.col("_n")).alias("freq"), mag.alias("mag"),
                    F.abs(re).alias("abs_real"), (2 * decibel(mag)).alias("mag_db"),
                    F.atan2(im, re).alias("phase")))


def _bins(frames: DataFrame, keys: Sequence[str], values: Column, name: str) -> DataFrame:
    """One row per bin; the bins of a frame with a missing value are there too, as NULL."""
    empty = F.array_repeat(F.lit(None).cast("double"), F.floor(F.size("window") / 2).cast("int") + 1)
    return (frames.select(*keys, F.size("window").alias("_n"), F.posexplode(F.coalesce(values, empty)).alias("k", name)))


def power_spectral_density(df: DataFrame, group: list[str], pos: str, value: str, fs: float,
                           size: int = 256) -> DataFrame:
    """Power density averaged over frames that overlap by half (Hann).

    A series shorter than ``size`` is one frame. Frames overlap by ``size // 2`` rows. NULL where a value of the
    series is missing.
    """
    sized, s = frame_size(df, group, pos, size), F.col("_frame")
    frames = overlapping_frames(sized, group, pos, value, s, s - F.floor(s / 2))
    bins = _bins(frames, group, S.power_density(F.col("window"), fs), "psd")
    whole = F.count("psd") == F.count(F.lit(1))
    return (bins.groupBy(*group, "k").agg(F.when(whole, F.avg("psd")).alias("psd"), F.first("_n").alias("_n"))
            .select(*group, "k", (F.col("k") * fs / F.col("_n")).alias("freq"), "psd"))


def stft_magnitude(df: DataFrame, group: list[str], pos: str, value: str,
                   size: int) -> DataFrame:
    """Short-time Fourier magnitude, overlap ``size // 2``, zeros beyond both ends."""
    frames = overlapping_frames(df, group, pos, value, size, size - size // 2, zero_edges=True)
    return _bins(frames, [*group, "frame"], S.windowed_magnitude(F.col("window")), "mag").drop("_n")


def spectrogram(df: DataFrame, group: list[str], pos: str, value: str, fs: float,
                size: int = 256) -> DataFrame:
    """Power density per frame, overlap one eighth, tapered-cosine window; a shorter series is one frame."""
    sized, s = frame_size(df, group, pos, size), F.col("_frame")
    frames = overlapping_frames(sized, group, pos, value, s, s - F.floor(s / 8))
    return _bins(frames, [*group, "frame"], S.power_density(F.col("window"), fs, "tukey"), "psd").drop("_n")


def sliding_spectrum(df: DataFrame, group: list[str], pos: str, value: str, size: int = 125,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """dB spectrum of every sliding window; ``row`` = frame * size + bin."""
    def magnitudes(values: pa.Array, first: np.ndarray) -> pa.Array:
        v = values.to_numpy(zero_copy_only=False)  # a missing value is NaN and stays in the windows that hold it
        spectra = np.abs(np.fft.fft(np.lib.stride_tricks.sliding_window_view(v, size)[first], axis=1)).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int32()), pa.array(spectra, mask=np.isnan(spectra)))

    frames = sliding(df, group, pos, F.col(value).cast("double"), size, "_mags", S.DOUBLES, magnitudes, block_rows)
    bins = frames.select(*group, "frame", F.posexplode("_mags").alias("k", "mag"))
    return bins.select(*group, "frame", "k", (F.col("frame") * size + F.col("k")).alias("row"),
                       decibel(F.col("mag")).alias("db"))


def band_energy(series: DataFrame, keys: Sequence[str], array: str, low: float, high: float,
                fs: float) -> DataFrame:
    """Sum of squared magnitudes of the bins inside a band."""
    bins = spectrum(series, keys, array, fs)
    inside = bins.filter((F.col("freq") >= low) & (F.col("freq") <= high))
    return inside.groupBy(*keys).agg(F.sum(F.col("mag") * F.col("mag")).alias("energy"))


STEPS = ("clip", "band", "down")


def preprocess_chunks(df: DataFrame, array: str, length: int, low: float, high: float, fs: float,
                      order: int = 5, steps: Sequence[str] = STEPS, frame: int = 256) -> DataFrame:
    """Clip, band-pass and halve every chunk, in the order of ``steps``; further steps are ``autocorrelate`` and,
    as the last one, ``stft`` with frames of ``frame`` values. ``recursive`` is the band-pass by recursion.

    A chunk is an array of values or of (time, channel). One projection: nothing is shuffled. ``fs`` is the rate
    of the input; the filter that runs after halving sees half of it. A chunk shorter than ``length`` gives NULL.
    """
    channels = isinstance(df.schema[array].dataType.elementType, T.ArrayType)
    rate, c = fs, F.col(array).cast(S.MATRIX if channels else S.DOUBLES)
    for step in steps:
        if step == "clip":
            c = clip(c, length)
        elif step == "band":
            c = S.band_pass(c, low, high, rate, order, channels)
        elif step == "recursive":
            c = S.recursive_band_pass(c, low, high, rate, order, channels)
        elif step == "down":
            c, rate = S.resample_half(c, channels), rate / 2
        elif step == "autocorrelate":
            c = S.autocorrelation(c, channels)
        elif step == "stft" and step is steps[-1]:
            c = S.short_time_magnitude(c, frame, channels)
        else:
            raise ValueError(f"unknown step: {step}")
    return df.withColumn(array, c)
