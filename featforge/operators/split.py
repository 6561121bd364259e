"""Splits and folds from a hash of the key, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import portable_hash
from .ordered import dense_position


def in_train(key: Column, share: float = 0.8, seed: int = 42) -> Column:
    """Threshold on the hash: no shuffle, sizes close to the share."""
    return F.pmod(portable_hash(key, seed), F.lit(1000)) < F.lit(int(round(share * 1000)))


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42):
    hit = in_train(F.col(key), share, seed)
    return df.filter(hit), df.filter(~hit)


def shuffled_position(df: DataFrame, key: str, seed: int = 42, out: str = "pos") -> DataFrame:
    """Position in the hash order of the key. """
    hashed = df.withColumn("_h", portable_hash(F.col(key), seed))
    return dense_position(hashed, [], ["_h", key], out).drop("_h")


def exact_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42,
                out: str = "is_train") -> DataFrame:
    """Exactly ``int(share * n)`` training rows."""
    n_train = int(df.count() * share + 1e-9)
    pos = shuffled_position(df, key, seed, "_pos")
    return pos.withColumn(out, (F.col("_pos") < n_train).cast("int")).drop("_pos")


def with_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """K shuffled folds whose sizes differ by at most one row."""
    pos = shuffled_position(df, key, seed, "_pos")
    return pos.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_pos")
