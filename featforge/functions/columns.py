"""Column expressions and whole-row projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import MISSING_CODES


def _known(df: DataFrame, cols: Sequence[str]) -> None:
    unknown = [c for c in cols if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select by name; an unknown name is an error."""
    _known(df, cols)
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop by name; an unknown name is an error (``DataFrame.drop`` ignores it)."""
    _known(df, cols)
    return df.drop(*cols)


def split_on_value(df: DataFrame, col: str, value) -> tuple[DataFrame, DataFrame]:
    """Rows equal to ``value`` and all other rows, NULL among the others."""
    hit = F.col(col).eqNullSafe(F.lit(value))
    return df.filter(hit), df.filter(~hit)


def missing_codes_to_null(df: DataFrame, codes: Sequence[int] = MISSING_CODES,
                          columns: Sequence[str] | None = None) -> DataFrame:
    """In-band "no answer" codes become NULL in every number and text column."""
    columns = df.columns if columns is None else list(columns)
    _known(df, columns)

    def rule(name: str) -> Column:
        dtype, c = df.schema[name].dataType, F.col(f"`{name}`")
        if name in columns and isinstance(dtype, T.NumericType):
            return F.when(~c.isin(*codes) | c.isNull(), c).alias(name)
        if name in columns and isinstance(dtype, T.StringType):
            return F.when(~c.isin(*[str(k) for k in codes]) | c.isNull(), c).alias(name)
        return c

    return df.select(*[rule(c) for c in df.columns])


def encode(col: Column, mapping: Mapping) -> Column:
    """Dictionary lookup; a value outside the dictionary gives NULL."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.when(col.isNotNull(), F.try_element_at(table, col))


def encode_array(col: Column, mapping: Mapping) -> Column:
    return F.transform(col, lambda x: encode(x, mapping))


def decode(col: Column, mapping: Mapping) -> Column:
    return encode(col, {v: k for k, v in mapping.items()})


def unknown_codes(df: DataFrame, col: str, mapping: Mapping) -> DataFrame:
    """Values the dictionary does not cover, with their row counts."""
    return (df.filter(F.col(col).isNotNull() & encode(F.col(col), mapping).isNull())
            .groupBy(col).agg(F.count(F.lit(1)).alias("n")))


def is_class(col: Column, value) -> Column:
    """Binary label out of a multi-class one."""
    return (col == F.lit(value)).cast("double")


def at_index(array: Column, zero_based: Column | int) -> Column:
    """Array element by 0-based index; NULL outside the array."""
    return F.get(array, zero_based if isinstance(zero_based, Column) else F.lit(zero_based))


def channel(array: Column, i: int) -> Column:
    """Column ``i`` of a (time, channel) nested array."""
    return F.transform(array, lambda row: F.get(row, F.lit(i)))


def numbered_name(name: Column, index: Column, prefix: str = "query_",
                  extension: str = ".jpg") -> Column:
    """New file name with a two-digit index for matching files, else NULL."""
    return F.when(name.endswith(extension),
                  F.format_string(f"{prefix}%02d{extension}", index.cast("int")))


def recording_name_parts(name: Column) -> Column:
    """Fixed-offset parts of a recording file name; NULL for other files."""
    role = F.when(name.contains("data"), "data").when(name.contains("label"), "label")
    return F.when(role.isNotNull(), F.struct(
        F.substring(name, 1, 14).alias("id"),
        F.substring(name, 1, 10).alias("subject_id"),
        F.substring(name, 12, 3).alias("block"),
        role.alias("role"),
        F.when(name.contains("series"), "series").otherwise("stamps").alias("type"),
    ))


def portable_hash(key: Column, seed: int = 42) -> Column:
    """32-bit hash of key and seed that any SQL engine with md5 can repeat."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit_interval(hash32: Column) -> Column:
    return hash32 / F.lit(4294967296.0)


def date_parts(text_or_time: Column, is_time: bool = False) -> list[Column]:
    """month, day and hour of text ``YYYY-MM-DD HH:...``, or of a timestamp (``is_time``)."""
    t = text_or_time if is_time else F.try_to_timestamp(text_or_time)
    return [F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour")]


def text_to_int(c: Column, strict: bool = False) -> Column:
    """Integer of a text. Bad text fails when ``strict``, else it gives NULL.

    The pattern is tested first: ``try_cast`` alone raises and catches an error per bad value.
    """
    if strict:
        return c.cast("int")
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("int"))


def root(x: Column) -> Column:
    """Square root; NULL for a negative argument."""
    return F.when(x >= 0, F.sqrt(x))


def ratio_indices(band: Mapping[str, Column], extended: bool = False) -> list[Column]:
    """Vegetation and soil indices of satellite bands (public index formulas).

    ``band`` maps b2, b3, b4, b5, b8, b11, b12 to columns. A zero denominator or a
    negative root gives NULL.
    """
    blue, green, red, edge = (band[k].cast("double") for k in ("b2", "b3", "b4", "b5"))
    nir, swir1, swir2 = (band[k].cast("double") for k in ("b8", "b11", "b12"))

    def contrast(a: Column, b: Column) -> Column:
        return F.try_divide(a - b, a + b)

    soil = F.try_divide(nir - red, nir + red + 0.5)
    twice = 2 * nir + 1
    out = {
        "NDVI": contrast(nir, red),
        "EVI": 2.5 * F.try_divide(nir - red, nir + 6 * red - 7.5 * blue + 1.01),
        "NDWI": contrast(green, nir),
        "SAVI": 1.5 * soil,
        "MSAVI": (twice - root(twice * twice - 8 * (nir - red))) / 2,
        "GNDVI": contrast(nir, green),
        "RENDVI": contrast(nir, edge),
        "NDMI": contrast(nir, swir1),
        "GRVI": contrast(green, red),
        "TVI": root(soil),
        "MCARI": F.try_divide((edge - red) - 0.2 * (edge - green), F.try_divide(edge, red)),
        "BSI": contrast(swir1 + red, nir + blue),
        "NBR": contrast(nir, swir2),
        "MSI": F.try_divide(swir1, nir),
    }
    if extended:
        out["RVI"] = F.try_divide(nir, red)
        out["GCI"] = F.try_divide(nir, green) - 1
    return [c.alias(name) for name, c in out.items()]


def decibel(x: Column) -> Column:
    return 10 * F.log10(F.abs(x) + 1e-10)


def no_nan(x: Column) -> Column:
    """NaN never leaves an operator: it becomes NULL."""
    return F.when(~F.isnan(x), x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines.

    The small shift settles exact ties, where engines round differently; adding
    0.0 removes a negative zero.
    """
    return F.round(x + F.lit(1e-9), digits) + F.lit(0.0)
