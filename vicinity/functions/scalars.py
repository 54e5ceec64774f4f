"""Scalar functions as Spark columns: clamps, quantization codecs, squared distances, timestamps, bitmaps.

All arithmetic is safe under ANSI mode: values are clamped before they are narrowed, and widened before they are
subtracted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dims up to which a distance is written out flat.
FLAT = 16

#: codec -> (scale, code of a missing value, least code of a present one, greatest code)
CODECS = {"int8": (127.0, -128, 0, 127), "i16": (10000.0, -32768, -32768, 32767)}


def clamp01(x: Column) -> Column:
    """x within [0, 1]; NaN stays NaN (Spark orders it above all numbers, so it is tested first)."""
    return F.when(F.isnan(x), x).when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b with the results of IEEE division for a zero divisor."""
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / b)


def quantize_value(v: Column, codec: str = "i16") -> Column:
    """The integer code of one float: scaled in single precision and rounded half away from zero; NaN is 0."""
    scale, missing, low, high = CODECS[codec]
    v = v.cast("float")
    sentinel = (v == F.lit(-1.0).cast("float")) if codec == "int8" else F.abs(v + 1) < F.lit(1e-5)
    scaled = (v * F.lit(scale).cast("float")).cast("double")
    # int8 rounds halves up, i16 away from zero
    whole = F.floor(scaled + 0.5).cast("double") if codec == "int8" else F.round(scaled)
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), whole))
    return F.when(F.isnan(v), F.lit(0)).when(sentinel, F.lit(missing)).otherwise(bounded.cast("int"))


def quantize(vector: Column, codec: str = "i16", dims: int | None = None) -> Column:
    """The codes of a vector, as array<int>. With up to FLAT ``dims`` it is one flat expression, as ``l2sq`` is."""
    if dims is None or dims > FLAT:
        return F.transform(vector, lambda v: quantize_value(v, codec))
    return F.when(vector.isNotNull(), F.array(*[quantize_value(F.get(vector, F.lit(i)), codec) for i in range(dims)]))


def l2sq(a: Column, b: Column, dims: int | None = None, kind: str = "bigint") -> Column:
    """Squared Euclidean distance of two arrays.

    With up to FLAT ``dims`` it is one flat expression, which whole-stage code generation compiles; beyond that, or
    without ``dims``, a higher-order one, as generated methods are limited in size.
    """
    if dims is None or dims > FLAT:
        terms = F.zip_with(a, b, lambda x, y: (x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind)))
        return F.aggregate(terms, F.lit(0).cast(kind), lambda s, t: s + t)
    total = None
    for i in range(dims):
        gap = F.get(a, F.lit(i)).cast(kind) - F.get(b, F.lit(i)).cast(kind)
        total = gap * gap if total is None else total + gap * gap
    return total


def epoch_seconds(iso: Column) -> Column:
    """Seconds since 1970 of the fixed layout YYYY-MM-DDThh:mm:ss; what follows is ignored. Null if it isn't a time."""
    return F.unix_seconds(F.try_to_timestamp(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def epoch_days(seconds: Column) -> Column:
    return F.floor(seconds / 86400).cast("int")


def hour_of(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")


def day_of_week(seconds: Column) -> Column:
    """Monday 0 to Sunday 6; day 0 of the epoch was a Thursday."""
    return F.pmod(epoch_days(seconds) + 3, F.lit(7)).cast("int")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes between two times in seconds."""
    return (later - earlier) / F.lit(60.0)


def mcc_digits(mcc: Column) -> Column:
    """The key of the positional parsers: digits read as a number, so leading zeros go."""
    digits = F.regexp_replace(mcc, r"\D", "")
    return F.when(digits == "", F.lit("0")).otherwise(F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))


def bit_at(bitmap: Column, position: Column) -> Column:
    """Bit ``position`` (from 0, least first in each byte) of a binary bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int"))
