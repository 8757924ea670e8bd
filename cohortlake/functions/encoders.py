"""Dimension and member encodings and numeric buckets as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = (1 << 32) - 1


def uint32(value: Column) -> Column:
    """value as a long if it is in range, else null."""
    return F.when((value >= 0) & (value <= UINT32), value)


def folded_hash(value: Column) -> Column:
    """A 64-bit hash folded to 32 bits, as a long."""
    h = F.xxhash64(value)
    return F.when(value.isNotNull(), h.bitwiseXOR(F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(UINT32)))


def hashed(value: Column, encoding: str, algo: str | None = None) -> Column:
    """The code of a hashed dimension, 32 bits as a long: by murmur3 or xxhash64 as told, else as the encoding has it."""
    if (algo or ("murmur3" if encoding == "hash32" else "xxh3")) == "murmur3":
        return F.when(value.isNotNull(), F.hash(value.cast("string")).cast("bigint").bitwiseAND(F.lit(UINT32)))
    return folded_hash(value.cast("string"))


def stable_fraction(value: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the value's text: the same in any engine."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def linear_bucket(value: Column, step: float, low: float | None = None, high: float | None = None) -> Column:
    low = 0.0 if low is None else float(low)
    value = F.greatest(value, F.lit(low)) if high is None else F.least(F.greatest(value, F.lit(low)), F.lit(float(high)))
    return F.greatest(F.floor((value - F.lit(low)) / F.lit(float(step))), F.lit(0)).cast("bigint")


def exponential_bucket(value: Column, base: float, low: float | None = None, high: float | None = None) -> Column:
    low = 1.0 if low is None else float(low)
    capped = value if high is None else F.least(value, F.lit(float(high)))
    grown = F.floor(F.ln(capped / F.lit(low)) / F.ln(F.lit(float(base)))) + 1
    return F.when(value.isNotNull(), F.when(value <= low, F.lit(0)).otherwise(grown)).cast("bigint")


def explicit_bucket(value: Column, boundaries: list[float]) -> Column:
    """How many boundaries are at most the value."""
    return F.when(value.isNotNull(), sum((F.when(value >= float(b), 1).otherwise(0) for b in boundaries), F.lit(0))).cast("bigint")


def bucketed(value: Column, spec) -> Column:
    """value, a double, in the bucket of a configured spec."""
    if spec.type == "linear":
        return linear_bucket(value, spec.step, spec.min, spec.max)
    if spec.type == "exponential":
        return exponential_bucket(value, spec.base, spec.min, spec.max)
    return explicit_bucket(value, spec.boundaries)
