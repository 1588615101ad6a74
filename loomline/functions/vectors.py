"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x / size))


def rms(a: Column) -> Column:
    """0 for an empty or null array."""
    return F.when(F.size(a) > 0, F.sqrt(dot(a, a) / F.size(a))).otherwise(0.0)


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def pcm16(a: Column, scale: int = 32768) -> Column:
    """Floats in -1..1 as 16-bit integers, clipped."""
    return F.transform(a, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), (x * scale).cast("int"))).cast("short"))


def pcm16_asymmetric(a: Column) -> Column:
    """As browsers do: negative values by 0x8000, others by 0x7fff."""
    clipped = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.transform(a, lambda x: (clipped(x) * F.when(clipped(x) < 0, 32768).otherwise(32767)).cast("short"))


def resampled(a: Column, source: int, target: int) -> Column:
    """Linear interpolation at ``target`` samples a second; a part of a sample at the end is cut off."""
    n = F.floor(F.size(a) * F.lit(target) / F.lit(source)).cast("int")
    at = lambda i: F.when(n > 1, i * (F.size(a) - 1) / (n - 1)).otherwise(F.lit(0.0))
    low = lambda i: F.floor(at(i)).cast("int")
    high = lambda i: F.least(low(i) + 1, F.size(a) - 1)
    value = lambda i: F.get(a, low(i)) + (at(i) - low(i)) * (F.get(a, high(i)) - F.get(a, low(i)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), value)).otherwise(F.when(a.isNotNull(), F.array().cast("array<double>")))
