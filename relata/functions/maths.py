"""Numeric functions as Column expressions. NULL in, NULL out; nothing divides by zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKED_MIN, PACKED_MAX = -1.1, 1.1


def to_asymptote(x: Column, half_life: float | Column, start: float | Column, end: float | Column) -> Column:
    """From ``start`` at 0 towards ``end``, exponentially with ``half_life``."""
    half = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in (start, end))
    return a + (1 - F.exp(-x / half)) * (b - a)


def pack(x: Column, low: float = PACKED_MIN, high: float = PACKED_MAX) -> Column:
    """A 16-bit code of x clamped to [low, high]; the fraction is cut, not rounded."""
    clamped = F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high))
    return F.when(x.isNotNull(), ((clamped - low) / (high - low) * 65535.0 - 32768.0).cast("smallint"))


def unpack(code: Column, low: float = PACKED_MIN, high: float = PACKED_MAX) -> Column:
    return (code.cast("double") + 32768.0) / 65535.0 * (high - low) + low


def rank_score(rank: Column, worst: int) -> Column:
    """1 for rank 0, falling with the logarithm of the rank to about -1 at ``worst``."""
    top = math.log(worst + 2)
    return ((top - F.log(rank + 1)) / top - 0.5) * 2


def percentile_score(p: Column) -> Column:
    return (p - 0.5) * 2


def log_boost(x: Column, logs: int, power: float) -> Column:
    for _ in range(logs):
        x = F.log1p(x.cast("double"))
    return F.pow(x, F.lit(power))


def distance_score(distance: Column, least: Column) -> Column:
    """ln(max(distance, least)) / ln(least); minus infinity for an infinite distance, if least is below 1."""
    value = F.when(distance == float("inf"), F.lit(float("-inf"))).otherwise(F.log(F.greatest(distance, least)) / F.log(least))
    return F.when((least > 0) & distance.isNotNull(), value)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    both = F.sqrt(square(a) * square(b))
    return F.when(both > 0, dot / both).otherwise(F.lit(0.0))


def unit_length(v: Column) -> Column:
    """An array scaled to length 1; unchanged if it has none."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def robust_mean(values: Column) -> Column:
    """Mean of an array's sorted values under a bell curve over their positions, which damps the extremes."""
    n = F.size(values)
    middle = F.floor(n / 2).cast("double")
    spread = F.greatest(F.lit(3.0), F.floor(n / 4).cast("double"))
    weights = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exp(-F.pow((i.cast("double") - middle) / spread, F.lit(2.0)) / 2))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    weighed = F.zip_with(F.array_sort(values), weights, lambda v, w: v.cast("double") * w)
    return F.when(n > 0, F.aggregate(weighed, F.lit(0.0), lambda s, v: s + v) / total)


def dot(a: Column, b: Column, dimensions: int | None = None) -> Column:
    """Bilinear prediction over the first ``dimensions`` factors."""
    pick = (lambda v: F.slice(v, 1, dimensions)) if dimensions else (lambda v: v)
    return F.aggregate(F.zip_with(pick(a), pick(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
