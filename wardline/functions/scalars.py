"""Scalar expressions: geography, the 24-hour circle, rounding, clipping."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
HOUR_TO_RADIANS = 2 * math.pi / 24


def round_to(x: Column, digits: int) -> Column:
    """Round half up with a 1e-6 guard, so that a value such as 1.005 does not depend on the engine."""
    scale = float(10 ** digits)
    return F.floor(x * scale + (0.5 + 1e-6)) / F.lit(scale)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), 2) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    )
    # Not least(): it would turn a missing location into half the globe.
    return F.asin(F.sqrt(F.when(chord > 1, 1.0).otherwise(chord))) * (2 * EARTH_RADIUS_KM)


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def circular_mean(n: Column, sin_sum: Column, cos_sum: Column) -> Column:
    """Mean hour of ``n`` hours given the sums of sin and cos of their angles; null when n = 0."""
    mean = F.pmod(F.atan2(sin_sum / n, cos_sum / n) / HOUR_TO_RADIANS, F.lit(24.0))
    return F.when(n > 0, mean)


def circular_std(n: Column, sin_sum: Column, cos_sum: Column) -> Column:
    """Circular deviation in hours, floored at 0.5; null when n = 0.

    The resultant length is clamped to 1: equal hours can push it one ulp above.
    """
    r = F.sqrt(F.pow(sin_sum / n, 2) + F.pow(cos_sum / n, 2))
    r = F.least(F.greatest(r, F.lit(1e-6)), F.lit(1.0))
    return F.when(n > 0, F.greatest(F.sqrt(-2 * F.log(r)) / HOUR_TO_RADIANS, F.lit(0.5)))


def circular_distance(a: Column, b: Column) -> Column:
    gap = F.pmod(F.abs(a - b), F.lit(24.0))
    return F.least(gap, F.lit(24.0) - gap)


def clip(x: Column, low: float, high: float) -> Column:
    """Clip that keeps null null (``least``/``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def unified_score(a: Column, b: Column, rule: str) -> Column:
    """Row-wise merge of two scores: ``max`` skips nulls, ``mean`` propagates them."""
    if rule == "max":
        return F.greatest(a, b)
    if rule == "mean":
        return (a + b) / 2
    raise ValueError(f"unknown merge rule: {rule}")


def day_offset(us: Column, start_us: Column) -> Column:
    """Whole 24-hour periods since the first event (not calendar days)."""
    return F.floor((us - start_us) / F.lit(86_400_000_000)).cast("int")


def hash_percent(key: Column) -> Column:
    """Stable 0..99 bucket from the md5 of a key: the same in every engine and every run."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
