"""Numeric expressions: distances, vectors, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is, and never NaN for antipodes."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    root = F.sqrt(a)
    # not least(), which takes a null for absent
    return F.lit(2 * EARTH_KM) * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clip(x: Column, low: float, high: float) -> Column:
    """The number brought into a range; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)
