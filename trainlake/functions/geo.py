"""Distances and coordinate systems."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: Krasovsky ellipsoid, as the GCJ-02 shift uses it.
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594323


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places in degrees; null if any is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = lambda d: F.pow(F.sin(d / 2), 2)
    a = half(p2 - p1) + F.cos(p1) * F.cos(p2) * half(F.radians(lon2 - lon1))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _wave(x: Column, *terms: tuple[float, float]) -> Column:
    return sum((amp * F.sin(x * (math.pi / period)) for amp, period in terms), F.lit(0.0)) * (2.0 / 3.0)


def wgs84_to_gcj02(lat: Column, lon: Column) -> Column:
    """struct(lat, lon) shifted to GCJ-02; places outside 72.004..137.8347 E, 0.8293..55.8271 N are returned as they are."""
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    ripple = _wave(x, (20.0, 1 / 6), (20.0, 1 / 2))
    d_lat = -100.0 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + ripple + _wave(y, (20.0, 1.0), (40.0, 3.0)) + _wave(y, (160.0, 12.0), (320.0, 30.0))
    d_lon = 300.0 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + ripple + _wave(x, (20.0, 1.0), (40.0, 3.0)) + _wave(x, (150.0, 12.0), (300.0, 30.0))
    s = F.sin(F.radians(lat))
    magic = 1 - GCJ_EE * s * s
    north = d_lat * 180.0 / ((GCJ_A * (1 - GCJ_EE)) / (magic * F.sqrt(magic)) * math.pi)
    east = d_lon * 180.0 / (GCJ_A / F.sqrt(magic) * F.cos(F.radians(lat)) * math.pi)
    out = ~(lon.between(72.004, 137.8347) & lat.between(0.8293, 55.8271))
    return F.struct(F.when(out, lat).otherwise(lat + north).alias("lat"), F.when(out, lon).otherwise(lon + east).alias("lon"))
