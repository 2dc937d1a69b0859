"""Distances and map positions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    """Great-circle distance; null if a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(_c(lat2))
    half = lambda d: F.pow(F.sin(d / 2), F.lit(2.0))
    a = half(p2 - p1) + F.cos(p1) * F.cos(p2) * half(F.radians(_c(lon2)) - F.radians(lon1))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def project(lat: Column, lon: Column, lat0: float, lon0: float, km_side: float, pixels: float) -> tuple[Column, Column]:
    """Equirectangular x and y in pixels on a square map of ``km_side`` around the anchor."""
    km = 111.32
    scale = pixels / km_side
    return (lon - lon0) * km * F.cos(F.radians(F.lit(lat0))) * scale + pixels / 2, (lat0 - lat) * km * scale + pixels / 2


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)
