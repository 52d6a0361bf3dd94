"""Great-circle distance as a column expression and as a NumPy helper for tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from ..constants import EARTH_RADIUS_KM, METRES_PER_DEGREE


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def haversine_matrix(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Distances in km between every point of one array and every point of the other."""
    a1, o1 = np.radians(lat1)[:, None], np.radians(lon1)[:, None]
    a2, o2 = np.radians(lat2)[None, :], np.radians(lon2)[None, :]
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def offset_metres(lat: Column, lon: Column, height: Column,
                  ref_lat: Column, ref_lon: Column, ref_height: Column) -> Column:
    """Flat-earth distance in metres from a reference fix, height included."""
    north = (lat - ref_lat) * F.lit(METRES_PER_DEGREE)
    east = (lon - ref_lon) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(ref_lat))
    up = height - ref_height
    return F.sqrt(north * north + east * east + up * up)
