"""Distances on the Earth as Column expressions; the ellipsoid's in an Arrow function."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord(range_km: float) -> float:
    """Length of the chord on the unit sphere that spans a great-circle distance."""
    return 2 * float(np.sin(min(range_km / EARTH_KM, np.pi) / 2))


def hypocentral_km(horizontal_km: Column, depth_km: Column) -> Column:
    """Distance to the source, whose depth counts as 0 above the surface."""
    return F.hypot(horizontal_km, F.greatest(depth_km, F.lit(0.0)))


def sphere_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """haversine_km on arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def rounded(km: np.ndarray, digits: int) -> np.ndarray:
    """Distances to so many digits, halves up, as Spark rounds them: by the digits that a double is written with."""
    scaled = km * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):  # too near for doubles
        out[i] = float(Decimal(repr(float(km[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def ellipsoid_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Vincenty's inverse formula on WGS84, km; nearly antipodal points take the sphere's distance."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    span = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = span.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(200):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            alpha = np.where(s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s == 0, 1, s))
            cos2 = 1 - alpha**2
            mid = np.where(cos2 == 0, 0.0, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 == 0, 1, cos2))
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = span + (1 - k) * f * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        e = cos2 * (a * a - b * b) / (b * b)
        big = 1 + e / 16384 * (4096 + e * (-768 + e * (320 - 175 * e)))
        small = e / 1024 * (256 + e * (-128 + e * (74 - 47 * e)))
        change = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid**2 - 3)))
        km = b * big * (sigma - change) / 1000
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(span / 2) ** 2
    return np.where(done, km, 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1))))


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS84 ellipsoid."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(ellipsoid_km(*(x.to_numpy(float) for x in (a, b, c, d))))

    return F.pandas_udf(run, "double")(lat1, lon1, lat2, lon2)
