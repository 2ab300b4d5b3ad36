"""First P and S arrivals in a spherical Earth of layers, as Column expressions over a table made once on the driver.

In a shell where speed is a power of the radius, time and distance along a ray have closed forms. Rays of many ray parameters, up
from the source and down to their turning points, give distance and time; at a distance the first arrival is the least time
among the rays that bracket it, and along a branch time grows with distance by the ray parameter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: The ak135 model, depth in km, speeds of P and S in km/s, down to where rays of up to 25 degrees turn.
AK135 = (
    (0, 5.8, 3.46), (20, 5.8, 3.46), (20, 6.5, 3.85), (35, 6.5, 3.85), (35, 8.04, 4.48), (77.5, 8.045, 4.49), (120, 8.05, 4.5), (165, 8.175, 4.509),
    (210, 8.3, 4.518), (210, 8.3, 4.523), (260, 8.4825, 4.609), (310, 8.665, 4.696), (360, 8.8475, 4.783), (410, 9.03, 4.87), (410, 9.36, 5.08), (460, 9.528, 5.186),
    (510, 9.696, 5.292), (560, 9.864, 5.398), (610, 10.032, 5.504), (660, 10.2, 5.61), (660, 10.79, 5.96), (710, 10.9229, 6.0897), (760, 11.0558, 6.2095), (809.5, 11.1353, 6.2426),
)
#: Largest distance in degrees and depth in km; steps of the table.
FURTHEST, DEEPEST = 25.0, 700.0
DEGREES = np.unique(np.concatenate([np.arange(0, 4, 0.02), np.arange(4, FURTHEST + 0.05, 0.05)]))
DEPTHS = np.unique(np.concatenate([np.arange(0, 60, 1.0), np.arange(60, DEEPEST + 5, 10.0)]))


def _shells(phase: str, cut: float) -> list[tuple[float, float, float, float]]:
    """(radius above, radius below, speed above, speed below), from the top, with a boundary at the depth `cut`."""
    column = {"P": 1, "S": 2}[phase]
    out = []
    for a, b in zip(AK135[:-1], AK135[1:], strict=True):
        if b[0] == a[0]:
            continue
        parts = [a[0], *([cut] if a[0] < cut < b[0] else []), b[0]]
        r = [RADIUS_KM - z for z in parts]
        power = np.log(b[column] / a[column]) / np.log(r[-1] / r[0])
        v = [a[column] * (x / r[0]) ** power for x in r]
        out += [(r[k], r[k + 1], v[k], v[k + 1]) for k in range(len(parts) - 1)]
    return out


def _legs(shells: list[tuple], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angle and time of each ray (rows) in each shell (columns), and whether the ray gets through it; one that turns has its way down to the turning point, and nothing below."""
    angle, time, through = (np.zeros((len(p), len(shells))) for _ in range(3))
    alive = np.ones(len(p), bool)
    for k, (r1, r2, v1, v2) in enumerate(shells):
        top, low = r1 / v1, r2 / v2
        power = np.log(v2 / v1) / np.log(r2 / r1)
        own = alive & (p < top)
        deep = np.maximum(low, p)
        angle[own, k] = (np.arccos(p[own] / top) - np.arccos(np.minimum(p[own] / deep[own], 1))) / (1 - power)
        time[own, k] = (np.sqrt(top**2 - p[own] ** 2) - np.sqrt(np.maximum(deep[own] ** 2 - p[own] ** 2, 0))) / (1 - power)
        through[:, k] = own & (p <= low)
        alive = own & (p <= low)
    return angle, time, through


def _first(degrees: np.ndarray, depth: float, phase: str) -> np.ndarray:
    shells = _shells(phase, depth)
    above = sum(r1 > RADIUS_KM - depth + 1e-9 for r1, *_ in shells)
    # near each shell's own ray parameter rays are close to one another
    grid = np.unique(np.concatenate([np.linspace(0, RADIUS_KM / shells[0][2], 3000), *(np.linspace(r2 / v2, r1 / v1, 200) for r1, r2, v1, v2 in shells), *(r1 / v1 * (1 - np.geomspace(1e-9, 1e-2, 60)) for r1, _, v1, _ in shells)]))
    angle, time, through = _legs(shells, grid)
    rays = []
    if above:
        up = through[:, :above].all(1)
        rays.append((angle[:, :above].sum(1), time[:, :above].sum(1), up))
    turned = ~through[:, -1].astype(bool) & (through[:, :above].all(1) if above else True) & (angle[:, above:].sum(1) > 0)
    rays.append((angle[:, :above].sum(1) + 2 * angle[:, above:].sum(1), time[:, :above].sum(1) + 2 * time[:, above:].sum(1), turned))
    best = np.full(len(degrees), np.inf)
    want = np.radians(degrees)
    for x, t, ok in rays:
        x, t, q = x[ok], t[ok], grid[ok]
        low, high = np.minimum(x[1:], x[:-1]), np.maximum(x[1:], x[:-1])
        first, last = np.searchsorted(want, low - 1e-12), np.searchsorted(want, high + 1e-12)
        count = np.where(high - low < np.radians(1.0), last - first, 0)  # no pair over a gap between branches
        pair = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + first[pair]
        np.minimum.at(best, at, t[pair] + (want[at] - x[pair]) * (q[pair] + q[pair + 1]) / 2)
    known = np.isfinite(best)
    best = np.interp(want, want[known], best[known])
    if depth == 0:
        best[0] = 0.0
    return best


@lru_cache
def table(phase: str) -> np.ndarray:
    """Seconds of the first arrival by depth and distance, over DEPTHS and DEGREES."""
    return np.array([_first(DEGREES, float(z), phase) for z in DEPTHS])


def seconds(degrees: np.ndarray, depth_km: np.ndarray, phase: str = "P", of: np.ndarray | None = None) -> np.ndarray:
    """Travel time of the first P or S, between the table's nodes on straight lines; NaN beyond 25 degrees or 700 km. A depth above the surface counts as 0."""
    of = table(phase) if of is None else of
    z = np.maximum(depth_km, 0)
    bad = ~((degrees >= 0) & (degrees <= FURTHEST) & (z <= DEEPEST))
    x, z = np.where(bad, 0, degrees), np.where(bad, 0, z)
    i = np.clip(np.searchsorted(DEGREES, x, side="right") - 1, 0, len(DEGREES) - 2)
    j = np.clip(np.searchsorted(DEPTHS, z, side="right") - 1, 0, len(DEPTHS) - 2)
    a, b = (x - DEGREES[i]) / (DEGREES[i + 1] - DEGREES[i]), (z - DEPTHS[j]) / (DEPTHS[j + 1] - DEPTHS[j])
    out = (1 - b) * ((1 - a) * of[j, i] + a * of[j, i + 1]) + b * ((1 - a) * of[j + 1, i] + a * of[j + 1, i + 1])
    return np.where(bad, np.nan, out)


def travel_seconds(degrees: Column, depth_km: Column, phase: str = "P") -> Column:
    """`seconds` of columns; null where either is null or out of reach."""
    of = table(phase)

    def run(x: pd.Series, z: pd.Series) -> pd.Series:
        found = seconds(x.to_numpy(float), z.to_numpy(float), phase, of)
        return pd.Series(np.where(np.isnan(found), None, found), dtype=object)

    return F.pandas_udf(run, "double")(degrees, depth_km)
