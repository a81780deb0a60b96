"""Convex rings: area, clipping, erosion, intersection tests and rasters, in NumPy over Arrow.

A ring is a sequence of (x, y) without the first point repeated; an empty ring has no points.
Footprints at one depth are images of a rectangle, hence convex, which makes every operation
exact. Columns for axis-aligned boxes need no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linalg import num

RING = "array<struct<x:double,y:double>>"


def signed_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring.T
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def oriented(ring: np.ndarray) -> np.ndarray:
    """Counter-clockwise."""
    return ring[::-1] if signed_area(ring) < 0 else ring


def half_plane(ring: np.ndarray, point: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The part of a ring to the left of a line (Sutherland and Hodgman, 1974)."""
    if not len(ring):
        return ring
    side = along[0] * (ring[:, 1] - point[1]) - along[1] * (ring[:, 0] - point[0])
    out = []
    for i, (p, s) in enumerate(zip(ring, side, strict=True)):
        q, t = ring[i - 1], side[i - 1]
        if (s >= 0) != (t >= 0):
            out.append(q + (p - q) * (t / (t - s)))
        if s >= 0:
            out.append(p)
    return np.array(out).reshape(-1, 2)


def clip(ring: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Intersection of two convex rings."""
    by = oriented(by)
    if len(by) < 3:
        return np.empty((0, 2))
    for p, q in zip(by, np.roll(by, -1, axis=0), strict=True):
        ring = half_plane(ring, p, q - p)
    return ring


def erode(ring: np.ndarray, distance: float) -> np.ndarray:
    """Points of a convex ring at least ``distance`` from its edges: every edge moves inwards."""
    ring = out = oriented(ring)
    for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        along = q - p
        length = np.hypot(*along)
        if length:
            out = half_plane(out, p + distance * np.array([-along[1], along[0]]) / length, along)
    return out


def intersects(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two convex rings touch or overlap: no edge's line separates them."""
    if len(a) < 1 or len(b) < 1:
        return False
    for ring in (a, b):
        edges = np.roll(ring, -1, axis=0) - ring
        for dx, dy in edges:
            axis = np.array([-dy, dx])
            p, q = a @ axis, b @ axis
            if p.max() < q.min() or q.max() < p.min():
                return False
    return True


def fill(ring: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Raster of pixels whose centres lie inside a convex ring (left and top edges count)."""
    out = np.zeros((rows, cols), np.uint8)
    if len(ring) < 3:
        return out
    y, x = np.mgrid[0:rows, 0:cols] + 0.5
    inside = np.ones((rows, cols), bool)
    ring = oriented(ring)
    for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        dx, dy = q - p
        side = dx * (y - p[1]) - dy * (x - p[0])
        inside &= (side > 0) | ((side == 0) & ((dy < 0) | ((dy == 0) & (dx > 0))))
    out[inside] = 1
    return out


def _ring(values: Sequence | None) -> np.ndarray:
    if values is None or not len(values):
        return np.empty((0, 2))
    first = values[0]
    return np.array([(v["x"], v["y"]) for v in values] if isinstance(first, dict) else [tuple(v)[:2] for v in values], float)


@F.pandas_udf(T.DoubleType())
def overlap_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Area of the intersection over the left ring's; 0 if that has none."""
    out = []
    for a, b in zip(left, right, strict=True):
        a, b = _ring(a), _ring(b)
        area = abs(signed_area(a))
        out.append(abs(signed_area(clip(a, b))) / area if area else 0.0)
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def common_area(rings: pd.Series, distance: pd.Series) -> pd.Series:
    """Intersection of all of a row's rings, then eroded."""
    out = []
    for many, d in zip(rings, distance, strict=True):
        own = [_ring(r) for r in many]
        ring = own[0] if own else np.empty((0, 2))
        for other in own[1:]:
            ring = clip(ring, other)
        out.append(erode(ring, d).tolist() if len(ring) else [])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def eroded(ring: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([erode(own, d).tolist() if len(own := _ring(r)) else [] for r, d in zip(ring, distance, strict=True)])


@F.pandas_udf(T.BooleanType())
def touches(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([intersects(_ring(x), _ring(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def ring_area(ring: Column) -> Column:
    """Area of a ring column of arrays, by the shoelace formula, without Python."""
    n = F.size(ring)
    each = F.transform(ring, lambda p, i: p[0] * F.get(ring, (i + 1) % n)[1] - F.get(ring, (i + 1) % n)[0] * p[1])
    return F.abs(F.aggregate(each, num(0), lambda a, x: a + x)) / num(2)


def box_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area shared by boxes (x0, y0, x1, y1)."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, num(0)) * F.greatest(height, num(0))


def box_touches(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
