"""Filters on points: classes, polygons, sections. All are column expressions of the scan's rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]


def of_class(classes: Sequence[int], column: str = "classification") -> Column:
    return F.col(column).isin(*classes)


def labelled(column: str = "label") -> Column:
    """Belongs to a segment (0 and null do not)."""
    return F.coalesce(F.col(column) != 0, F.lit(False))


def close_ring(ring: Ring) -> list[tuple[float, float]]:
    """The ring with its first vertex repeated at the end; ValueError for fewer than three vertices."""
    r = [(float(a), float(b)) for a, b in ring]
    if len(r) > 1 and r[0] == r[-1]:
        r = r[:-1]
    if len(r) < 3:
        raise ValueError("a polygon needs three vertices")
    return [*r, r[0]]


def in_box(x: Column, y: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Bounds that Parquet statistics can prune by."""
    return x.between(F.lit(float(xmin)), F.lit(float(xmax))) & y.between(F.lit(float(ymin)), F.lit(float(ymax)))


def in_polygon(x: Column, y: Column, rings: Ring | Sequence[Ring], tolerance: float = 1e-9) -> Column:
    """Inside or on the edge of a polygon of a few hundred vertices, even-odd over its rings. The box
    test stands first, so that it reaches the scan. For many or large polygons use spatial.in_regions."""
    many = [rings] if isinstance(rings[0][0], (int, float)) else list(rings)
    closed = [close_ring(r) for r in many]
    xs, ys = [p[0] for r in closed for p in r], [p[1] for r in closed for p in r]
    edges = [(a, b) for r in closed for a, b in zip(r[:-1], r[1:])]
    crossings: list[Column] = []
    on: list[Column] = []
    for (x1, y1), (x2, y2) in edges:
        if y1 != y2:
            slope = (x2 - x1) / (y2 - y1)
            crossings.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - F.lit(y1)) * F.lit(slope) + F.lit(x1))).cast("int"))
        length = math.hypot(x2 - x1, y2 - y1)
        if length:
            cross = (x - F.lit(x1)) * F.lit((y2 - y1) / length) - (y - F.lit(y1)) * F.lit((x2 - x1) / length)
            along = (x - F.lit(x1)) * F.lit((x2 - x1) / length) + (y - F.lit(y1)) * F.lit((y2 - y1) / length)
            on.append((F.abs(cross) <= F.lit(tolerance)) & along.between(F.lit(-tolerance), F.lit(length + tolerance)))
    inside = reduce(lambda a, b: a + b, crossings) % 2 == 1
    edge = reduce(lambda a, b: a | b, on)
    return in_box(x, y, min(xs) - tolerance, min(ys) - tolerance, max(xs) + tolerance, max(ys) + tolerance) & (inside | edge)


def clip(points: DataFrame, rings: Ring | Sequence[Ring], x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose position lies in the polygon, with all their columns."""
    return points.where(in_polygon(F.col(x), F.col(y), rings))


def cross_section(points: DataFrame, p0: tuple[float, float], p1: tuple[float, float], width: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Points at most `width` off the line p0 to p1 and between its ends, with rho (distance
    along the line from p0) and d (distance from the line's vertical plane); z is the profile's height.

    width is the half-width: the footprint reaches so far to either side."""
    length = math.hypot(p1[0] - p0[0], p1[1] - p0[1])
    if not length or width <= 0:
        raise ValueError("a section needs two different ends and a positive width")
    ux, uy = (p1[0] - p0[0]) / length, (p1[1] - p0[1]) / length
    corners = [(p0[0] - uy * width, p0[1] + ux * width), (p1[0] - uy * width, p1[1] + ux * width), (p1[0] + uy * width, p1[1] - ux * width), (p0[0] + uy * width, p0[1] - ux * width)]
    inside = points.where(in_polygon(F.col(x), F.col(y), corners))
    qx, qy = F.col(x) - F.lit(float(p0[0])), F.col(y) - F.lit(float(p0[1]))
    return inside.withColumns({"rho": F.abs(qx * F.lit(ux) + qy * F.lit(uy)), "d": F.abs(qx * F.lit(uy) - qy * F.lit(ux))})


def clamp_heights(h: Column) -> Column:
    """Heights below ground become 0; null stays null."""
    return F.when(h < 0, F.lit(0.0)).otherwise(h)


def thresholded(value: Column, segment_max: Column, least: float = 3.0) -> Column:
    """value, but null where its segment does not exceed `least` or the value is 0."""
    return F.when((segment_max > F.lit(least)) & (value != 0), value)


def threshold_classes(value: Column, edges: Sequence[float]) -> Column:
    """0 below the first edge, 1 from it on, 2 from the second on, ...; null for null."""
    out = F.lit(0)
    for k, e in enumerate(edges):
        out = F.when(value >= F.lit(float(e)), F.lit(k + 1)).otherwise(out)
    return F.when(value.isNotNull(), out)
