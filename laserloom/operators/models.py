"""Terrain, surface, height and density models of a point cloud, and heights above ground."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laserloom.operators import grid
from laserloom.operators.grid import GridRef
from laserloom.session import materialise

LAYERS = ("terrain", "surface", "height", "density")


def density_models(points: DataFrame, ref: GridRef, mask: DataFrame, class_terrain: Sequence[int], class_surface: Sequence[int]) -> DataFrame:
    """row, col, density_overall, density_terrain, density_surface: returns in each cell of the mask."""
    d = grid.with_cell(points, ref)
    one = lambda cs: F.sum(F.col("classification").isin(*cs).cast("long"))
    n = d.groupBy("row", "col").agg(F.count("*").alias("density_overall"), one(class_terrain).alias("density_terrain"), one(class_surface).alias("density_surface"))
    cols = ["density_overall", "density_terrain", "density_surface"]
    return mask.join(n, ["row", "col"], "left").select("row", "col", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in cols])


def density_summary(density: DataFrame, value: str = "density_overall") -> DataFrame:
    """One row: median, mean, max and std of a density layer."""
    v = F.col(value).cast("double")
    return density.agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"))


def _over(cells: DataFrame, ref: GridRef, within: DataFrame | None) -> DataFrame:
    """cells on the whole grid, or only on the cells of `within` (and their own), with nulls where they have none."""
    if within is None:
        return grid.densify(cells, ref)
    where = within.select("row", "col").unionByName(cells.select("row", "col")).distinct()
    return where.join(cells, ["row", "col"], "left")


def _filled(cells: DataFrame, ref: GridRef, within: DataFrame | None) -> DataFrame:
    """row, col, value of _over(cells, ref, within), filled from the nearest cell."""
    full = grid.nearest_fill(cells, ref, whole=True) if within is None else grid.nearest_fill(_over(cells, ref, within), ref)
    return full.select("row", "col", "value")


def terrain_model(points: DataFrame, ref: GridRef, *, class_terrain: Sequence[int] = (2, 9), method: str = "idw", radius: float = math.inf, weight: Callable[[float], float] = grid.cubic, kernel: list[list[float]] | None = None, within: DataFrame | None = None) -> DataFrame:
    """row, col, terrain on the whole grid (or on the cells of `within`, if nothing is smoothed): cell means of the ground returns, interpolated (idw, nearest, linear or natural), then
    filled from the nearest cell and smoothed. ValueError without a ground return."""
    ground = points.where(F.col("classification").isin(*class_terrain) & F.col("z").isNotNull())
    within = None if kernel is not None else within
    cells = materialise(grid.rasterize(ground, ref, "z", "mean"), "ground")
    if not cells.head(1):
        raise ValueError("no ground return")
    if method == "nearest":
        full = _filled(cells, ref, within)
    elif method == "idw":
        if math.isinf(radius):
            r = max(1, math.ceil(grid.reach(cells, ref)))  # over the whole grid, whatever cells are asked for
        else:
            r = math.ceil(radius / abs(ref.dx))
        full = _over(grid.idw(cells, ref, r, weight), ref, within)
        full = grid.nearest_fill(full, ref).select("row", "col", "value")
    elif method in ("linear", "natural"):
        from laserloom.geometry.interpolate import linear_cells, natural_cells

        some = (linear_cells if method == "linear" else natural_cells)(_over(cells, ref, within), ref)
        full = grid.nearest_fill(some, ref).select("row", "col", "value")
    else:
        raise ValueError(f"method must be idw, nearest, linear or natural, not {method!r}")
    if kernel is not None:
        full = grid.focal(full, ref, kernel)
    return full.withColumnRenamed("value", "terrain")


def surface_model(points: DataFrame, ref: GridRef, *, classes: Sequence[int] = (2, 9, 3, 4, 5, 6), kernel: list[list[float]] | None = None, within: DataFrame | None = None) -> DataFrame:
    """row, col, surface on the whole grid (or on the cells of `within`, if nothing is smoothed): highest return of a cell, filled from the nearest, smoothed."""
    top = grid.rasterize(points.where(F.col("classification").isin(*classes)), ref, "z", "max")
    full = _filled(top, ref, None if kernel is not None else within)
    if kernel is not None:
        full = grid.focal(full, ref, kernel)
    return full.withColumnRenamed("value", "surface")


def elevation_models(points: DataFrame, ref: GridRef, *, layers: Sequence[str] = LAYERS, class_terrain: Sequence[int] = (2, 9), class_surface: Sequence[int] = (3, 4, 5, 6), closing: float = 1.0, method: str = "idw", radius: float = math.inf, weight: Callable[[float], float] = grid.cubic, kernel: list[list[float]] | None = None) -> DataFrame:
    """One row for each cell of the data mask with the layers asked for: terrain, surface, height,
    density_*. height needs the other two and is never negative; surface implies terrain."""
    bad = set(layers) - set(LAYERS)
    if bad:
        raise ValueError(f"unknown layers {sorted(bad)}")
    out = mask = materialise(grid.data_mask(points, ref, closing=closing), "mask")
    if "density" in layers:
        out = density_models(points, ref, mask, class_terrain, class_surface)
    if {"terrain", "surface", "height"} & set(layers):
        out = out.join(terrain_model(points, ref, class_terrain=class_terrain, method=method, radius=radius, weight=weight, kernel=kernel, within=mask), ["row", "col"], "left")
    if {"surface", "height"} & set(layers):
        out = out.join(surface_model(points, ref, classes=[*class_terrain, *class_surface], kernel=kernel, within=mask), ["row", "col"], "left")
    if "height" in layers:
        h = F.col("surface") - F.col("terrain")
        out = out.withColumn("height", F.when(h < 0, F.lit(0.0)).otherwise(h))
    return out


def nearest_point(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, xy: tuple[str, str] = ("x", "y"), carry: str = "z", start: float = 2.0) -> DataFrame:
    """left id, dist, nearest id and `carry` of the nearest right point in the plane.

    Both sides meet on square buckets and their neighbours; whoever finds no partner within a bucket's width
    goes to the next round with buckets four times as wide. Of equal distances (to 1e-9) the smallest id wins.
    Nothing is returned where the right side is empty; null positions take no part."""
    a = left.select(F.col(left_id).alias("__l"), F.col(xy[0]).alias("lx"), F.col(xy[1]).alias("ly")).where("__l is not null and lx is not null and ly is not null").distinct()
    b = materialise(right.select(F.col(right_id).alias("__r"), F.col(xy[0]).alias("rx"), F.col(xy[1]).alias("ry"), F.col(carry).alias("__c")).where("__r is not null and rx is not null and ry is not null"), "nearest")
    if not b.head(1):
        return a.select(F.col("__l").alias(left_id), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias(carry)).limit(0)
    open_rows, done, width = materialise(a, "nearest"), [], start
    while open_rows.head(1):
        k = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")  # noqa: E731, B023
        around = lambda c: F.explode(F.sequence(k(c) - 1, k(c) + 1))  # noqa: E731, B023
        lo = open_rows.withColumn("bx", around("lx")).withColumn("by", around("ly"))
        ro = b.withColumns({"bx": k("rx"), "by": k("ry")})
        d = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
        j = lo.join(ro, ["bx", "by"]).select("__l", "__r", "__c", d.alias("d")).where(F.col("d") <= width)
        best = j.groupBy("__l").agg(F.min_by(F.struct("d", "__r", "__c"), F.struct(F.round("d", 9), F.col("__r"))).alias("b"))
        best = materialise(best, "nearest")
        done.append(best)
        open_rows = materialise(open_rows.join(best, "__l", "left_anti"), "nearest")
        width *= 4
    if not done:
        return a.select(F.col("__l").alias(left_id), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias(carry)).limit(0)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("__l").alias(left_id), F.col("b.d").alias("dist"), F.col("b.__r").alias("nearest"), F.col("b.__c").alias(carry))


def heights(points: DataFrame, *, class_terrain: Sequence[int] = (2,), method: str = "nearest", row_id: str = "pid") -> DataFrame:
    """Points with h, their height above the ground, never negative.

    The ground is that of the nearest ground return, or (method linear) lies on the triangles of the returns, and
    off them is again that of the nearest. Points without a position, or a cloud without ground, get a null h."""
    if method not in ("nearest", "linear"):
        raise ValueError(f"method must be nearest or linear, not {method!r}")
    ground = points.where(F.col("classification").isin(*class_terrain) & F.col("z").isNotNull())
    todo, lin = points, None
    if method == "linear":
        from laserloom.geometry.interpolate import linear_ground

        lin = materialise(linear_ground(points, ground, row_id), "ground")
        todo = points.join(lin.select(row_id), row_id, "left_anti")
    near = nearest_point(todo, ground, left_id=row_id, right_id=row_id).select(F.col(row_id).alias("__id"), F.col("z").alias("__ground"))
    if lin is not None:
        near = near.unionByName(lin.select(F.col(row_id).alias("__id"), F.col("ground").alias("__ground")))
    d = points.join(near, F.col(row_id) == F.col("__id"), "left")
    h = F.col("z") - F.col("__ground")
    return d.withColumn("h", F.when(h < 0, F.lit(0.0)).otherwise(h)).drop("__id", "__ground")
