"""Linear interpolation of rasters on triangles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laserloom.geometry.hull import delaunay
from laserloom.operators import grid


def fill_linear(values: np.ndarray) -> np.ndarray:
    """NaN cells of an array by linear interpolation on the Delaunay triangles of the others; cells outside all
    triangles stay NaN."""
    out = values.copy()
    i, j = np.nonzero(~np.isnan(values))
    gap = np.isnan(values)
    if not gap.any() or len(i) < 3:
        return out
    # only cells next to a gap can be corners of a triangle that covers part of it
    near = gap.copy()
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            near |= np.roll(gap, (a, b), (0, 1))
    keep = near[i, j]
    i, j = i[keep], j[keep]
    pts = np.column_stack([i, j]).astype(float)
    tri = delaunay(pts)
    if tri is None:
        return out
    v = values[i, j]
    for t in tri:
        p = pts[t]
        lo, hi = np.ceil(p.min(0) - 1e-9).astype(int), np.floor(p.max(0) + 1e-9).astype(int)
        if not gap[lo[0] : hi[0] + 1, lo[1] : hi[1] + 1].any():
            continue
        m = np.array([p[1] - p[0], p[2] - p[0]]).T
        det = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
        if abs(det) < 1e-12:
            continue
        a, b = np.meshgrid(np.arange(lo[0], hi[0] + 1), np.arange(lo[1], hi[1] + 1), indexing="ij")
        qx, qy = a - p[0, 0], b - p[0, 1]
        u = (qx * m[1, 1] - qy * m[0, 1]) / det
        w = (qy * m[0, 0] - qx * m[1, 0]) / det
        hit = (u >= -1e-9) & (w >= -1e-9) & (u + w <= 1 + 1e-9) & gap[a, b]
        out[a[hit], b[hit]] = (v[t[0]] + u * (v[t[1]] - v[t[0]]) + w * (v[t[2]] - v[t[0]]))[hit]
    return out


def linear_cells(cells: DataFrame, ref: grid.GridRef, value: str = "value", tile: int = 64, halo: int = 32) -> DataFrame:
    """The given cells with their values, interpolated where they have none; null where no triangle within
    `halo` cells covers it."""
    d = cells.select("row", "col", F.col(value).cast("double").alias("v"))
    got = grid.tiled(d, ["v"], tile, halo, lambda a, present, r0, c0: {"f": fill_linear(a["v"])}, {"f": T.DoubleType()})
    return got.select("row", "col", F.when(~F.isnan("f"), F.col("f")).alias(value))


def fill_natural(values: np.ndarray, reach: int = 24) -> np.ndarray:
    """NaN cells by discrete natural neighbours: each cell hands the value of its nearest node to all cells nearer to
    it than that node; a cell's value is the mean of what it was handed. Cells with a value keep it; cells farther
    than `reach` from their node hand nothing on."""
    from laserloom.operators.grid import _nearest

    valid = ~np.isnan(values)
    if not valid.any() or valid.all():
        return values.copy()
    who, dist = _nearest(valid)
    v = values.ravel()[np.maximum(who, 0)]
    total, n = np.zeros(values.shape), np.zeros(values.shape)
    h, w = values.shape
    square = np.round(np.minimum(dist, 1e6) ** 2).astype(np.int64)
    for d2 in np.unique(square[square <= reach * reach]).tolist():
        at = square == d2
        r = int(np.sqrt(d2))
        put, one = np.where(at, v, 0.0), at.astype(float)
        for i in range(-r, r + 1):
            j = int(np.sqrt(max(d2 - i * i, 0)))
            # cells within reach along a row: differences of running sums
            for src, out in ((put, total), (one, n)):
                s = np.concatenate([np.zeros((h, 1)), np.cumsum(src, axis=1)], axis=1)
                lo, hi = np.clip(np.arange(w) - j, 0, w), np.clip(np.arange(w) + j + 1, 0, w)
                row = s[:, hi] - s[:, lo]
                a, b = max(0, i), min(h, h + i)
                out[a:b] += row[a - i : b - i]
    with np.errstate(all="ignore"):
        return np.where(valid, values, total / n)


def natural_cells(cells: DataFrame, ref: grid.GridRef, value: str = "value", tile: int = 64, halo: int = 48) -> DataFrame:
    """The given cells by natural neighbours within half of `halo` cells; null where there is no node so near."""
    d = cells.select("row", "col", F.col(value).cast("double").alias("v"))
    got = grid.tiled(d, ["v"], tile, halo, lambda a, present, r0, c0: {"f": fill_natural(a["v"], halo // 2)}, {"f": T.DoubleType()})
    return got.select("row", "col", F.when(~F.isnan("f"), F.col("f")).alias(value))


def on_triangles(nodes: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation at positions; NaN outside the nodes' triangles."""
    out = np.full(len(at), np.nan)
    if len(nodes) < 3 or not len(at):
        return out
    tri = delaunay(nodes)
    if tri is None:
        return out
    order = np.argsort(at[:, 0], kind="stable")
    xs = at[order, 0]
    p = nodes[tri]
    lo = np.searchsorted(xs, p[:, :, 0].min(1) - 1e-9)
    hi = np.searchsorted(xs, p[:, :, 0].max(1) + 1e-9, side="right")
    for t in np.flatnonzero(hi > lo):
        rows = order[lo[t] : hi[t]]
        a, b, c = p[t]
        det = (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
        if abs(det) < 1e-12:
            continue
        q = at[rows] - a
        u = (q[:, 0] * (c[1] - a[1]) - q[:, 1] * (c[0] - a[0])) / det
        w = (q[:, 1] * (b[0] - a[0]) - q[:, 0] * (b[1] - a[1])) / det
        hit = (u >= -1e-9) & (w >= -1e-9) & (u + w <= 1 + 1e-9)
        k = values[tri[t]]
        out[rows[hit]] = (k[0] + u * (k[1] - k[0]) + w * (k[2] - k[0]))[hit]
    return out


def linear_ground(points: DataFrame, ground: DataFrame, row_id: str, tile: float = 32.0, halo: float = 12.0, node: float = 1.0, piece: int = 20_000) -> DataFrame:
    """row_id, ground: height of the ground at each point, on the triangles of the ground returns of its tile
    and a halo. Returns are first averaged per square of side `node`, so a tile's triangles are bounded."""
    k = lambda col: F.floor(F.col(col) / F.lit(tile)).cast("long")
    g = ground.where("x is not null and y is not null and z is not null").groupBy(F.floor(F.col("x") / node).alias("i"), F.floor(F.col("y") / node).alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    near = lambda col: F.explode(F.sequence(F.floor((F.col(col) - F.lit(halo)) / F.lit(tile)).cast("long"), F.floor((F.col(col) + F.lit(halo)) / F.lit(tile)).cast("long")))
    g = g.withColumn("tx", near("x")).withColumn("ty", near("y")).select("tx", "ty", "x", "y", "z")
    nodes = g.groupBy("tx", "ty").agg(F.collect_list(F.struct("x", "y", "z")).alias("nodes"))
    # a tile's points come in pieces of bounded size, each with the tile's nodes
    p = points.select(F.col(row_id).alias("id"), "x", "y").where("id is not null and x is not null and y is not null").distinct()
    p = p.withColumns({"tx": k("x"), "ty": k("y")})
    n = p.groupBy("tx", "ty").agg(F.ceil(F.count("*") / F.lit(piece)).cast("long").alias("k"))
    p = p.join(n, ["tx", "ty"]).withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")))
    packed = p.groupBy("tx", "ty", "s").agg(F.collect_list(F.struct("id", "x", "y")).alias("points")).join(nodes, ["tx", "ty"])
    packed = packed.repartition(4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty", "s")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def heights(pts, nds):
        import pandas as pd

        out = []
        for a, b in zip(pts, nds):
            at = np.array([(r["x"], r["y"]) for r in a], float)
            n = np.array([(r["x"], r["y"], r["z"]) for r in b], float)
            n = n[np.lexsort((n[:, 1], n[:, 0]))]
            low = n[:, :2].min(0)
            out.append(on_triangles(n[:, :2] - low, n[:, 2], at - low).tolist())
        return pd.Series(out)

    got = packed.select(F.explode(F.arrays_zip(F.col("points"), heights("points", "nodes").alias("h"))).alias("q"))
    return got.select(F.col("q.points.id").alias(row_id), F.col("q.h").alias("ground")).where("ground is not null and not isnan(ground)")
