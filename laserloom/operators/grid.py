"""Rasters as long tables (row, col, value) on a grid reference.

Sparse by nature: only cells with data exist unless a dense domain is asked for. Neighbourhood operators
scatter each cell to its neighbours and aggregate while the neighbourhood is small; larger ones work on
square tiles with a halo, one bounded numpy array per group.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laserloom.session import materialise


@dataclass(frozen=True)
class GridRef:
    """row = round((y - y0) / dy), col = round((x - x0) / dx), both from 1."""

    x0: float
    y0: float
    dx: float
    dy: float
    nrows: int
    ncols: int

    def row(self, y: Column) -> Column:
        return F.round((y - F.lit(self.y0)) / F.lit(self.dy)).cast("int")

    def col(self, x: Column) -> Column:
        return F.round((x - F.lit(self.x0)) / F.lit(self.dx)).cast("int")

    def xy(self, row: Column, col: Column) -> tuple[Column, Column]:
        """Cell to map."""
        return F.lit(self.x0) + col * F.lit(self.dx), F.lit(self.y0) + row * F.lit(self.dy)

    def inside(self) -> Column:
        return F.col("row").between(1, self.nrows) & F.col("col").between(1, self.ncols)


def grid_over(points: DataFrame, cell: float, x: str = "x", y: str = "y") -> GridRef:
    """The default reference: the first cell is centred on the least x and the greatest y. One pass."""
    if cell <= 0:
        raise ValueError("the cell size must be positive")
    a = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if a[0] is None:
        return GridRef(0.0, 0.0, cell, -cell, 0, 0)
    x0, y0 = a[0] - cell, a[3] + cell
    half = lambda v: math.floor(v + 0.5)
    return GridRef(x0, y0, cell, -cell, half((a[2] - y0) / -cell), half((a[1] - x0) / cell))


def with_cell(points: DataFrame, ref: GridRef, x: str = "x", y: str = "y", clip: bool = True) -> DataFrame:
    """Add row and col (replacing columns of these names). Points off the grid or without a position are left out, or with clip=False keep a
    null cell."""
    d = points.withColumns({"row": ref.row(F.col(y)), "col": ref.col(F.col(x))})
    if clip:
        return d.where(ref.inside())
    ok = ref.inside()
    return d.withColumn("__ok", ok).withColumns({c: F.when(F.col("__ok"), F.col(c)) for c in ("row", "col")}).drop("__ok")


FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "median": F.median,
    "any": lambda v: F.bool_or(v != 0),
    "mode": lambda v: F.mode(v, True),
}


def rasterize(points: DataFrame, ref: GridRef, value: str = "z", fun: str | Callable[[Column], Column] = "max", *, fill: float | None = None, dense: bool = False, x: str = "x", y: str = "y", out: str = "value") -> DataFrame:
    """row, col, `out`: an aggregate of the values in each cell. fun: a name of FUNCTIONS (mode: of equals
    the smallest) or any Column -> aggregate Column. dense: every cell of the grid, empty ones with `fill`.
    Null values do not count; no point on the grid gives an empty raster (dense: all `fill`)."""
    f = FUNCTIONS[fun] if isinstance(fun, str) else fun
    r = with_cell(points, ref, x, y).groupBy("row", "col").agg(f(F.col(value)).alias(out))
    return densify(r, ref, out, fill) if dense else r


def domain(df: DataFrame, ref: GridRef) -> DataFrame:
    """All cells of the grid, made in parallel."""
    n = ref.nrows * ref.ncols
    parts = max(1, min(10_000, n // 1_000_000))
    return df.sparkSession.range(0, n, 1, parts).select((F.floor(F.col("id") / ref.ncols) + 1).cast("int").alias("row"), (F.col("id") % ref.ncols + 1).cast("int").alias("col"))


def densify(raster: DataFrame, ref: GridRef, value: str = "value", fill: float | None = None) -> DataFrame:
    d = domain(raster, ref).join(raster, ["row", "col"], "left")
    return d if fill is None else d.withColumn(value, F.coalesce(F.col(value), F.lit(fill).cast(raster.schema[value].dataType)))


def offsets(radius: float) -> list[tuple[int, int, float]]:
    """(row step, col step, distance) within a euclidean radius in cells."""
    r = math.ceil(radius)
    return [(i, j, math.hypot(i, j)) for i in range(-r, r + 1) for j in range(-r, r + 1) if math.hypot(i, j) <= radius]


def _scatter(raster: DataFrame, steps: list[tuple[int, int, float]]) -> DataFrame:
    """Each cell at the places of its neighbours, with the step's weight as w."""
    a = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for i, j, w in steps])
    d = raster.withColumn("__s", F.explode(a))
    return d.withColumns({"row": F.col("row") + F.col("__s.i"), "col": F.col("col") + F.col("__s.j"), "w": F.col("__s.w")}).drop("__s")


def dilate(mask: DataFrame, ref: GridRef, radius: float) -> DataFrame:
    """Cells at most `radius` cells from a cell of the mask (row, col)."""
    return _scatter(mask.select("row", "col"), offsets(radius)).where(ref.inside()).select("row", "col").distinct()


def erode(mask: DataFrame, ref: GridRef, radius: float) -> DataFrame:
    """Cells whose whole neighbourhood (within the grid) belongs to the mask."""
    steps = offsets(radius)
    hit = _scatter(mask.select("row", "col").distinct(), steps).where(ref.inside()).groupBy("row", "col").agg(F.count("*").alias("n"))
    # how many of the steps stay on the grid
    a = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j, _ in steps])
    on = F.size(F.filter(a, lambda s: (F.col("row") + s["i"]).between(1, ref.nrows) & (F.col("col") + s["j"]).between(1, ref.ncols)))
    return hit.where(F.col("n") == on).select("row", "col")


def data_mask(points: DataFrame, ref: GridRef, value: str = "z", closing: float = 1.0) -> DataFrame:
    """Cells with any non-zero value, and those within ceil(closing / cell) cells of one."""
    m = rasterize(points, ref, value, "any").where("value")
    return dilate(m, ref, math.ceil(closing / abs(ref.dx)))


# ---- tiles -------------------------------------------------------------------------------------


def tiled(raster: DataFrame, values: list[str], tile: int, halo: int, work: Callable[[dict[str, np.ndarray], np.ndarray, int, int], dict[str, np.ndarray]], schema: dict[str, T.DataType]) -> DataFrame:
    """Apply `work` to square tiles with a halo.

    work(arrays, present, row of [0, 0], col of [0, 0]) gets one array per value (NaN where absent or
    null) and returns arrays of the same shape; cells that are present in the tile's core are returned.
    A tile holds (tile + 2 halo)^2 cells at most, however dense the data are."""
    near = lambda c: F.sequence(F.floor((F.col(c) - 1 - halo) / tile), F.floor((F.col(c) - 1 + halo) / tile))
    d = raster.select("row", "col", *values).withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    out = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *[T.StructField(k, t) for k, t in schema.items()]])
    size = tile + 2 * halo

    def one(key, pdf):
        import pandas as pd

        r0, c0 = int(key[0]) * tile + 1 - halo, int(key[1]) * tile + 1 - halo
        i, j = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        present = np.zeros((size, size), bool)
        present[i, j] = True
        arrays = {}
        for v in values:
            a = np.full((size, size), np.nan)
            a[i, j] = pdf[v].to_numpy(float)
            arrays[v] = a
        core = np.zeros((size, size), bool)
        core[halo : halo + tile, halo : halo + tile] = True
        got = work(arrays, present, r0, c0) if (core & present).any() else {}
        a, b = np.nonzero(core & present) if got else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"row": (a + r0).astype(np.int32), "col": (b + c0).astype(np.int32), **{k: got[k][a, b] if got else [] for k in schema}})

    return d.groupBy("tr", "tc").applyInPandas(one, out)


def _nearest(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat index of the nearest valid cell of each cell (-1: none) and its distance; of equals that of
    the smallest column, then row."""
    h, w = valid.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(valid, rows, -(10**7)), axis=0)
    down = np.minimum.accumulate(np.where(valid, rows, 10**7)[::-1], axis=0)[::-1]
    near = np.where(rows - up <= down - rows, up, down)  # nearest in the column, above wins
    far2 = np.where((near >= 0) & (near < h), (rows - near).astype(float) ** 2, np.inf)
    best, who = np.full((h, w), np.inf), np.full((h, w), -1)
    cols = np.arange(w)
    for c in range(w):  # each source column in ascending order, so that the first of equals stays
        if not np.isfinite(far2[0, c]):
            continue
        d2 = far2[:, c : c + 1] + (cols[None, :] - c) ** 2
        better = d2 < best
        best = np.where(better, d2, best)
        who = np.where(better, near[:, c : c + 1] * w + c, who)
    return who, np.sqrt(best)


def _nearest_in_band(rows: np.ndarray, cols: np.ndarray, first: int, height: int, trow: np.ndarray, tcol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest source (rows, cols) of each target (trow, tcol) and the squared distance; of equals that of the
    smallest column, then row. Targets lie in the rows first .. first + height - 1; sources are all that lie there, and of
    each column the nearest above and below.

    The nearest source column never falls along a row of targets, so halving the row bounds the columns to look at."""
    o = np.argsort(rows, kind="stable")
    rows, cols = rows[o], cols[o]
    at, k = np.unique(cols, return_inverse=True)
    n, i = len(rows), np.clip(rows - first, 0, height - 1)
    up, down = np.full((height, len(at)), -1), np.full((height, len(at)), n)
    before, after = np.flatnonzero(rows < first + height), np.flatnonzero(rows >= first)
    np.maximum.at(up, (i[before], k[before]), before)
    np.minimum.at(down, (i[after], k[after]), after)
    up, down = np.maximum.accumulate(up, axis=0), np.minimum.accumulate(down[::-1], axis=0)[::-1]
    r, far = (first + np.arange(height))[:, None], 10**9
    above, below = np.where(up >= 0, r - rows[np.maximum(up, 0)], far), np.where(down < n, rows[np.minimum(down, n - 1)] - r, far)
    who, gap = np.where(above <= below, up, down), np.minimum(above, below) ** 2
    order = np.lexsort((tcol, trow))
    i, j = trow[order] - first, tcol[order]
    count = np.bincount(i, minlength=height)
    place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + 1  # in its row, from 1
    last = count[i]
    best, d2 = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    step = 1 << int(count.max()).bit_length()
    while step:
        s = np.flatnonzero(place & (2 * step - 1) == step)
        if len(s):
            lo = np.where(place[s] > step, best[s - step], 0)
            hi = np.where(place[s] + step <= last[s], best[np.minimum(s + step, len(i) - 1)], len(at) - 1)
            length = hi - lo + 1
            start = np.cumsum(length) - length
            c = np.arange(length.sum()) + np.repeat(lo - start, length)
            cost = gap[np.repeat(i[s], length), c] + (at[c] - np.repeat(j[s], length)) ** 2
            least = np.minimum.reduceat(cost * len(at) + c, start)
            best[s], d2[s] = least % len(at), least // len(at)
        step //= 2
    got, dist = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    got[order], dist[order] = o[who[i, best]], d2
    return got, dist


def _beside(have: DataFrame, cells: DataFrame, bands: int) -> DataFrame:
    """b, row, col, v: for each band of rows, of every column with a source (b, row, col, v) the nearest above and below the band."""
    at = F.struct("row", "v")
    ends = have.groupBy("b", "col").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    every = have.select("col").distinct().crossJoin(cells.sparkSession.range(bands).withColumnRenamed("id", "b")).join(ends, ["b", "col"], "left")
    before = lambda by: Window.partitionBy("col").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    both = every.withColumns({"above": F.max("hi").over(before(F.asc("b"))), "below": F.min("lo").over(before(F.desc("b")))})
    return both.select("b", F.explode(F.array("above", "below")).alias("at"), "col").where("at is not null").select("b", "at.row", "col", "at.v")


def nearest_fill(raster: DataFrame, ref: GridRef, value: str = "value", tile: int = 64, whole: bool = False) -> DataFrame:
    """row, col, value, dist: null cells take the value of the nearest cell that has one (dist in cells; 0
    for cells with their own). Of equals the smallest (col, row) wins. whole: every cell of the grid, not only those of
    the raster. A raster without any value stays null.

    Works on bands of `tile` rows, each with its own cells and of every column the nearest above and below, so the
    reach is that of the grid whatever its empty stretches."""
    band = max(1, min(tile, 2_000_000 // max(ref.ncols, 1)))
    block = F.floor((F.col("row") - 1) / band).cast("long").alias("b")
    source = materialise(raster.select("row", "col", F.col(value).cast("double").alias("v")), "fill")
    have = source.where("v is not null and not isnan(v)").select(block, "row", "col", "v")
    if not have.head(1):
        empty = densify(source, ref, "v") if whole else source
        return empty.select("row", "col", F.col("v").alias(value), F.lit(None).cast("double").alias("dist"))
    cells = have if whole else source.select(block, "row", "col", "v")

    def one(key, pdf):
        import pandas as pd

        first = int(key[0]) * band + 1
        height = min(band, ref.nrows - first + 1)
        i, j, v = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), pdf["v"].to_numpy(float)
        ok = ~np.isnan(v)
        own = ok & (i >= first) & (i < first + height)
        if whole:
            full = np.zeros((height, ref.ncols), bool)
            full[i[own] - first, j[own] - 1] = True
            a, b = np.nonzero(~full)
            a, b = a + first, b + 1
        else:
            a, b = i[~ok], j[~ok]
        filled, dist = np.zeros(0), np.zeros(0)
        if len(a):
            who, d2 = _nearest_in_band(i[ok], j[ok], first, height, a, b)
            filled, dist = v[ok][who], np.sqrt(d2.astype(float))
        of = lambda x, y: np.append(x[own], y)
        return pd.DataFrame({"row": of(i, a).astype(np.int32), "col": of(j, b).astype(np.int32), "filled": of(v, filled), "dist": np.append(np.zeros(own.sum()), dist)})

    both = cells.unionByName(_beside(have, source, -(-ref.nrows // band)))
    got = both.groupBy("b").applyInPandas(one, "row int, col int, filled double, dist double")
    return got.select("row", "col", F.col("filled").alias(value), "dist")


def _farthest(rows: np.ndarray, cols: np.ndarray, first: int, height: int, ncols: int) -> float:
    """The greatest distance of a cell of the rows first .. first + height - 1 to the nearest of the cells given, of
    which there are all in these rows, and of each column the nearest above and below them."""
    at = np.arange(first, first + height)
    gap = np.full((height, ncols), np.inf)  # within the column
    order = np.lexsort((rows, cols))
    rows, cols = rows[order], cols[order]
    starts = np.flatnonzero(np.append(True, cols[1:] != cols[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(cols))):
        v = rows[a:b]
        k = np.searchsorted(v, at)
        gap[:, cols[a] - 1] = np.minimum(np.abs(at - v[np.maximum(k - 1, 0)]), np.abs(at - v[np.minimum(k, len(v) - 1)]))
    gap *= gap
    best = gap.copy()
    r, c = np.indices(best.shape)
    r, c, d = r.ravel(), c.ravel(), best.ravel()
    most, k = 0.0, 1
    while True:  # ever wider to both sides; a cell is done once its distance is no greater than the step
        done = d <= k * k
        most = max(most, d[done].max(initial=0.0))
        r, c, d = r[~done], c[~done], d[~done]
        if not len(d) or k >= ncols:
            return math.sqrt(max(most, d.max(initial=0.0)))
        for side in (np.maximum(c - k, 0), np.minimum(c + k, ncols - 1)):
            d = np.minimum(d, gap[r, side] + (side - c) ** 2)
        k += 1


def reach(cells: DataFrame, ref: GridRef, value: str = "value") -> float:
    """The greatest distance, in cells, of any cell of the whole grid to the nearest one with a value.

    Works on bands of rows, each with its own cells and of every column the nearest above and below; no cell without a
    value is made. 0 for a raster without any value."""
    band = max(1, min(64, 2_000_000 // max(ref.ncols, 1)))
    bands = -(-ref.nrows // band)
    have = cells.where(F.col(value).isNotNull() & ref.inside()).select("row", "col", F.floor((F.col("row") - 1) / band).cast("long").alias("b"), F.lit(0.0).alias("v"))
    beside = _beside(have, cells, bands).drop("v")

    def one(key, pdf):
        import pandas as pd

        first = int(key[0]) * band + 1
        d = _farthest(pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), first, min(band, ref.nrows - first + 1), ref.ncols)
        return pd.DataFrame({"d": [d]})

    got = beside.unionByName(have.drop("v")).groupBy("b").applyInPandas(one, "d double")
    return got.agg(F.max("d")).first()[0] or 0.0


# ---- neighbourhoods ----------------------------------------------------------------------------


def gaussian(size: int, sigma: float) -> list[list[float]]:
    """Normalised Gaussian kernel of odd size."""
    r = size // 2
    k = [[math.exp(-(i * i + j * j) / (2 * sigma * sigma)) for j in range(-r, r + 1)] for i in range(-r, r + 1)]
    s = sum(map(sum, k))
    return [[v / s for v in row] for row in k]


def focal(raster: DataFrame, ref: GridRef, kernel: list[list[float]], value: str = "value") -> DataFrame:
    """Correlation with a kernel of odd size, edges replicated. The raster must be dense and without nulls
    (fill first). Works on tiles, so each cell is moved about once whatever the kernel."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    if len(kernel) % 2 == 0 or len(kernel[0]) % 2 == 0:
        raise ValueError("the kernel's sides must be odd")
    spread = lambda c, n, r: F.explode(F.when((F.col(c) == 1) & F.lit(n == 1), F.sequence(F.lit(1 - r), F.lit(n + r))).when(F.col(c) == 1, F.sequence(F.lit(1 - r), F.lit(1))).when(F.col(c) == n, F.sequence(F.lit(n), F.lit(n + r))).otherwise(F.array(F.col(c))))
    padded = raster.select("row", "col", F.col(value).alias("v")).withColumn("row", spread("row", ref.nrows, h)).withColumn("col", spread("col", ref.ncols, w))
    k = np.array(kernel)

    def work(a, present, r0, c0):
        v, out = a["v"], np.zeros(a["v"].shape)
        for i in range(2 * h + 1):
            for j in range(2 * w + 1):
                out += k[i, j] * np.roll(v, (h - i, w - j), (0, 1))
        return {"f": out}

    return tiled(padded, ["v"], 128, max(h, w), work, {"f": T.DoubleType()}).where(ref.inside()).select("row", "col", F.when(~F.isnan("f"), F.col("f")).alias(value))


def cubic(d: float) -> float:
    """The default weight of inverse-distance interpolation."""
    return d**-3.0


def idw(cells: DataFrame, ref: GridRef, radius: int, weight: Callable[[float], float] = cubic, value: str = "value") -> DataFrame:
    """Inverse-distance weighted means of the cells within `radius` cells, at every cell of the grid that
    has one. A cell's own distance counts as 0.001. Up to radius 3 cells scatter, beyond they work on tiles, where
    sums are taken by Fourier transform (about 1e-6 of the spread of the values in error)."""
    steps = [(i, j, weight(d if d else 0.001)) for i, j, d in offsets(radius)]
    if radius <= 3:
        s = _scatter(cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v")), steps).where(ref.inside())
        return s.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))
    dense = densify(cells.select("row", "col", F.col(value).alias("v")), ref, "v")

    size = 128 + 2 * radius
    centre = next(w for i, j, w in steps if i == j == 0)
    wide = np.zeros((size, size))
    for i, j, w in steps:
        if i or j:
            wide[i % size, j % size] = w
    wave = np.fft.rfft2(wide)

    def work(a, present, r0, c0):
        ok = ~np.isnan(a["v"])
        mean = a["v"][ok].mean() if ok.any() else 0.0
        v = np.where(ok, a["v"] - mean, 0.0)
        # the kernel's ring by Fourier transform; its steep centre, which would swamp the rest, by itself
        num = np.fft.irfft2(np.fft.rfft2(v) * wave, v.shape) + centre * v
        den = np.fft.irfft2(np.fft.rfft2(ok.astype(float)) * wave, v.shape) + centre * ok
        with np.errstate(all="ignore"):
            return {"f": np.where(den > smallest / 2, num / den + mean, np.nan)}

    smallest = min(w for _, _, w in steps if w > 0)
    got = tiled(dense, ["v"], 128, radius, work, {"f": T.DoubleType()})
    return got.where("f is not null and not isnan(f)").select("row", "col", F.col("f").alias(value))
