"""Operators on voxels: thinning, medoids, echo ratios, point density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def voxel(v: Column, size: float) -> Column:
    """Number of the voxel along an axis: round(v / size)."""
    return F.round(v / F.lit(float(size))).cast("long")


def with_voxel(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Add v_<axis>; points with a null coordinate are left out."""
    d = points.where(" and ".join(f"{a} is not null" for a in axes))
    return d.withColumns({f"v_{a}": voxel(F.col(a), size) for a in axes})


def subsample_grid(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Centres of the voxels that hold points."""
    d = with_voxel(points, size, axes).select(*[f"v_{a}" for a in axes]).distinct()
    return d.select(*[(F.col(f"v_{a}") * F.lit(float(size))).alias(a) for a in axes])


def subsample_mean(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Voxel numbers and the mean position of each voxel."""
    keys = [f"v_{a}" for a in axes]
    return with_voxel(points, size, axes).groupBy(*keys).agg(*[F.avg(a).alias(a) for a in axes])


def subsample_random(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z"), seed: int = 1, row_id: str = "pid") -> DataFrame:
    """One point of each voxel, by a seeded hash of the row id (so that reruns agree)."""
    keys = [f"v_{a}" for a in axes]
    pick = F.min_by(F.struct(*[F.col(c) for c in points.columns]), F.struct(F.xxhash64(F.col(row_id), F.lit(seed)), F.col(row_id))).alias("p")
    return with_voxel(points, size, axes).groupBy(*keys).agg(pick).select("p.*")


def voxel_index(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """points with `voxel`: the rank of their voxel among all in (x, y, z) order, from 1.

    Ranks come from counts per slab of the first axis, so no task sorts all voxels."""
    keys = [f"v_{a}" for a in axes]
    d = with_voxel(points, size, axes)
    cells = d.select(*keys).distinct()
    slab = cells.groupBy(keys[0]).agg(F.count("*").alias("n"))
    before = slab.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(keys[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per slab
    rank = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:])) if len(keys) > 1 else F.lit(1)
    numbered = cells.withColumn("r", rank).join(before, keys[0]).select(*keys, (F.col("r") + F.col("before")).alias("voxel"))
    return d.join(numbered, keys).drop(*keys)


def medoid(df: DataFrame, keys: Sequence[str], axes: Sequence[str], row_id: str) -> DataFrame:
    """keys, row_id, axes, ssd, n: the row of each group with the least sum of squared distances to the
    others (first row id of equals; deviations from the centroid count to 1e-7, so that map coordinates tie as they should).

    That sum is n |x - c|^2 + sum |x_j - c|^2 about the centroid c, so the row nearest to the centroid is
    taken: two linear passes instead of all pairs. A single row has a null ssd."""
    d = df.where(" and ".join(f"{a} is not null" for a in axes)).select(*keys, row_id, *axes)
    c = d.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.avg(a).alias(f"__c_{a}") for a in axes], *[F.var_pop(a).alias(f"__v_{a}") for a in axes])
    if keys:
        j = d.join(c, list(keys))
    else:  # one group: its few statistics become literals
        one = c.first()
        j = d.withColumns({k: F.lit(one[k]) for k in c.columns})
    dist = sum((F.pow(F.round(F.col(a) - F.col(f"__c_{a}"), 7), 2) for a in axes), F.lit(0.0))
    ssd = F.col("__n") * F.col("__d") + F.col("__n") * sum((F.col(f"__v_{a}") for a in axes), F.lit(0.0))
    j = j.withColumn("__d", dist)
    j = j.withColumn("ssd", F.when(F.col("__n") > 1, ssd))
    row = F.struct(row_id, *axes, "ssd", F.col("__n").alias("n"))
    return j.groupBy(*keys).agg(F.min_by(row, F.struct(F.round("__d", 10), F.col(row_id))).alias("m")).select(*keys, "m.*")


def medoid_of_vectors(df: DataFrame, key: str, vector: str, row_id: str) -> DataFrame:
    """key, row_id, ssd: the same in any dimension, for an array column of equal lengths."""
    d = df.where(F.col(vector).isNotNull()).select(key, row_id, F.col(vector).cast("array<double>").alias("v"))
    e = d.select(key, F.posexplode("v").alias("i", "x"))
    stat = e.groupBy(key, "i").agg(F.count("*").alias("n"), F.avg("x").alias("c"), F.var_pop("x").alias("s"))
    whole = stat.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"), F.sum("s").alias("s"))
    j = d.join(whole, key)
    dist = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, q: acc + q)
    j = j.withColumn("d", dist).withColumn("ssd", F.when(F.col("n") > 1, F.col("n") * (F.col("d") + F.col("s"))))
    return j.groupBy(key).agg(F.min_by(F.struct(row_id, "ssd"), F.struct(F.round("d", 9), F.col(row_id))).alias("m")).select(key, "m.*")


def subsample_medoid(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z"), row_id: str = "pid") -> DataFrame:
    """The medoid of each voxel."""
    return medoid(with_voxel(points, size, axes), [f"v_{a}" for a in axes], axes, row_id)


def bins(points: DataFrame, size: float) -> tuple[DataFrame, tuple[float, float, float]]:
    """points with bx, by, bz = floor((v - least) / size), and the least values. One extra pass."""
    d = points.where("x is not null and y is not null and z is not null")
    low = tuple(d.agg(F.min("x"), F.min("y"), F.min("z")).first())
    k = lambda c, m: F.floor((F.col(c) - F.lit(m)) / F.lit(float(size))).cast("long")
    if low[0] is None:
        return d.withColumns({b: F.lit(0).cast("long") for b in ("bx", "by", "bz")}), (0.0, 0.0, 0.0)
    return d.withColumns({"bx": k("x", low[0]), "by": k("y", low[1]), "bz": k("z", low[2])}), low


def echo_ratio(points: DataFrame, size: float = 0.5, method: str = "standard") -> DataFrame:
    """points with echo_ratio: returns in the point's voxel over those in its column (standard) or in the
    part of its column up to it (cumulative). Counts are aggregated before they are joined back, so a
    column with a third of all points moves as one row per voxel."""
    if method not in ("standard", "cumulative"):
        raise ValueError(f"method must be standard or cumulative, not {method!r}")
    d, _ = bins(points, size)
    cell = d.groupBy("bx", "by", "bz").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bx", "by")
    total = F.sum("n").over(w if method == "standard" else w.orderBy("bz").rowsBetween(Window.unboundedPreceding, 0))
    ratio = cell.select("bx", "by", "bz", (F.col("n") / total).alias("echo_ratio"))
    return d.join(ratio, ["bx", "by", "bz"])


def point_density(points: DataFrame) -> DataFrame:
    """One row: the median number of points per voxel of side 1."""
    n = with_voxel(points, 1.0).groupBy("v_x", "v_y", "v_z").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.median("n").alias("pdensity"))
