"""Segments from height rasters: peaks, watersheds, superpixels. Definitions of our own."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laserloom.functions.stats import exact_hazen
from laserloom.operators.grid import GridRef, _scatter, offsets
from laserloom.session import materialise


def crown_radius(h: Column) -> Column:
    """A usual radius of a crown in metres for a height."""
    return F.lit(0.28) * F.pow(F.greatest(h, F.lit(0.0)), F.lit(0.59))


def peaks(heights: DataFrame, ref: GridRef, *, value: str = "value", least: float = 2.0, radius: Callable[[Column], Column] = crown_radius, longest: float = 5.0) -> DataFrame:
    """row, col, height of the cells that no cell within their own radius exceeds; of equal neighbours the one
    first in (row, col) stays. radius: metres as a column of the height, held to `longest`."""
    cell = abs(ref.dx)
    d = heights.select("row", "col", F.col(value).alias("h")).where(F.col("h") >= least)
    src = _scatter(d.withColumns({"sr": F.col("row"), "sc": F.col("col")}), [s for s in offsets(max(longest / cell, 1.5)) if s[2] > 0])
    near = src.select("row", "col", F.col("h").alias("oh"), "sr", "sc", F.col("w").alias("dist"))
    reach = F.greatest(F.least(radius(F.col("h")), F.lit(float(longest))) / F.lit(cell), F.lit(1.5))  # the next cells at least
    j = d.join(near, ["row", "col"])
    higher = (F.col("dist") <= reach) & ((F.col("oh") > F.col("h")) | ((F.col("oh") == F.col("h")) & (F.struct("sr", "sc") < F.struct("row", "col"))))
    beaten = j.where(higher).select("row", "col").distinct()
    return d.join(beaten, ["row", "col"], "left_anti").select("row", "col", F.col("h").alias("height"))


def watershed(heights: DataFrame, ref: GridRef, *, value: str = "value", least: float = 2.0, radius: float = 2.0) -> DataFrame:
    """row, col, segment: each cell follows the highest cell within `radius` cells until none is higher; cells that
    end at one peak form a segment, numbered by the peak's cell. Paths are shortened by pointer doubling, so the
    rounds are logarithmic in the longest path."""
    key = (F.col("row") - 1).cast("long") * ref.ncols + F.col("col")
    d = heights.select("row", "col", F.col(value).alias("h")).where(F.col("h") >= least).withColumn("k", key)
    src = _scatter(d, offsets(radius)).where(ref.inside())
    best = src.groupBy("row", "col").agg(F.max_by("k", F.struct("h", -F.col("k"))).alias("up"))
    p = materialise(d.join(best, ["row", "col"]).select("row", "col", "k", "up"), "up")
    while True:
        q = p.join(p.select(F.col("k").alias("up"), F.col("up").alias("next")), "up").select("row", "col", "k", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
        q = materialise(q, "up")
        moved = q.where("moved").head(1)
        p = q.drop("moved")
        if not moved:
            return p.select("row", "col", F.col("up").alias("segment"))


def without_border(segments: DataFrame, ref: GridRef, segment: str = "segment") -> DataFrame:
    """Segments that do not touch the grid's edge."""
    edge = segments.where((F.col("row").isin(1, ref.nrows)) | (F.col("col").isin(1, ref.ncols))).select(segment).distinct()
    return segments.join(edge, segment, "left_anti")


def superpixels(image: DataFrame, ref: GridRef, *, value: str = "value", radius: float = 3.0, weight: float = 0.5, rounds: int = 5) -> DataFrame:
    """row, col, superpixel (from 1): k-means on place and brightness from seeds on a regular net.

    Brightness is scaled by its 2 and 98 % quantiles; the number of seeds is that of circles of the radius (map
    units) that fill the grid. A cell looks at the seeds of its own and the eight next net cells only."""
    lo, hi = exact_hazen(image, value, [0.02, 0.98])
    if lo is None:
        return image.select("row", "col", F.lit(None).cast("long").alias("superpixel"))
    span = (hi - lo) or 1.0
    step = max(1.0, math.sqrt(math.pi) * radius / abs(ref.dx))
    wide = math.ceil(ref.ncols / step)
    d = image.where(F.col(value).isNotNull()).select("row", "col", (F.least(F.greatest((F.col(value) - F.lit(lo)) / F.lit(span), F.lit(0.0)), F.lit(1.0))).alias("v"))
    net = lambda c: F.floor((F.col(c) - 1) / F.lit(step)).cast("long")
    d = materialise(d.withColumns({"nr": net("row"), "nc": net("col")}), "pixels")
    seeds = d.groupBy("nr", "nc").agg(F.avg("row").alias("sr"), F.avg("col").alias("sc"), F.avg("v").alias("sv"))
    own = None
    for _ in range(rounds):
        seeds = materialise(seeds, "seeds")
        near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        s = seeds.select(F.col("nr").alias("hr"), F.col("nc").alias("hc"), "sr", "sc", "sv").withColumn("o", F.explode(near))
        s = s.withColumns({"nr": F.col("hr") + F.col("o.i"), "nc": F.col("hc") + F.col("o.j")}).drop("o")
        dist = F.pow((F.col("v") - F.col("sv")) / F.lit(weight), 2) + (F.pow(F.col("row") - F.col("sr"), 2) + F.pow(F.col("col") - F.col("sc"), 2)) / F.lit(step * step)
        j = d.join(s, ["nr", "nc"])
        own = j.groupBy("row", "col").agg(F.min_by(F.struct("hr", "hc", "v"), F.struct(dist, "hr", "hc")).alias("s")).select("row", "col", "s.*")
        seeds = own.groupBy(F.col("hr").alias("nr"), F.col("hc").alias("nc")).agg(F.avg("row").alias("sr"), F.avg("col").alias("sc"), F.avg("v").alias("sv"))
    return own.select("row", "col", (F.col("hr") * wide + F.col("hc") + 1).alias("superpixel"))


def label_points(points: DataFrame, segments: DataFrame, ref: GridRef, *, vegetation=(4, 5), segment: str = "segment", out: str = "label") -> DataFrame:
    """points with the compact number (from 1) of their cell's segment; 0 off all segments or off the vegetation."""
    from pyspark.sql import Window

    ids = segments.select(segment).where(F.col(segment).isNotNull()).distinct().withColumn("b", F.floor(F.col(segment) / 100_000))
    per = ids.groupBy("b").agg(F.count("*").alias("n"))
    per = per.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(segment))
    ids = ids.withColumn("k", rank).join(per, "b").select(segment, (F.col("k") + F.col("before")).cast("long").alias("__label"))
    s = segments.join(ids, segment).select("row", "col", "__label")
    d = points.drop(out) if out in points.columns else points
    cell = d.withColumns({"row": ref.row(F.col("y")), "col": ref.col(F.col("x"))}).join(s, ["row", "col"], "left")
    return cell.withColumn(out, F.when(F.col("classification").isin(*vegetation), F.coalesce("__label", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).drop("row", "col", "__label")
