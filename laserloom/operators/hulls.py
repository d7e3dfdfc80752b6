"""Outlines of files of points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _corners(pdf):
    from laserloom.geometry.hull import ring_2d

    xy = pdf[["x", "y"]].to_numpy(float)
    r = ring_2d(xy)
    if r is None:  # all on a line: its ends
        o = np.lexsort((xy[:, 1], xy[:, 0]))
        r = o[[0, -1]] if len(o) else o
    return pdf.iloc[r]


def convex_extents(points: DataFrame, by: str = "file", slices: int = 64) -> DataFrame:
    """by, ring_x, ring_y (closed, counterclockwise), area: the convex hull of each file.

    A hull of hulls: each slice of a file is reduced to its corners first, so no task holds a whole file."""
    d = points.select(F.col(by), "x", "y").where("x is not null and y is not null")
    k = F.pmod(F.xxhash64("x", "y"), F.lit(slices))
    part = d.withColumn("__k", k).groupBy(by, "__k").applyInPandas(lambda pdf: _corners(pdf.drop(columns="__k")), d.schema)
    out = T.StructType([d.schema[by], T.StructField("ring_x", T.ArrayType(T.DoubleType())), T.StructField("ring_y", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType())])

    def one(key, pdf):
        import pandas as pd

        from laserloom.geometry.hull import ring_2d, ring_area

        xy = pdf[["x", "y"]].to_numpy(float)
        r = ring_2d(xy)
        if r is None:
            return pd.DataFrame({by: [key[0]], "ring_x": [None], "ring_y": [None], "area": [0.0]})
        c = xy[np.append(r, r[0])]
        return pd.DataFrame({by: [key[0]], "ring_x": [c[:, 0].tolist()], "ring_y": [c[:, 1].tolist()], "area": [ring_area(xy[r])]})

    return part.groupBy(by).applyInPandas(one, out)


def concave_extents(points: DataFrame, by: str = "file", resolution: float = 3.0, cells: int = 4000) -> DataFrame:
    """by, ring_x, ring_y, area: the alpha shape of each file with all cells in one region and holes filled.

    A file is first reduced to the extreme points of its cells of `resolution` (made coarser where a file would
    have more than `cells` of them), so a task holds a bounded number of points; the outline is exact to a cell."""
    d = points.select(F.col(by), "x", "y").where("x is not null and y is not null")
    b = d.groupBy(by).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("a"))
    size = b.select(by, F.greatest(F.lit(float(resolution)), F.sqrt(F.col("a") / F.lit(float(cells)))).alias("s"))
    g = d.join(size, by).withColumns({"i": F.floor(F.col("x") / F.col("s")), "j": F.floor(F.col("y") / F.col("s"))})
    p = F.struct("x", "y")
    ends = F.array(F.min_by(p, F.struct("x", "y")), F.max_by(p, F.struct("x", "y")), F.min_by(p, F.struct("y", "x")), F.max_by(p, F.struct("y", "x")))
    few = g.groupBy(by, "i", "j").agg(ends.alias("e")).select(by, F.explode(F.array_distinct("e")).alias("p")).select(by, "p.x", "p.y")
    out = T.StructType([d.schema[by], T.StructField("ring_x", T.ArrayType(T.DoubleType())), T.StructField("ring_y", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType())])

    def one(key, pdf):
        import pandas as pd

        from laserloom.geometry.hull import alpha_shape, walk

        xy = pdf[["x", "y"]].to_numpy(float)
        a = alpha_shape(xy)
        if a is None:
            return pd.DataFrame({by: [key[0]], "ring_x": [None], "ring_y": [None], "area": [0.0]})
        r = walk(a.boundary)
        c = xy[[*r, r[0]]]
        return pd.DataFrame({by: [key[0]], "ring_x": [c[:, 0].tolist()], "ring_y": [c[:, 1].tolist()], "area": [a.measure]})

    few = few.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    return few.groupBy(by).applyInPandas(one, out)
