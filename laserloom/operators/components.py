"""Connected components of edges and of raster regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laserloom.operators.grid import GridRef, _scatter, erode
from laserloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for edges (a, b). Alternating large-star and small-star rounds,
    logarithmic in the longest path; nothing but counts comes to the driver."""
    e = materialise(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u is not null and v is not null"), "star")
    before = None
    while True:
        both = e.where("u <> v").select("u", "v").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m, "u")
        e2 = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        e2 = materialise(e2.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, e = now, e2
    nodes = edges.select(F.col("a").cast("long").alias("node")).unionByName(edges.select(F.col("b").cast("long").alias("node"))).where("node is not null").distinct()
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def regions(mask: DataFrame, ref: GridRef, eight: bool = True) -> DataFrame:
    """row, col, region: connected cells of a mask share the number of their first cell."""
    key = ((F.col("row") - 1).cast("long") * ref.ncols + F.col("col")).alias("k")
    cells = materialise(mask.select("row", "col").distinct().select("row", "col", key), "mask")
    steps = [(0, 1, 1.0), (1, 0, 1.0)] + ([(1, 1, 1.0), (1, -1, 1.0)] if eight else [])
    other = cells.select("row", "col", F.col("k").alias("b"))
    e = _scatter(cells.select("row", "col", F.col("k").alias("a")), [(0, 0, 0.0), *steps]).join(other, ["row", "col"]).select("a", "b")
    c = components(e)
    return cells.join(c, F.col("k") == F.col("node")).select("row", "col", F.col("component").alias("region"))


def reconstruct(marker: DataFrame, mask: DataFrame, ref: GridRef) -> DataFrame:
    """Cells of the mask's connected regions that hold a marker cell."""
    r = regions(mask, ref)
    keep = r.join(marker.select("row", "col").distinct(), ["row", "col"], "left_semi").select("region").distinct()
    return r.join(keep, "region", "left_semi").select("row", "col")


def open_by_reconstruction(mask: DataFrame, ref: GridRef, radius: float = 3.0) -> DataFrame:
    """The mask without patches that no disk of the radius fits into."""
    return reconstruct(erode(mask, ref, radius), mask, ref)


__all__ = ["components", "open_by_reconstruction", "reconstruct", "regions"]
