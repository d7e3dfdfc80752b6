"""Colours for clusters such that neighbours differ."""

from __future__ import annotations

import colorsys
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def adjacency(points: DataFrame, buffer: float = 2.0, dims: int = 3, label: str = "label") -> DataFrame:
    """(a, b), a < b: labels that share a voxel of side `buffer`. Labels 0 and null take no part.

    Points are reduced to distinct (voxel, label) map-side before the shuffle, and a voxel pairs labels, not points."""
    axes = ("x", "y", "z")[:dims]
    d = points.where(F.coalesce(F.col(label) != 0, F.lit(False)) & F.expr(" and ".join(f"{a} is not null" for a in axes)))
    v = d.select(*[F.round(F.col(a) / F.lit(float(buffer))).cast("long").alias(f"v{a}") for a in axes], F.col(label).cast("long").alias("label")).distinct()
    keys = [f"v{a}" for a in axes]
    pair = v.withColumnRenamed("label", "a").join(v.withColumnRenamed("label", "b"), keys).where("a < b")
    return pair.select("a", "b").distinct()


def degree_order(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """label, degree, rank: by falling degree, ties by label; labels without a neighbour have degree 0."""
    ends = edges.select(F.col("a").alias("l")).unionByName(edges.select(F.col("b").alias("l")))
    deg = ends.groupBy("l").agg(F.count("*").alias("degree"))
    d = labels.select(F.col(label).cast("long").alias("label")).where("label is not null and label <> 0").distinct().join(deg, F.col("label") == F.col("l"), "left")
    d = d.select("label", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    # ranks within a degree, plus the number of labels of higher degree: one row per degree is summed
    per = d.groupBy("degree").agg(F.count("*").alias("n"))
    above = per.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = d.withColumn("k", F.row_number().over(Window.partitionBy("degree").orderBy("label"))).join(above.select("degree", "above"), "degree")
    return r.select("label", "degree", (F.col("k") + F.col("above")).alias("rank"))


def greedy(edges: DataFrame, order: DataFrame) -> DataFrame:
    """label, color (from 1): in order of rank, the smallest colour that no earlier neighbour has.

    Jones-Plassmann style rounds give exactly the sequential result: in each round the labels whose earlier
    neighbours are all coloured get theirs. Rounds are bounded by the longest falling path; the graph stays
    distributed."""
    from laserloom.session import materialise

    o = order.select("label", "rank")
    ra, rb = o.select(F.col("label").alias("a"), F.col("rank").alias("ra")), o.select(F.col("label").alias("b"), F.col("rank").alias("rb"))
    e = edges.join(ra, "a").join(rb, "b")
    down = materialise(e.select(F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("label"), F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("before")), "edges")
    first = o.select("label").join(down.select("label").distinct(), "label", "left_anti").select("label", F.lit(1).alias("color"))
    colored = materialise(first, "colors")
    left = materialise(o.select("label").join(colored, "label", "left_anti"), "left")
    while left.head(1):
        j = down.join(left, "label", "left_semi").join(colored.withColumnRenamed("label", "before"), "before", "left")
        g = j.groupBy("label").agg(F.count("*").alias("n"), F.count("color").alias("done"), F.collect_set("color").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), F.col("used")))
        now = materialise(g.where("n = done").select("label", free.cast("int").alias("color")), "colors")
        colored = materialise(colored.unionByName(now), "colors")
        left = materialise(left.join(now, "label", "left_anti"), "left")
    return colored


def greedy_local(edges: DataFrame, order: DataFrame) -> DataFrame:
    """The same in one task, for graphs that fit it (the caller has checked their size)."""
    o = order.select(F.col("label"), F.col("rank"), F.lit(None).cast("long").alias("b"))
    e = edges.select(F.col("a").alias("label"), F.lit(None).cast("long").alias("rank"), "b")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        f = pd.concat(list(frames))
        near: dict[int, list[int]] = {}
        pairs = f[f["b"].notna()]
        for a, b in zip(pairs["label"].astype("int64").tolist(), pairs["b"].astype("int64").tolist()):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        color: dict[int, int] = {}
        for label in f[f["rank"].notna()].sort_values("rank")["label"].astype("int64").tolist():
            used = {color[x] for x in near.get(label, ()) if x in color}
            c = 1
            while c in used:
                c += 1
            color[label] = c
        yield pd.DataFrame({"label": list(color), "color": list(color.values())})

    return o.unionByName(e).coalesce(1).mapInPandas(run, T.StructType([T.StructField("label", T.LongType()), T.StructField("color", T.IntegerType())]))


def palette(size: int) -> list[tuple[float, float, float]]:
    """Distinct colours of our own choice: hues a golden angle apart, in three shades."""
    return [tuple(round(v, 6) for v in colorsys.hsv_to_rgb((k * 0.381966) % 1.0, (0.9, 0.55, 0.75)[k % 3], (0.95, 0.85, 0.6)[k % 3])) for k in range(size)]


def wrap(color, size: int):
    """Colours beyond the palette start over: 12 colours wrap above 12, 25 colours from 25 on."""
    if size == 12:
        return F.when(color > 12, color % 12 + 1).otherwise(color)
    if size == 25:
        return F.when(color >= 25, color % 25 + 1).otherwise(color)
    return color


def topo_color(points: DataFrame, *, buffer: float = 2.0, dims: int = 3, colormap: str = "cmap12", unlabelled: tuple[float, float, float] = (0.0, 0.0, 0.0), label: str = "label", local: int = 200_000) -> DataFrame:
    """points with color (0 = unlabelled) and r, g, b. Graphs of at most `local` edges are coloured in one task, larger ones by rounds."""
    if colormap not in ("hsv", "cmap12", "cmap25"):
        raise ValueError(f"colormap must be hsv, cmap12 or cmap25, not {colormap!r}")
    from laserloom.session import materialise

    edges = materialise(adjacency(points, buffer, dims, label), "edges")
    order = degree_order(edges, points, label)
    colors = (greedy_local if edges.count() <= local else greedy)(edges, order)
    size = {"cmap12": 12, "cmap25": 25}.get(colormap)
    c = colors.select(F.col("label").alias("__l"), (wrap(F.col("color"), size) if size else F.col("color")).alias("color"))
    out = points.join(c, F.col(label) == F.col("__l"), "left").drop("__l").withColumn("color", F.coalesce("color", F.lit(0)))
    n = size or max(1, int(colors.agg(F.max("color")).first()[0] or 1))
    shades = [unlabelled, *palette(n)]
    a = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgb", s)]) for s in shades])
    return out.withColumn("__c", F.element_at(a, F.col("color") + 1)).withColumns({k: F.col(f"__c.{k}") for k in "rgb"}).drop("__c")
