"""Neighbours and regions through space-filling-curve codes.

Positions become Morton (Z-order) codes of a fine grid. A disc or a region is covered by code ranges,
one for each block (aligned square of 4^level cells) that it touches: within a block the codes of
all positions of a box lie between those of its lower left and upper right corners. Ranges and
positions meet in a sort-merge join on the block with the code between the bounds; what remains is
refined by the exact distance or the exact polygon test. All of it stays in JVM expressions, so AQE
splits a hot block like any skewed join partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells are counted from -2^30 on each axis.
ORIGIN = 1 << 30
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def cell(v: Column, size: float) -> Column:
    """Grid index of a coordinate (LONG); null for null, NaN and infinite values and those off the grid."""
    k = F.floor(v / F.lit(float(size)))
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float(size) * (ORIGIN - 2))), k + F.lit(ORIGIN))


def add_morton(df: DataFrame, codes: dict[str, tuple[str, str]]) -> DataFrame:
    """df with Z-order codes: name -> columns of two grid indices below 2^31 (never null); bits of x
    stand at even, of y at odd places.

    Each step of spreading the bits uses its input twice, so each is a projection of its own: as one
    expression it would grow to 2^5 copies of its input, evaluated for each row."""
    half = {f"{out}__{i}": c for out, xy in codes.items() for i, c in enumerate(xy)}
    df = df.withColumns({k: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for k, c in half.items()})
    for shift, mask in _SPREAD:
        df = df.withColumns({k: F.col(k).bitwiseOR(F.shiftleft(F.col(k), shift)).bitwiseAND(F.lit(mask)) for k in half})
    return df.withColumns({out: F.col(f"{out}__0").bitwiseOR(F.shiftleft(F.col(f"{out}__1"), 1)) for out in codes}).drop(*half)


def with_code(df: DataFrame, x: str, y: str, size: float, out: str = "__code") -> DataFrame:
    """df with the code of (x, y); rows without usable coordinates are left out."""
    df = df.withColumns({"__ix": cell(F.col(x).cast("double"), size), "__iy": cell(F.col(y).cast("double"), size)})
    return add_morton(df.where("__ix is not null and __iy is not null"), {out: ("__ix", "__iy")}).drop("__ix", "__iy")


def cover(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float, level: Column) -> DataFrame:
    """One row for each block of the given level that the box touches: adds __level, __block and the
    code range __lo to __hi of the box inside that block. Rows without a usable box are left out."""
    df = df.select("*", cell(xmin, size).alias("__x0"), cell(ymin, size).alias("__y0"), cell(xmax, size).alias("__x1"), cell(ymax, size).alias("__y1"), level.cast("int").alias("__level"))
    df = df.where("__x0 is not null and __y0 is not null and __x1 >= __x0 and __y1 >= __y0")
    shr = lambda c: F.expr(f"shiftright({c}, __level)")
    df = df.withColumn("__bx", F.explode(F.sequence(shr("__x0"), shr("__x1")))).withColumn("__by", F.explode(F.sequence(shr("__y0"), shr("__y1"))))
    first = lambda b: F.expr(f"shiftleft({b}, __level)")
    last = lambda b: F.expr(f"shiftleft({b} + 1, __level) - 1")
    df = df.withColumns({"__xl": F.greatest("__x0", first("__bx")), "__yl": F.greatest("__y0", first("__by")), "__xh": F.least("__x1", last("__bx")), "__yh": F.least("__y1", last("__by"))})
    df = add_morton(df, {"__block": ("__bx", "__by"), "__lo": ("__xl", "__yl"), "__hi": ("__xh", "__yh")})
    return df.drop("__x0", "__y0", "__x1", "__y1", "__bx", "__by", "__xl", "__yl", "__xh", "__yh")


def _level(extent: float, size: float) -> int:
    """The smallest level whose blocks are as wide as extent, so that a box touches four at most."""
    level = 0
    while size * (1 << level) < extent:
        level += 1
    return level


def within_distance(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], size: float | None = None) -> DataFrame:
    """(a, b) = ids of all pairs at most `radius` apart, each pair once.

    left rows are covered by discs, so give the smaller side as left. Null, NaN and infinite
    coordinates and null ids give no row; repeated rows give a pair once; ties do not matter, as the
    radius includes its edge. Empty tables give no rows. Other columns are not read.
    Partners per row are not limited.
    """
    size = size or max(radius / 4, 1e-9)
    level, pad = _level(2 * radius + 2 * size, size), radius * 1e-9 + 1e-6
    sel = lambda df, i, xy, p: df.select(F.col(i).alias(f"__{p}"), F.col(xy[0]).cast("double").alias(f"__{p}x"), F.col(xy[1]).cast("double").alias(f"__{p}y")).where(F.col(f"__{p}").isNotNull())
    a, b = sel(left, left_id, left_xy, "a"), sel(right, right_id, right_xy, "b")
    r = F.lit(radius + pad)
    discs = cover(a, F.col("__ax") - r, F.col("__ay") - r, F.col("__ax") + r, F.col("__ay") + r, size, F.lit(level)).drop("__level")
    codes = with_code(b, "__bx", "__by", size).withColumn("__block", F.shiftright("__code", 2 * level))
    dx, dy = F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")
    near = discs.join(codes, "__block").where(F.col("__code").between(F.col("__lo"), F.col("__hi")) & (dx * dx + dy * dy <= F.lit(radius * radius)))
    return near.select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct()


def polygon_edges(regions: DataFrame, region_id: str, x: str, y: str) -> DataFrame:
    """Edges (region, x1, y1, x2, y2) of polygons given as vertex arrays with NaN (or null) between
    rings. A ring left open is closed; a lone vertex is an edge of no length."""
    v = regions.select(F.col(region_id).alias("region"), F.posexplode(F.arrays_zip(F.col(x).alias("vx"), F.col(y).alias("vy"))).alias("pos", "v"))
    gap = F.col("v.vx").isNull() | F.col("v.vy").isNull() | F.isnan("v.vx") | F.isnan("v.vy")
    v = v.withColumn("gap", gap).withColumn("ring", F.sum(F.col("gap").cast("int")).over(Window.partitionBy("region").orderBy("pos")))
    v = v.where(~F.col("gap")).select("region", "ring", "pos", F.col("v.vx").alias("x1"), F.col("v.vy").alias("y1"))
    w = Window.partitionBy("region", "ring").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return v.select("region", "x1", "y1", nxt("x1").alias("x2"), nxt("y1").alias("y2"))


def in_regions(regions: DataFrame, points: DataFrame, *, region_id: str, point_id: str, region_xy: tuple[str, str] = ("x", "y"), point_xy: tuple[str, str] = ("x", "y"), size: float = 0.25, tolerance: float = 1e-6) -> DataFrame:
    """(region, point): every region that holds the point inside (even-odd over all rings) or on its edge.

    Region ids must be unique apart from exact duplicates. A region is covered at the level of its own
    extent, so that it touches four blocks at most however large it is; points carry a block for each
    level in use (31 at most). Null coordinates or ids, empty or null vertex arrays give no row.
    """
    sure = regions.select(F.col(region_id).alias("region"), F.col(region_xy[0]).alias("vx"), F.col(region_xy[1]).alias("vy")).where("region is not null").dropDuplicates(["region"])
    edges = polygon_edges(sure, "region", "vx", "vy")
    boxes = edges.groupBy("region").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x1").alias("xe"), F.max("y1").alias("ye"))
    pad = F.lit(max(tolerance, 1e-6) * 2)
    extent = F.greatest(F.col("xe") - F.col("x0"), F.col("ye") - F.col("y0")) + F.lit(2 * size)
    level = F.greatest(F.lit(0), F.ceil(F.log2(extent / F.lit(size)))).cast("int")
    boxes = cover(boxes, F.col("x0") - pad, F.col("y0") - pad, F.col("xe") + pad, F.col("ye") + pad, size, level)
    levels = sorted(r[0] for r in boxes.select("__level").distinct().collect())  # 31 at most
    pts = points.select(F.col(point_id).alias("point"), F.col(point_xy[0]).cast("double").alias("px"), F.col(point_xy[1]).cast("double").alias("py")).where("point is not null").distinct()
    pts = with_code(pts, "px", "py", size)
    pts = pts.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>"))).withColumn("__block", F.expr("shiftright(__code, 2 * __level)"))
    hit = boxes.join(pts, ["__level", "__block"]).where(F.col("__code").between(F.col("__lo"), F.col("__hi")))
    hit = hit.where(F.col("px").between(F.col("x0") - pad, F.col("xe") + pad) & F.col("py").between(F.col("y0") - pad, F.col("ye") + pad)).select("region", "point", "px", "py")
    # exact test: only the edges whose y range holds the point take part
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.select("region", "x1", "y1", "x2", "y2", low.alias("ylow"), high.alias("yhigh"))
    tol = F.lit(tolerance)
    pair = hit.join(e, "region").where(F.col("py").between(F.col("ylow") - tol, F.col("yhigh") + tol))
    dx, dy, qx, qy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("px") - F.col("x1"), F.col("py") - F.col("y1")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(qx * dx + qy * dy, length2)))).otherwise(F.lit(0.0))
    on = F.hypot(qx - t * dx, qy - t * dy) <= tol
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (qx < F.try_divide(dx * qy, dy))
    got = pair.groupBy("region", "point").agg(F.max(on).alias("on"), F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("n"))
    return got.where(F.col("on") | (F.col("n") % 2 == 1)).select("region", "point")


def tree_neighbourhoods(points: DataFrame, tree_metrics: DataFrame, stands: DataFrame, *, tree_radius: float = 1.505, point_radius: float = 0.505) -> DataFrame:
    """rel, a, b: neighbouring trees, returns close to a tree and the stands that hold it."""
    trees = tree_metrics.select("label", "xpos", "ypos").where("label is not null").distinct()
    xy = ("xpos", "ypos")
    tt = within_distance(trees, trees, tree_radius, left_id="label", right_id="label", left_xy=xy, right_xy=xy).where("a < b")
    tp = within_distance(trees, points, point_radius, left_id="label", right_id="pid", left_xy=xy, right_xy=("x", "y"))
    st = in_regions(stands, trees, region_id="stand_id", point_id="label", point_xy=xy)
    rel = lambda df, name, a, b: df.select(F.lit(name).alias("rel"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    return rel(tt, "tree_tree", "a", "b").unionByName(rel(tp, "tree_point", "a", "b")).unionByName(rel(st, "stand_tree", "region", "point"))
