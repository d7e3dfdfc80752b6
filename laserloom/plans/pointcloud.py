"""Queries of the point cloud operators over the whole tables, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laserloom.functions import gpstime, stats
from laserloom.operators import coloring, components, grid, hulls, models, predicates, pulses, segmentation, segments, tiles, voxel
from laserloom.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name. ROUND in the SQL stands for round with the nudge of r()."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("ROUND(", "round(1e-9 + ")
        return f

    return add


def pts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points")


#: Added before means are rounded, here and in the SQL, so that exact decimal ties do not hang on the order of sums.
NUDGE = 1e-9


def r(c: str | Column, digits: int, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(NUDGE), digits).alias(name) if name else F.round(c + F.lit(NUDGE), digits)


#: A region of interest in map coordinates, and a section line.
ROI = [(2600010.005, 1150005.005), (2600060.005, 1150012.005), (2600055.005, 1150050.005), (2600030.005, 1150035.005), (2600008.005, 1150048.005)]
P0, P1, WIDTH = (2600005.0, 1150004.0), (2600070.0, 1150044.0), 2.0
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(ROI, [*ROI[1:], ROI[0]]))


def ref_sql(cell: float) -> str:
    """CTEs g (x0, y0, nrows, ncols) and c (points with row and col, on the grid)."""
    return f"""g AS (SELECT min(x) - {cell} AS x0, max(y) + {cell} AS y0,
  CAST(floor((min(y) - (max(y) + {cell})) / -{cell} + 0.5) AS INT) AS nrows, CAST(floor((max(x) - (min(x) - {cell})) / {cell} + 0.5) AS INT) AS ncols FROM points),
k AS (SELECT p.*, CAST(round((y - y0) / -{cell}) AS INT) AS row, CAST(round((x - x0) / {cell}) AS INT) AS col, nrows, ncols FROM points p, g),
c AS (SELECT * FROM k WHERE row BETWEEN 1 AND nrows AND col BETWEEN 1 AND ncols)"""


def dense_sql() -> str:
    return "dom AS (SELECT CAST(a.v AS INT) AS row, CAST(b.v AS INT) AS col FROM g, LATERAL (SELECT unnest(generate_series(1, nrows)) AS v) a, LATERAL (SELECT unnest(generate_series(1, ncols)) AS v) b)"


# ---- filters and projections -------------------------------------------------------------------


@query("SELECT pid, classification FROM points WHERE classification IN (2, 9)")
def f1_class_filter(spark, d):
    return pts(spark, d).where(predicates.of_class([2, 9])).select("pid", "classification")


@query(f"""
WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}), p AS (SELECT DISTINCT pid, x, y FROM points WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT pid FROM p, e GROUP BY pid
HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1 THEN 1 ELSE 0 END) % 2 = 1""")
def f2_point_in_polygon(spark, d):
    return predicates.clip(pts(spark, d), ROI).select("pid").distinct()


@query("SELECT pid, x, y, z FROM points WHERE z BETWEEN 1000 AND 2500 AND intensity > 100 AND classification IN (4, 5)")
def f3_combined_mask(spark, d):
    return pts(spark, d).where(F.col("z").between(1000, 2500) & (F.col("intensity") > 100) & predicates.of_class([4, 5])).select("pid", "x", "y", "z")


@query("SELECT pid, label FROM points WHERE label <> 0")
def f4_labelled(spark, d):
    return pts(spark, d).where(predicates.labelled()).select("pid", "label")


@query(f"WITH {ref_sql(2.0)} SELECT pid, row, col FROM c")
def f5_f7_map_to_cell(spark, d):
    p = pts(spark, d)
    return grid.with_cell(p, grid.grid_over(p, 2.0)).select("pid", "row", "col")


@query(f"WITH {ref_sql(2.0)} SELECT DISTINCT row, col, ROUND(x0 + col * 2.0, 6) AS x, ROUND(y0 + row * -2.0, 6) AS y FROM c, g")
def f8_cell_to_map(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 2.0)
    x, y = ref.xy(F.col("row"), F.col("col"))
    return grid.with_cell(p, ref).select("row", "col").distinct().select("row", "col", r(x, 6, "x"), r(y, 6, "y"))


@query(f"""WITH {ref_sql(2.0)}, s AS (SELECT row, col, max(z) AS top FROM c GROUP BY row, col)
SELECT pid FROM c JOIN s USING (row, col) WHERE z >= top - 1 AND classification IN (4, 5)""")
def f6_canopy_margin(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 2.0)
    top = grid.rasterize(p, ref, "z", "max", out="top")
    return grid.with_cell(p, ref).join(top, ["row", "col"]).where((F.col("z") >= F.col("top") - 1) & predicates.of_class([4, 5])).select("pid")


@query("""WITH t AS (SELECT label, max(h) AS top FROM tree_metrics WHERE label IS NOT NULL GROUP BY label)
SELECT label, CASE WHEN h < 0 THEN 0.0 ELSE h END AS clamped, CASE WHEN top > 3 AND h <> 0 THEN h END AS kept FROM tree_metrics JOIN t USING (label)""")
def f10_f11_heights(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "tree_metrics").where("label is not null")
    top = F.max("h").over(Window.partitionBy("label"))
    return t.withColumn("top", top).select("label", predicates.clamp_heights(F.col("h")).alias("clamped"), predicates.thresholded(F.col("h"), F.col("top")).alias("kept"))


@query(f"""
WITH u AS (SELECT *, x - {P0[0]} AS qx, y - {P0[1]} AS qy FROM points), l AS (SELECT sqrt({P1[0] - P0[0]}**2 + {P1[1] - P0[1]}**2) AS n),
v AS (SELECT u.*, (qx * ({P1[0] - P0[0]} / n) + qy * ({P1[1] - P0[1]} / n)) AS t, qx * ({P1[1] - P0[1]} / n) - qy * ({P1[0] - P0[0]} / n) AS s, n FROM u, l)
SELECT pid, ROUND(abs(t), 6) AS rho, z, ROUND(abs(s), 6) AS d FROM v WHERE t BETWEEN 0 AND n AND abs(s) <= {WIDTH}""")
def f14_cross_section(spark, d):
    return predicates.cross_section(pts(spark, d), P0, P1, WIDTH).select("pid", r("rho", 6, "rho"), "z", r("d", 6, "d"))


# ---- rasters -----------------------------------------------------------------------------------


def _raster(name: str, fun: str, sql: str, value: str = "z", digits: int | None = None) -> None:
    def run(spark, d):
        p = pts(spark, d)
        x = grid.rasterize(p, grid.grid_over(p, 2.0), value, fun)
        return x if digits is None else x.withColumn("value", r("value", digits))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {ref_sql(2.0)} SELECT row, col, {sql} AS value FROM c GROUP BY row, col".replace("ROUND(", "round(1e-9 + ")


_raster("a1_rasterize_max", "max", "max(z)")
_raster("a1_rasterize_min", "min", "min(z)")
_raster("a1_rasterize_count", "count", "count(z)")
_raster("a1_rasterize_mean", "mean", "ROUND(avg(z), 5)", digits=5)
_raster("a1_rasterize_sum", "sum", "ROUND(sum(intensity), 3)", "intensity", 3)
_raster("a1_rasterize_std", "std", "ROUND(stddev_samp(z), 4)", digits=4)
_raster("a1_rasterize_median", "median", "ROUND(median(z), 5)", digits=5)


@query(f"WITH {ref_sql(2.0)} SELECT row, col, CAST(bool_or(z <> 0) AS DOUBLE) AS value FROM c GROUP BY row, col")
def a1_rasterize_any(spark, d):
    p = pts(spark, d)
    return grid.rasterize(p, grid.grid_over(p, 2.0), "z", "any").withColumn("value", F.col("value").cast("double"))



@query(f"""WITH {ref_sql(2.0)}, n AS (SELECT row, col, classification AS v, count(*) AS n FROM c WHERE classification IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, v) AS k FROM n) SELECT row, col, v AS value FROM o WHERE k = 1""")
def a1_rasterize_mode(spark, d):
    p = pts(spark, d)
    return stats.mode_smallest(grid.with_cell(p, grid.grid_over(p, 2.0)), ["row", "col"], "classification", "value")


@query(f"WITH {ref_sql(10.0)}, {dense_sql()}, v AS (SELECT row, col, max(z) AS value FROM c GROUP BY row, col) SELECT dom.row, dom.col, coalesce(value, -1.0) AS value FROM dom LEFT JOIN v ON dom.row = v.row AND dom.col = v.col")
def a1_rasterize_dense(spark, d):
    p = pts(spark, d)
    return grid.rasterize(p, grid.grid_over(p, 10.0), "z", "max", fill=-1.0, dense=True)


def _mask_sql(cell: float, radius: int) -> str:
    steps = ", ".join(f"({i}, {j})" for i, j, _ in grid.offsets(radius))
    return f"""{ref_sql(cell)}, o(i, j) AS (VALUES {steps}), m0 AS (SELECT row, col FROM c GROUP BY row, col HAVING bool_or(z <> 0)),
m AS (SELECT DISTINCT m0.row + i AS row, m0.col + j AS col FROM m0, o, g WHERE m0.row + i BETWEEN 1 AND nrows AND m0.col + j BETWEEN 1 AND ncols)"""


@query(f"WITH {_mask_sql(2.0, 1)} SELECT row, col FROM m")
def g1_data_mask(spark, d):
    p = pts(spark, d)
    return grid.data_mask(p, grid.grid_over(p, 2.0), closing=1.0)


@query(f"""WITH {_mask_sql(2.0, 1)}, n AS (SELECT row, col, count(*) AS a, sum(CASE WHEN classification IN (2, 9) THEN 1 ELSE 0 END) AS t, sum(CASE WHEN classification IN (3, 4, 5, 6) THEN 1 ELSE 0 END) AS s FROM c GROUP BY row, col)
SELECT row, col, coalesce(a, 0) AS density_overall, CAST(coalesce(t, 0) AS BIGINT) AS density_terrain, CAST(coalesce(s, 0) AS BIGINT) AS density_surface FROM m LEFT JOIN n USING (row, col)""")
def a2_density(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 2.0)
    return models.density_models(p, ref, grid.data_mask(p, ref), [2, 9], [3, 4, 5, 6])


@query(f"""WITH {_mask_sql(2.0, 1)}, n AS (SELECT row, col, count(*) AS a FROM c GROUP BY row, col), v AS (SELECT CAST(coalesce(a, 0) AS DOUBLE) AS a FROM m LEFT JOIN n USING (row, col))
SELECT median(a) AS median, ROUND(avg(a), 6) AS mean, max(a) AS max, ROUND(stddev_samp(a), 6) AS std FROM v""")
def a2_density_summary(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 2.0)
    s = models.density_summary(models.density_models(p, ref, grid.data_mask(p, ref), [2, 9], [3, 4, 5, 6]))
    return s.select("median", r("mean", 6, "mean"), "max", r("std", 6, "std"))


@query("""WITH n AS (SELECT count(*) AS n FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY CAST(round(x) AS BIGINT), CAST(round(y) AS BIGINT), CAST(round(z) AS BIGINT))
SELECT median(CAST(n AS DOUBLE)) AS pdensity FROM n""")
def a3_point_density(spark, d):
    return voxel.point_density(pts(spark, d))


@query(f"WITH {ref_sql(2.0)}, {dense_sql()}, v AS (SELECT row, col, avg(intensity) AS value FROM c GROUP BY row, col) SELECT dom.row, dom.col, ROUND(coalesce(value, 0.0), 4) AS value FROM dom LEFT JOIN v ON dom.row = v.row AND dom.col = v.col")
def a22_intensity_raster(spark, d):
    p = pts(spark, d)
    x = grid.rasterize(p, grid.grid_over(p, 2.0), "intensity", "mean", fill=0.0, dense=True)
    return x.withColumn("value", r("value", 4))


_KERNEL = [[0.0625, 0.125, 0.0625], [0.125, 0.25, 0.125], [0.0625, 0.125, 0.0625]]


def _idw_values() -> str:
    return ", ".join(f"({i}, {j}, {grid.cubic(x if x else 0.001)!r}::DOUBLE)" for i, j, x in grid.offsets(2))


@query(f"""WITH {ref_sql(5.0)}, o(i, j, w) AS (VALUES {_idw_values()}), t AS (SELECT row, col, avg(z) AS v FROM c WHERE classification IN (2, 9) AND z IS NOT NULL GROUP BY row, col)
SELECT CAST(t.row + i AS INT) AS row, CAST(t.col + j AS INT) AS col, ROUND(sum(w * v) / sum(w), 4) AS value FROM t, o, g WHERE t.row + i BETWEEN 1 AND nrows AND t.col + j BETWEEN 1 AND ncols GROUP BY 1, 2""")
def g2_idw(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 5.0)
    cells = grid.rasterize(p.where(predicates.of_class([2, 9]) & F.col("z").isNotNull()), ref, "z", "mean")
    return grid.idw(cells, ref, 2).withColumn("value", r("value", 4))


def _nearest_sql(cell: float, source: str) -> str:
    """CTE f: every cell with the value of the nearest cell of `source` (row, col, v)."""
    return f"""{ref_sql(cell)}, {dense_sql()}, src AS ({source}),
f AS (SELECT row, col, v, dist FROM (SELECT dom.row, dom.col, src.v, sqrt((dom.row - src.row) * (dom.row - src.row) + (dom.col - src.col) * (dom.col - src.col)) AS dist,
  row_number() OVER (PARTITION BY dom.row, dom.col ORDER BY (dom.row - src.row) * (dom.row - src.row) + (dom.col - src.col) * (dom.col - src.col), src.col, src.row) AS k FROM dom, src) WHERE k = 1)"""


_TERRAIN = "SELECT row, col, avg(z) AS v FROM c WHERE classification IN (2, 9) AND z IS NOT NULL GROUP BY row, col"
_SURFACE = "SELECT row, col, max(z) AS v FROM c WHERE classification IN (2, 9, 3, 4, 5, 6) AND z IS NOT NULL GROUP BY row, col"


@query(f"WITH {_nearest_sql(10.0, _TERRAIN)} SELECT row, col, ROUND(v, 4) AS value, ROUND(dist, 6) AS dist FROM f")
def g4_nearest_fill(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 10.0)
    cells = grid.rasterize(p.where(predicates.of_class([2, 9]) & F.col("z").isNotNull()), ref, "z", "mean")
    return grid.nearest_fill(cells, ref, whole=True).select("row", "col", r("value", 4, "value"), r("dist", 6, "dist"))


@query(f"""WITH {_nearest_sql(10.0, _SURFACE)}, o(i, j, w) AS (VALUES {", ".join(f"({i - 1}, {j - 1}, {_KERNEL[i][j]}::DOUBLE)" for i in range(3) for j in range(3))})
SELECT a.row, a.col, ROUND(sum(w * b.v), 4) AS surface FROM f a, o, g, f b WHERE b.row = greatest(1, least(nrows, a.row + i)) AND b.col = greatest(1, least(ncols, a.col + j)) GROUP BY a.row, a.col""")
def g5_g7_surface_model(spark, d):
    p = pts(spark, d)
    s = models.surface_model(p, grid.grid_over(p, 10.0), kernel=_KERNEL)
    return s.select("row", "col", r("surface", 4, "surface"))


@query(f"""WITH {_nearest_sql(10.0, _TERRAIN)}, s0 AS ({_SURFACE}), m AS (SELECT row, col FROM c GROUP BY row, col HAVING bool_or(z <> 0)),
s AS (SELECT row, col, v FROM (SELECT dom.row, dom.col, s0.v, row_number() OVER (PARTITION BY dom.row, dom.col ORDER BY (dom.row - s0.row) * (dom.row - s0.row) + (dom.col - s0.col) * (dom.col - s0.col), s0.col, s0.row) AS k FROM dom, s0) WHERE k = 1),
mm AS (SELECT DISTINCT m.row + i AS row, m.col + j AS col FROM m, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j), g WHERE m.row + i BETWEEN 1 AND nrows AND m.col + j BETWEEN 1 AND ncols)
SELECT mm.row, mm.col, ROUND(f.v, 4) AS terrain, ROUND(s.v, 4) AS surface, ROUND(greatest(s.v - f.v, 0), 4) AS height FROM mm JOIN f USING (row, col) JOIN s USING (row, col)""")
def g6_g8_elevation_models(spark, d):
    p = pts(spark, d)
    e = models.elevation_models(p, grid.grid_over(p, 10.0), layers=("terrain", "surface", "height"), method="nearest")
    return e.select("row", "col", *[r(k, 4, k) for k in ("terrain", "surface", "height")])


@query()
def g3_terrain_linear(spark, d):
    p = pts(spark, d)
    return models.elevation_models(p, grid.grid_over(p, 5.0), layers=("terrain",), method="linear")


@query()
def g3_terrain_natural(spark, d):
    p = pts(spark, d)
    return models.elevation_models(p, grid.grid_over(p, 5.0), layers=("terrain",), method="natural")


@query()
def g10_heights_linear(spark, d):
    p = pts(spark, d).select("pid", "x", "y", "z", "classification").distinct()
    return models.heights(p, method="linear").select("pid", r("h", 4, "h"))


@query("""
WITH p AS (SELECT DISTINCT pid, x, y, z, classification FROM points), t AS (SELECT pid, x, y, z FROM p WHERE classification = 2 AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
q AS (SELECT pid, x, y, z FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
n AS (SELECT q.pid, arg_min(t.z, (round(sqrt((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)), 9), t.pid)) AS g FROM q JOIN t ON t.x BETWEEN q.x - 16 AND q.x + 16 AND t.y BETWEEN q.y - 16 AND q.y + 16 GROUP BY q.pid)
SELECT p.pid, ROUND(CASE WHEN p.z - g < 0 THEN 0.0 ELSE p.z - g END, 6) AS h FROM p LEFT JOIN n USING (pid)""")
def g10_heights_above_ground(spark, d):
    p = pts(spark, d).select("pid", "x", "y", "z", "classification").distinct()
    h = models.heights(p)
    return h.select("pid", r(F.when(F.col("z").isNotNull(), F.col("h")), 6, "h"))


@query(f"""WITH {ref_sql(2.0)}, i AS (SELECT row, col, avg(intensity) AS v FROM c GROUP BY row, col) SELECT row, col, CAST(CASE WHEN v >= 17000 THEN 2 WHEN v >= 7500 THEN 1 WHEN v IS NOT NULL THEN 0 END AS DOUBLE) AS cls FROM i""")
def g14_threshold_classes(spark, d):
    p = pts(spark, d)
    x = grid.rasterize(p, grid.grid_over(p, 2.0), "intensity", "mean")
    return x.select("row", "col", predicates.threshold_classes(F.col("value"), [7500, 17000]).cast("double").alias("cls"))


@query(f"""WITH {_mask_sql(2.0, 1)}, e(i, j) AS (VALUES {", ".join(f"({i}, {j})" for i, j, _ in grid.offsets(2))}),
a AS (SELECT m.row, m.col, count(*) AS need FROM m, e, g WHERE m.row + i BETWEEN 1 AND nrows AND m.col + j BETWEEN 1 AND ncols GROUP BY 1, 2),
b AS (SELECT m.row, m.col, count(*) AS have FROM m, e JOIN m n ON n.row = m.row + i AND n.col = m.col + j GROUP BY 1, 2)
SELECT row, col FROM a JOIN b USING (row, col) WHERE need = have""")
def g15_erosion(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 2.0)
    return grid.erode(grid.data_mask(p, ref), ref, 2)


# ---- extents and tiles -------------------------------------------------------------------------


@query("""SELECT file, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax, count(*) AS npoints FROM points GROUP BY file""")
def a4_e2_bbox_extents(spark, d):
    return tiles.bbox_extents(pts(spark, d)).drop("ring_x", "ring_y")


_UTC_DATE = "CAST(to_timestamp(315964800 + t - CASE {} ELSE 0 END) AT TIME ZONE 'UTC' AS DATE)".format(
    " ".join(f"WHEN t >= epoch(TIMESTAMP '{day} 00:00:00') - 315964800 THEN {n}" for day, n in reversed(gpstime.LEAP_DATES[1:]))
)


@query(f"""WITH t AS (SELECT file, gps_time + 1e9 AS t FROM points WHERE gps_time IS NOT NULL), d AS (SELECT DISTINCT file, {_UTC_DATE} AS day FROM t)
SELECT file, count(*) AS nsurveys, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, string_agg(strftime(day, '%Y-%m-%d'), ', ' ORDER BY day) AS dates FROM d GROUP BY file""")
def a5_survey_dates(spark, d):
    x = tiles.survey_dates(pts(spark, d))
    return x.select("file", "nsurveys", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "dates")


@query(f"""WITH t AS (SELECT gps_time + 1e9 AS t FROM points WHERE gps_time IS NOT NULL) SELECT DISTINCT CAST({_UTC_DATE} AS VARCHAR) AS day FROM t""")
def a23_distinct_dates(spark, d):
    t = pts(spark, d).where("gps_time is not null").select(F.to_date(gpstime.adjusted_to_utc(F.col("gps_time"))).cast("string").alias("day"))
    return t.distinct().orderBy("day")


@query("""WITH n AS (SELECT file, count(*) AS n FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY file, CAST(round(x) AS BIGINT), CAST(round(y) AS BIGINT), CAST(round(z) AS BIGINT))
SELECT file, median(CAST(n AS DOUBLE)) AS pdensity FROM n GROUP BY file""")
def a3_tile_density(spark, d):
    return tiles.tile_density(pts(spark, d))


@query()
def e4_concave_extents(spark, d):
    return hulls.concave_extents(pts(spark, d)).select("file", r("area", 3, "area"), F.size("ring_x").alias("corners"))


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}), t AS (SELECT filename, xmin, ymin, xmax, ymax FROM extents WHERE xmin IS NOT NULL),
k AS (SELECT filename, unnest([xmin, xmin, xmax, xmax]) AS x, unnest([ymin, ymax, ymin, ymax]) AS y FROM t),
inside AS (SELECT filename FROM k, e GROUP BY filename, x, y HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1 THEN 1 ELSE 0 END) % 2 = 1),
vertex AS (SELECT filename FROM t, e WHERE x1 BETWEEN xmin AND xmax AND y1 BETWEEN ymin AND ymax),
crossing AS (SELECT filename FROM t, e WHERE greatest(0.0, least((xmin - x1) / (x2 - x1), (xmax - x1) / (x2 - x1)), least((ymin - y1) / (y2 - y1), (ymax - y1) / (y2 - y1)))
  <= least(1.0, greatest((xmin - x1) / (x2 - x1), (xmax - x1) / (x2 - x1)), greatest((ymin - y1) / (y2 - y1), (ymax - y1) / (y2 - y1))))
SELECT filename FROM inside UNION SELECT filename FROM vertex UNION SELECT filename FROM crossing""")
def e5_tile_pruning(spark, d):
    return tiles.prune(table(spark, d, "extents"), ROI).select("filename")


@query(f"""
WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}), p AS (SELECT DISTINCT pid, file, x, y FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND file IN (SELECT filename FROM extents WHERE xmin <= 2600060.005 AND xmax >= 2600008.005 AND ymin <= 1150050.005 AND ymax >= 1150005.005))
SELECT pid, file FROM p, e GROUP BY pid, file
HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1 THEN 1 ELSE 0 END) % 2 = 1""")
def f13_clip_tiles(spark, d):
    return tiles.clip_tiled(pts(spark, d), table(spark, d, "extents"), ROI).select("pid", "file").distinct()


@query("""SELECT s.stand_id AS region, e.filename AS tile FROM stands s JOIN extents e ON s.xmin <= e.xmax AND s.xmax >= e.xmin AND s.ymin <= e.ymax AND s.ymax >= e.ymin""")
def j8_clippers_by_tile(spark, d):
    return tiles.clippers_by_tile(table(spark, d, "stands"), table(spark, d, "extents"))


@query("""WITH r AS (SELECT DISTINCT classification AS part, point_source_id AS record_id, 'c' || classification AS value FROM points WHERE classification IN (2, 5) AND point_source_id IS NOT NULL)
SELECT record_id, string_agg(value, '' ORDER BY part) AS value FROM r GROUP BY record_id HAVING count(DISTINCT part) = (SELECT count(DISTINCT part) FROM r)""")
def j9_o5_common_records(spark, d):
    p = pts(spark, d).where("classification in (2, 5) and point_source_id is not null")
    rec = p.select(F.col("classification").alias("part"), F.col("point_source_id").alias("record_id"), F.concat(F.lit("c"), F.col("classification").cast("string")).alias("value")).distinct()
    return tiles.merge_records(rec)


@query("""SELECT pid, x, y, z, CAST(red AS DOUBLE) AS red, 1 AS part FROM points WHERE classification = 2 UNION ALL SELECT pid, x, y, z, 0.0, 2 FROM points WHERE classification = 9""")
def o4_w7_merge_points(spark, d):
    p = pts(spark, d)
    a = p.where("classification = 2").select("pid", "x", "y", "z", "red")
    b = p.where("classification = 9").select("pid", "x", "y", "z", "blue")
    return tiles.merge_points([a, b], source="part").withColumn("red", F.col("red").cast("double"))


@query("SELECT DISTINCT label FROM points WHERE label IN (SELECT label FROM tree_metrics) EXCEPT SELECT label FROM tree_metrics WHERE h < 0")
def o6_set_operations(spark, d):
    t = table(spark, d, "tree_metrics")
    return pts(spark, d).select("label").intersect(t.select("label")).subtract(t.where("h < 0").select("label"))


# ---- voxels ------------------------------------------------------------------------------------

_V = "CAST(round(x / 0.5) AS BIGINT) AS v_x, CAST(round(y / 0.5) AS BIGINT) AS v_y, CAST(round(z / 0.5) AS BIGINT) AS v_z"
_XYZ = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"


@query(f"SELECT DISTINCT v_x * 0.5::DOUBLE AS x, v_y * 0.5::DOUBLE AS y, v_z * 0.5::DOUBLE AS z FROM (SELECT {_V} FROM points WHERE {_XYZ})")
def a6_subsample_grid(spark, d):
    return voxel.subsample_grid(pts(spark, d), 0.5)


@query(f"SELECT pid, dense_rank() OVER (ORDER BY v_x, v_y, v_z) AS voxel FROM (SELECT pid, {_V} FROM points WHERE {_XYZ})")
def a6_voxel_index(spark, d):
    return voxel.voxel_index(pts(spark, d), 0.5).select("pid", "voxel")


@query(f"SELECT v_x, v_y, v_z, ROUND(avg(x), 4) AS x, ROUND(avg(y), 4) AS y, ROUND(avg(z), 4) AS z FROM (SELECT x, y, z, {_V} FROM points WHERE {_XYZ}) GROUP BY 1, 2, 3")
def a7_subsample_mean(spark, d):
    m = voxel.subsample_mean(pts(spark, d), 0.5)
    return m.select("v_x", "v_y", "v_z", *[r(k, 4, k) for k in "xyz"])


@query("""WITH e AS (SELECT label, vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS v FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i),
s AS (SELECT e.label, e.vec_id, round(sum((x - m) * (x - m)), 9) AS dist FROM (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1, 2)
SELECT label, arg_min(vec_id, (dist, vec_id)) AS vec_id FROM s GROUP BY label""")
def a10_medoid_of_vectors(spark, d):
    return voxel.medoid_of_vectors(table(spark, d, "embeddings"), "label", "embedding", "vec_id").select("label", "vec_id")


_BIN = f"""m AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM points WHERE {_XYZ}),
b AS (SELECT pid, floor((x - mx) / 0.5) AS bx, floor((y - my) / 0.5) AS ky, floor((z - mz) / 0.5) AS bz FROM points, m WHERE {_XYZ})"""


@query(f"WITH {_BIN} SELECT pid, ROUND(count(*) OVER (PARTITION BY bx, ky, bz) / count(*) OVER (PARTITION BY bx, ky), 7) AS echo_ratio FROM b")
def a11_echo_ratio(spark, d):
    return voxel.echo_ratio(pts(spark, d), 0.5).select("pid", r("echo_ratio", 7, "echo_ratio"))


@query(f"WITH {_BIN}, n AS (SELECT bx, ky, bz, count(*) AS n FROM b GROUP BY 1, 2, 3), q AS (SELECT *, n / sum(n) OVER (PARTITION BY bx, ky ORDER BY bz) AS e FROM n) SELECT pid, ROUND(CAST(e AS DOUBLE), 7) AS echo_ratio FROM b JOIN q USING (bx, ky, bz)")
def a12_echo_ratio_cumulative(spark, d):
    return voxel.echo_ratio(pts(spark, d), 0.5, "cumulative").select("pid", r("echo_ratio", 7, "echo_ratio"))


# ---- segments ----------------------------------------------------------------------------------


def hazen_sql(values: str, p: float) -> str:
    """Hazen quantile of a sorted list expression."""
    at = f"least(greatest(len({values}) * {p} + 0.5, 1.0), CAST(len({values}) AS DOUBLE))"
    low, high = f"{values}[CAST(floor({at}) AS BIGINT)]", f"{values}[least(CAST(floor({at}) AS BIGINT) + 1, len({values}))]"
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


_SEG = f"s AS (SELECT * FROM points WHERE label <> 0 AND {_XYZ})"
_QUANT = f"q AS (SELECT {hazen_sql('l', 0.01)} AS lo, {hazen_sql('l', 0.99)} AS hi FROM (SELECT list_sort(list(intensity)) AS l FROM s WHERE intensity IS NOT NULL))"
_SCALED = "si AS (SELECT s.*, CASE WHEN intensity IS NOT NULL THEN (least(greatest(intensity, lo), hi) - lo) / (hi - lo) END AS i FROM s, q)"
_SKEW = lambda v: f"(sum({v}*{v}*{v}) / count({v}) - 3 * avg({v}) * sum({v}*{v}) / count({v}) + 2 * avg({v})**3) / nullif(var_pop({v}) ** 1.5, 0)"


@query(f"WITH {_SEG}, {_QUANT}, {_SCALED} SELECT pid, ROUND(i, 8) AS iscaled FROM si")
def a13_scaled_intensity(spark, d):
    p = pts(spark, d).where(predicates.labelled() & F.expr(_XYZ))
    return segments.scale_intensity(p).select("pid", r("iscaled", 8, "iscaled"))


@query(f"""WITH {_SEG}, a AS (SELECT label, count(*) AS n, max(z) AS zmax, min(z) AS z0, avg(z) AS zm, stddev_samp(z) AS zs, list_sort(list(z)) AS l, any_value(kp) AS kp,
  arg_max(x, (z, -pid)) AS xa, arg_max(y, (z, -pid)) AS ya, sum(power(z - mu, 3)) / count(*) / nullif(var_pop(z) ** 1.5, 0) AS sk FROM s JOIN (SELECT label, avg(z) AS mu, kurtosis_pop(z) + 3 AS kp FROM s GROUP BY label) USING (label) GROUP BY label)
SELECT label, n AS NPoints, xa AS XPos, ya AS YPos, z0 AS ZPos, ROUND((zm - z0) / (zmax - z0), 6) AS HMean, ROUND(zs / (zmax - z0), 6) AS HStdDev, ROUND(zs / (zm - z0), 6) AS HCoefVar,
  ROUND(kp, 4) AS HKurt, ROUND(sk, 4) AS HSkew, {", ".join(f"ROUND(({hazen_sql('l', k / 100)} - z0) / (zmax - z0), 6) AS HQ{k}" for k in (25, 50, 75, 90))}, ROUND(zmax - z0, 6) AS H
FROM a WHERE zmax > z0 AND n > 1""")
def m_height_metrics(spark, d):
    names = ["NPoints", "XPos", "YPos", "ZPos", "HMean", "HStdDev", "HCoefVar", "HKurt", "HSkew", "HQ25", "HQ50", "HQ75", "HQ90", "H"]
    m = segments.segment_metrics(pts(spark, d), names)
    return m.select("label", *[r(n, 4 if n in ("HKurt", "HSkew") else 6, n) if n[0] == "H" else F.col(n) for n in names])


@query(f"""WITH {_SEG}, {_QUANT}, {_SCALED}, a AS (SELECT label, list_sort(list(i) FILTER (i IS NOT NULL)) AS l, avg(i) AS m, max(i) AS mx, CASE WHEN count(i) = 1 THEN 0 ELSE stddev_samp(i) END AS sd,
  kurtosis_pop(i) + 3 AS kp, sum(power(i - mu, 3)) / count(i) / nullif(var_pop(i) ** 1.5, 0) AS sk FROM si JOIN (SELECT label, avg(i) AS mu FROM si GROUP BY label) USING (label) GROUP BY label HAVING count(i) > 0 AND min(i) < max(i))
SELECT label, {", ".join(f"ROUND({hazen_sql('l', k / 100)}, 6) AS IQ{k}" for k in (25, 50, 75, 90))}, ROUND(m, 6) AS IMean, ROUND(mx, 6) AS IMax, ROUND(sd, 6) AS IStdDev, ROUND(sd / m, 6) AS ICoefVar, ROUND(kp, 4) AS IKurt, ROUND(sk, 4) AS ISkew FROM a WHERE m <> 0""")
def m_intensity_metrics(spark, d):
    names = ["IQ25", "IQ50", "IQ75", "IQ90", "IMean", "IMax", "IStdDev", "ICoefVar", "IKurt", "ISkew"]
    m = segments.segment_metrics(pts(spark, d), names)
    return m.select("label", *[r(n, 4 if n in ("IKurt", "ISkew") else 6, n) for n in names])


@query(f"""WITH {_SEG} SELECT label, ROUND(median(CASE WHEN number_of_returns <> 0 THEN return_number / number_of_returns END), 6) AS OpacityQ50,
  ROUND(avg(CASE WHEN return_number = 1 AND number_of_returns = 1 THEN 1.0 ELSE 0.0 END), 6) AS SRFrac, ROUND(avg(CASE WHEN return_number = 1 AND number_of_returns > 1 THEN 1.0 ELSE 0.0 END), 6) AS FRFrac,
  ROUND(avg(CASE WHEN return_number = number_of_returns AND number_of_returns > 1 THEN 1.0 ELSE 0.0 END), 6) AS LRFrac FROM s GROUP BY label""")
def m_opacity_metrics(spark, d):
    names = ["OpacityQ50", "SRFrac", "FRFrac", "LRFrac"]
    return segments.segment_metrics(pts(spark, d), names).select("label", *[r(n, 6, n) for n in names])


@query(f"""WITH {_SEG}, k AS (SELECT label, red, green, nullif(red + green + blue, 0) AS t FROM s),
a AS (SELECT label, median(CAST(red AS DOUBLE) / t) AS rq, median(CAST(green AS DOUBLE) / t) AS gq FROM k GROUP BY label)
SELECT label, ROUND(rq, 6) AS RChroQ50, ROUND(gq, 6) AS GChroQ50 FROM a WHERE rq IS NOT NULL AND gq IS NOT NULL""")
def m_color_metrics(spark, d):
    names = ["RChroQ50", "GChroQ50"]
    return segments.segment_metrics(pts(spark, d), names).select("label", *[r(n, 6, n) for n in names])


@query(f"""WITH {_SEG} SELECT label, dense_rank() OVER (ORDER BY label) AS LUID, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax FROM s GROUP BY label""")
def m_luid_bbox(spark, d):
    return segments.segment_metrics(pts(spark, d), ["LUID", "BBOX3D"]).select("label", "LUID", "BBOX3D.*")


@query(f"""WITH {_SEG} SELECT label, count(*) AS n, ROUND(sum(x), 2) AS sx, ROUND(sum(z), 2) AS sz, CAST(sum(intensity) IS NOT NULL AS BOOLEAN) AS any_intensity FROM s GROUP BY label""")
def a19_point_lists(spark, d):
    m = segments.segment_metrics(pts(spark, d), ["XYZ"])
    p = pts(spark, d).where(predicates.labelled() & F.expr(_XYZ)).groupBy("label").agg(F.sum("intensity").isNotNull().alias("any_intensity"))
    add = lambda k: F.aggregate("XYZ", F.lit(0.0), lambda a, q: a + q[k])
    return m.select("label", F.size("XYZ").cast("long").alias("n"), r(add("x"), 2, "sx"), r(add("z"), 2, "sz")).join(p, "label")


@query()
def m_shape_metrics(spark, d):
    names = ["CVH2DArea", "CD", "CVH3DArea", "CVH3DVol", "CVH3DRa", "CVH3DPD", "CVH3DSS", "Sphericity", "AspRatio", "PCVar1", "PCVar2", "PCVar3"]
    return segments.segment_metrics(pts(spark, d), names).select("label", *[r(n, 5, n) for n in names])


@query()
def m_alpha_shape_metrics(spark, d):
    names = ["CCH2DArea", "CCH3DArea", "CCH3DVol", "CCH3DRa", "CCH3DPD", "CCH3DSS", "Cvty3D", "CVH3DLac"]
    return segments.segment_metrics(pts(spark, d), names).select("label", *[r(n, 5, n) for n in names])


@query()
def m_all_metrics(spark, d):
    p = pts(spark, d)
    ref = grid.grid_over(p, 5.0)
    dtm = materialise(models.elevation_models(p, ref, layers=("terrain",), method="nearest"), "dtm")
    return segments.segment_metrics(p, ["scalar"], dtm=dtm, ref=ref).drop("UUID", "Random")


@query(f"""WITH {ref_sql(2.0)}, t AS (SELECT row, col, label, z FROM c WHERE label <> 0), s AS (SELECT label, avg(z) AS m, max(z) AS top FROM t GROUP BY label)
SELECT DISTINCT row, col, label, ROUND(m, 4) AS mean, top FROM t JOIN s USING (label)""")
def a20_segment_raster_stats(spark, d):
    p = pts(spark, d)
    c = grid.with_cell(p, grid.grid_over(p, 2.0)).where(predicates.labelled()).select("row", "col", "label", "z")
    # aggregated and joined back, as a window would gather a large segment in one task
    s = c.groupBy("label").agg(r(F.avg("z"), 4, "mean"), F.max("z").alias("top"))
    return c.select("row", "col", "label").distinct().join(s, "label")


@query(f"""WITH {ref_sql(2.0)}, o AS (SELECT row, col, max(z) AS v, max(label) AS label FROM c WHERE label <> 0 GROUP BY row, col)
SELECT label, count(*) AS area, ROUND(avg(col), 6) AS ccol, ROUND(avg(row), 6) AS crow, max(v) AS top FROM o GROUP BY label""")
def a21_region_properties(spark, d):
    p = pts(spark, d).where(predicates.labelled())
    ref = grid.grid_over(pts(spark, d), 2.0)
    o = grid.with_cell(p, ref).groupBy("row", "col").agg(F.max("z").alias("v"), F.max("label").alias("label"))
    return o.groupBy("label").agg(F.count("*").alias("area"), r(F.avg("col"), 6, "ccol"), r(F.avg("row"), 6, "crow"), F.max("v").alias("top"))


# ---- pulses and time ---------------------------------------------------------------------------

_PULSE = """p AS (SELECT DISTINCT pid, point_source_id, gps_time, return_number FROM points WHERE point_source_id IS NOT NULL AND gps_time IS NOT NULL AND return_number IS NOT NULL),
l AS (SELECT *, lag(return_number) OVER w AS before FROM p WINDOW w AS (PARTITION BY point_source_id ORDER BY gps_time, pid)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR return_number <= before THEN 1 ELSE 0 END) OVER (PARTITION BY point_source_id ORDER BY gps_time, pid ROWS UNBOUNDED PRECEDING) AS pulse_number FROM l)"""


def _pulses(spark, d):
    return pulses.number_pulses(pts(spark, d).select("pid", "point_source_id", "gps_time", "return_number").distinct())


@query(f"WITH {_PULSE} SELECT pid, CAST(pulse_number AS BIGINT) AS pulse_number FROM n")
def w1_pulse_number(spark, d):
    return _pulses(spark, d).select("pid", "pulse_number")


@query(f"WITH {_PULSE} SELECT point_source_id, CAST(pulse_number AS BIGINT) AS pulse_number, count(*) AS pulse_returns FROM n GROUP BY 1, 2")
def w2_pulse_returns(spark, d):
    return pulses.pulse_returns(_pulses(spark, d))


@query(f"""WITH {_PULSE}, m AS (SELECT point_source_id, max(pulse_number) AS total FROM n GROUP BY 1)
SELECT pid, CAST(pulse_number + (row_number() OVER (PARTITION BY point_source_id, pulse_number ORDER BY gps_time, pid) - 1) * total AS BIGINT) AS ind_pulse FROM n JOIN m USING (point_source_id)""")
def w3_pulse_index(spark, d):
    return pulses.pulse_index(_pulses(spark, d)).select("pid", "ind_pulse")


_LEAP = "CASE {} ELSE 0 END".format(" ".join(f"WHEN t >= epoch(TIMESTAMP '{day} 00:00:00') - 315964800 THEN {n}" for day, n in reversed(gpstime.LEAP_DATES[1:])))


@query(f"WITH t AS (SELECT pid, gps_time + 1e9 AS t FROM points WHERE gps_time IS NOT NULL) SELECT pid, CAST(round((315964800 + t - {_LEAP}) * 1e6) AS BIGINT) AS utc_us FROM t")
def j7_gps_to_utc(spark, d):
    p = pts(spark, d).where("gps_time is not null")
    return p.select("pid", F.unix_micros(gpstime.adjusted_to_utc(F.col("gps_time"))).alias("utc_us"))


# ---- colours -----------------------------------------------------------------------------------

_ADJ = """v AS (SELECT DISTINCT label, CAST(round(x / 2) AS BIGINT) AS vx, CAST(round(y / 2) AS BIGINT) AS vy, CAST(round(z / 2) AS BIGINT) AS vz FROM points WHERE label <> 0 AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
e AS (SELECT DISTINCT a.label AS a, b.label AS b FROM v a JOIN v b ON a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz AND a.label < b.label)"""


@query(f"WITH {_ADJ} SELECT a, b FROM e")
def c1_j14_adjacency(spark, d):
    return coloring.adjacency(pts(spark, d))


@query(f"""WITH {_ADJ}, n AS (SELECT a AS l FROM e UNION ALL SELECT b FROM e), k AS (SELECT DISTINCT label FROM points WHERE label <> 0),
q AS (SELECT label, count(l) AS degree FROM k LEFT JOIN n ON label = l GROUP BY label) SELECT label, degree, row_number() OVER (ORDER BY degree DESC, label) AS rank FROM q""")
def w6_degree_order(spark, d):
    p = pts(spark, d)
    return coloring.degree_order(coloring.adjacency(p), p)


