"""Queries of height rasters, segments, colours and ids over the whole tables, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laserloom.functions import gpstime
from laserloom.operators import coloring, components, grid, models, predicates, pulses, segmentation, segments, tiles
from laserloom.plans.pointcloud import _ADJ, _LEAP, _TERRAIN, _UTC_DATE, _XYZ, _mask_sql, _nearest_sql, hazen_sql, pts, query, r, ref_sql
from laserloom.session import materialise, table

# ---- ids and times -----------------------------------------------------------------------------


@query("SELECT label, 32::BIGINT AS digits FROM tree_metrics")
def s14_guids(spark, d) -> DataFrame:
    """The number of hexadecimal digits of each row's new id."""
    g = tiles.add_guid(table(spark, d, "tree_metrics").select("label"), "guid")
    return g.select("label", F.length(F.regexp_extract("guid", "^[0-9a-f]+$", 0)).cast("long").alias("digits"))


@query("SELECT count(*) AS rows, count(*) AS ids FROM points")
def s14_guids_differ(spark, d) -> DataFrame:
    return tiles.add_guid(pts(spark, d).select("pid"), "guid").agg(F.count("*").alias("rows"), F.count_distinct("guid").alias("ids"))


_WEEKS = "wk AS (SELECT point_source_id, min(CAST(floor((gps_time + 1e9) / 604800) AS INT)) AS week FROM sbet WHERE gps_time IS NOT NULL AND point_source_id IS NOT NULL GROUP BY 1)"
_SOW = "sow AS (SELECT pid, point_source_id, round(gps_time + 1e9 - floor((gps_time + 1e9) / 604800) * 604800, 6) AS s FROM points)"


@query(f"""WITH {_WEEKS}, {_SOW}, f AS (SELECT pid, week * 604800.0::DOUBLE + s AS t FROM sow LEFT JOIN wk USING (point_source_id))
SELECT pid, ROUND(t, 4) AS satellite, ROUND(t - 1e9, 4) AS adjusted, CAST(round((315964800 + t - {_LEAP}) * 1e6) AS DOUBLE) AS utc_us FROM f""")
def j6_week_time(spark, d) -> DataFrame:
    """Returns that carry seconds of the week only, timed by the week of their line's trajectory."""
    t = F.col("gps_time") + F.lit(1e9)
    week = F.floor(t / F.lit(604800.0))
    weeks = table(spark, d, "sbet").select("point_source_id", week.cast("int").alias("gps_week"))
    p = pts(spark, d).select("pid", "point_source_id", F.round(t - week * F.lit(604800.0), 6).alias("gps_time"))
    for form in ("satellite", "adjusted", "utc"):
        p = pulses.line_times(p, weeks, form=form, out=form)
    return p.select("pid", r("satellite", 4, "satellite"), r("adjusted", 4, "adjusted"), F.unix_micros("utc").cast("double").alias("utc_us"))


# ---- models ------------------------------------------------------------------------------------


@query(f"""WITH {_nearest_sql(10.0, _TERRAIN)}, m AS (SELECT row, col FROM c GROUP BY row, col HAVING bool_or(z <> 0)),
mm AS (SELECT DISTINCT m.row + i AS row, m.col + j AS col FROM m, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j), g WHERE m.row + i BETWEEN 1 AND nrows AND m.col + j BETWEEN 1 AND ncols),
rad AS (SELECT greatest(1, ceil(max(dist) - 1e-9)) AS r FROM f),
iv AS (SELECT mm.row, mm.col, sum(v / power(CASE WHEN d = 0 THEN 0.001 ELSE d END, 3)) / sum(1 / power(CASE WHEN d = 0 THEN 0.001 ELSE d END, 3)) AS v
  FROM (SELECT mm.row, mm.col, src.v, sqrt((mm.row - src.row) ** 2 + (mm.col - src.col) ** 2) AS d, r FROM mm, src, rad) mm WHERE d <= r GROUP BY mm.row, mm.col)
SELECT row, col, ROUND(v, 3) AS terrain FROM iv""")
def g2_terrain_idw_unbounded(spark, d) -> DataFrame:
    p = pts(spark, d)
    e = models.elevation_models(p, grid.grid_over(p, 10.0), layers=("terrain",), method="idw")
    return e.select("row", "col", r("terrain", 3, "terrain"))


_GAUSS = grid.gaussian(3, 0.8)


@query(f"""WITH {_nearest_sql(10.0, _TERRAIN)}, o(i, j, w) AS (VALUES {", ".join(f"({i - 1}, {j - 1}, {_GAUSS[i][j]!r}::DOUBLE)" for i in range(3) for j in range(3))})
SELECT a.row, a.col, ROUND(sum(w * b.v), 4) AS terrain FROM f a, o, g, f b WHERE b.row = greatest(1, least(nrows, a.row + i)) AND b.col = greatest(1, least(ncols, a.col + j)) GROUP BY a.row, a.col""")
def g6_gaussian_terrain(spark, d) -> DataFrame:
    p = pts(spark, d)
    t = models.terrain_model(p, grid.grid_over(p, 10.0), method="nearest", kernel=_GAUSS)
    return t.select("row", "col", r("terrain", 4, "terrain"))


@query(f"""WITH {_nearest_sql(10.0, _TERRAIN)}, m AS (SELECT row, col FROM c GROUP BY row, col HAVING bool_or(z <> 0)),
mm AS (SELECT DISTINCT m.row + i AS row, m.col + j AS col FROM m, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j), g WHERE m.row + i BETWEEN 1 AND nrows AND m.col + j BETWEEN 1 AND ncols),
n AS (SELECT row, col, count(*) AS a FROM c GROUP BY row, col)
SELECT mm.row, mm.col, coalesce(a, 0) AS density_overall, ROUND(f.v, 4) AS terrain FROM mm JOIN f USING (row, col) LEFT JOIN n USING (row, col)""")
def g9_selected_layers(spark, d) -> DataFrame:
    p = pts(spark, d)
    e = models.elevation_models(p, grid.grid_over(p, 10.0), layers=("density", "terrain"), method="nearest")
    return e.select("row", "col", "density_overall", r("terrain", 4, "terrain"))


@query(f"WITH {ref_sql(2.0)} SELECT row, col, quantile_disc(z, 0.9) - min(z) AS value FROM c WHERE z IS NOT NULL GROUP BY row, col")
def h_custom_aggregate(spark, d) -> DataFrame:
    """Any aggregate may fill a raster."""
    p = pts(spark, d).where("z is not null")
    spread = lambda v: F.expr("percentile_disc(0.9) within group (order by z)") - F.min(v)
    return grid.rasterize(p, grid.grid_over(pts(spark, d), 2.0), "z", spread)


def _weight(distance: float) -> float:
    return 1.0 / (1.0 + distance)


_WEIGHTS = ", ".join(f"({i}, {j}, {_weight(x if x else 0.001)!r}::DOUBLE)" for i, j, x in grid.offsets(3))


@query(f"""WITH {ref_sql(5.0)}, o(i, j, w) AS (VALUES {_WEIGHTS}), t AS (SELECT row, col, avg(z) AS v FROM c WHERE classification IN (2, 9) AND z IS NOT NULL GROUP BY row, col)
SELECT CAST(t.row + i AS INT) AS row, CAST(t.col + j AS INT) AS col, ROUND(sum(w * v) / sum(w), 4) AS value FROM t, o, g WHERE t.row + i BETWEEN 1 AND nrows AND t.col + j BETWEEN 1 AND ncols GROUP BY 1, 2""")
def h_own_weight_and_radius(spark, d) -> DataFrame:
    p = pts(spark, d)
    ref = grid.grid_over(p, 5.0)
    cells = grid.rasterize(p.where(predicates.of_class([2, 9]) & F.col("z").isNotNull()), ref, "z", "mean")
    return grid.idw(cells, ref, 3, _weight).withColumn("value", r("value", 4))


# ---- peaks, watersheds, superpixels ------------------------------------------------------------

#: CTEs h (row, col, h, k): heights of at least 2 in the canopy model, k the number of the cell.
_CHM = f"""{_nearest_sql(2.0, _TERRAIN).split(", dom AS")[0]}, m0 AS (SELECT row, col FROM c GROUP BY row, col HAVING bool_or(z <> 0)),
mm AS (SELECT DISTINCT m0.row + i AS row, m0.col + j AS col FROM m0, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(i, j), g WHERE m0.row + i BETWEEN 1 AND nrows AND m0.col + j BETWEEN 1 AND ncols),
s1 AS ({_TERRAIN}), s2 AS (SELECT row, col, max(z) AS v FROM c WHERE classification IN (2, 9, 3, 4, 5, 6) AND z IS NOT NULL GROUP BY row, col),
n1 AS (SELECT mm.row, mm.col, arg_min(s.v, ((mm.row - s.row) ** 2 + (mm.col - s.col) ** 2, s.col, s.row)) AS v FROM mm, s1 s GROUP BY mm.row, mm.col),
n2 AS (SELECT mm.row, mm.col, arg_min(s.v, ((mm.row - s.row) ** 2 + (mm.col - s.col) ** 2, s.col, s.row)) AS v FROM mm, s2 s GROUP BY mm.row, mm.col),
h AS (SELECT row, col, greatest(n2.v - n1.v, 0) AS h, CAST(row - 1 AS BIGINT) * ncols + col AS k FROM n1 JOIN n2 USING (row, col), g WHERE n2.v - n1.v >= 2)"""


def _canopy(spark, d, cell: float = 2.0):
    """Points, grid and height raster of the canopy: greatest return less the mean ground, as the points give it (faulty
    heights are taken out beforehand with the spikes operator)."""
    p = pts(spark, d)
    ref = grid.grid_over(p, cell)
    e = models.elevation_models(p, ref, layers=("height",), method="nearest")
    return p, ref, materialise(e.select("row", "col", F.col("height").alias("value")), "chm")


def _peak_steps(cell: float = 2.0, longest: float = 5.0) -> str:
    return ", ".join(f"({i}, {j}, {x!r}::DOUBLE)" for i, j, x in grid.offsets(max(longest / cell, 1.5)) if x > 0)


@query(f"""WITH {_CHM}, o(i, j, dist) AS (VALUES {_peak_steps()}), q AS (SELECT *, greatest(least(0.28 * power(h, 0.59), 5.0) / 2.0, 1.5) AS reach FROM h),
beaten AS (SELECT DISTINCT q.row, q.col FROM q, o JOIN h n ON n.row = q.row + o.i AND n.col = q.col + o.j WHERE o.dist <= q.reach AND (n.h > q.h OR n.h = q.h AND (n.row < q.row OR n.row = q.row AND n.col < q.col)))
SELECT row, col, ROUND(h, 6) AS height FROM h ANTI JOIN beaten USING (row, col)""")
def g11_canopy_peaks(spark, d) -> DataFrame:
    _, ref, h = _canopy(spark, d)
    return segmentation.peaks(h, ref).select("row", "col", r("height", 6, "height"))


#: CTE seg (row, col, k, segment): each cell follows the highest cell within two, ever on.
_WATERSHED = f"""{_CHM}, o(i, j) AS (VALUES {", ".join(f"({i}, {j})" for i, j, _ in grid.offsets(2.0))}),
up AS (SELECT h.k, arg_max(n.k, (n.h, -n.k)) AS up FROM h, o JOIN h n ON n.row = h.row + o.i AND n.col = h.col + o.j GROUP BY h.k),
path AS (SELECT k, up AS at FROM up UNION SELECT path.k, up.up FROM path JOIN up ON up.k = path.at),
seg AS (SELECT h.row, h.col, h.k, path.at AS segment FROM path JOIN up ON up.k = path.at AND up.up = path.at JOIN h ON h.k = path.k)"""


@query(f"WITH RECURSIVE {_WATERSHED} SELECT row, col, segment FROM seg")
def g12_tree_watershed(spark, d) -> DataFrame:
    _, ref, h = _canopy(spark, d)
    return segmentation.watershed(h, ref)


@query(f"""WITH RECURSIVE {_WATERSHED}, lab AS (SELECT segment, dense_rank() OVER (ORDER BY segment) AS label FROM (SELECT DISTINCT segment FROM seg))
SELECT k.pid, CASE WHEN k.classification IN (3, 4, 5) THEN coalesce(lab.label, 0) ELSE 0 END AS label FROM k LEFT JOIN seg ON seg.row = k.row AND seg.col = k.col LEFT JOIN lab USING (segment)""")
def g16_segments_to_points(spark, d) -> DataFrame:
    p, ref, h = _canopy(spark, d)
    return segmentation.label_points(p, segmentation.watershed(h, ref), ref, vegetation=(3, 4, 5)).select("pid", "label")


def _superpixel_sql(step: float, weight: float, rounds: int) -> str:
    near = ", ".join(f"({i}, {j})" for i in (-1, 0, 1) for j in (-1, 0, 1))
    out = f"""{ref_sql(5.0)}, im AS (SELECT row, col, avg(intensity) AS i FROM c GROUP BY row, col HAVING count(intensity) > 0),
qq AS (SELECT {hazen_sql("l", 0.02)} AS lo, {hazen_sql("l", 0.98)} AS hi FROM (SELECT list_sort(list(i)) AS l FROM im)),
d AS (SELECT row, col, least(greatest((i - lo) / (hi - lo), 0), 1) AS v, CAST(floor((row - 1) / {step}) AS BIGINT) AS nr, CAST(floor((col - 1) / {step}) AS BIGINT) AS nc FROM im, qq),
o(i, j) AS (VALUES {near}), seeds0 AS (SELECT nr AS hr, nc AS hc, avg(row) AS sr, avg(col) AS sc, avg(v) AS sv FROM d GROUP BY ALL)"""
    for k in range(rounds):
        out += f""",
own{k} AS (SELECT row, col, any_value(v) AS v, arg_min({{'hr': hr, 'hc': hc}}, (((v - sv) / {weight}) ** 2 + ((row - sr) ** 2 + (col - sc) ** 2) / ({step} * {step}), hr, hc)) AS s
  FROM d JOIN (SELECT s.*, hr + i AS nr, hc + j AS nc FROM seeds{k} s, o) USING (nr, nc) GROUP BY row, col),
seeds{k + 1} AS (SELECT s.hr AS hr, s.hc AS hc, avg(row) AS sr, avg(col) AS sc, avg(v) AS sv FROM own{k} GROUP BY ALL)"""
    return f"WITH {out} SELECT row, col, s.hr * CAST(ceil(ncols / {step}) AS BIGINT) + s.hc + 1 AS superpixel FROM own{rounds - 1}, g"


@query(_superpixel_sql(3.5449077018110318, 0.5, 5))
def g13_superpixels(spark, d) -> DataFrame:
    p = pts(spark, d)
    ref = grid.grid_over(p, 5.0)
    return segmentation.superpixels(grid.rasterize(p, ref, "intensity", "mean"), ref, radius=10.0)


@query(f"""WITH RECURSIVE {ref_sql(2.0)}, mask AS (SELECT row, col FROM c WHERE classification = 5 GROUP BY row, col HAVING count(z) >= 3),
o(i, j) AS (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)), need AS (SELECT mask.row, mask.col, count(*) AS n FROM mask, o, g WHERE mask.row + i BETWEEN 1 AND nrows AND mask.col + j BETWEEN 1 AND ncols GROUP BY ALL),
have AS (SELECT mask.row, mask.col, count(*) AS n FROM mask, o JOIN mask b ON b.row = mask.row + o.i AND b.col = mask.col + o.j GROUP BY ALL),
rec AS (SELECT row, col FROM need JOIN have USING (row, col, n)
  UNION SELECT b.row, b.col FROM rec JOIN mask b ON b.row BETWEEN rec.row - 1 AND rec.row + 1 AND b.col BETWEEN rec.col - 1 AND rec.col + 1)
SELECT row, col FROM rec""")
def g15_open_by_reconstruction(spark, d) -> DataFrame:
    p = pts(spark, d)
    ref = grid.grid_over(p, 2.0)
    high = grid.rasterize(p.where(predicates.of_class([5])), ref, "z", "count").where("value >= 3")
    return components.open_by_reconstruction(high, ref, 1.0)


# ---- colours -----------------------------------------------------------------------------------

#: CTE col (label, color): in order of rank, one label a step, the least colour that no neighbour before it has.
_GREEDY = f"""{_ADJ}, nb AS (SELECT a AS l, b AS o FROM e UNION ALL SELECT b, a FROM e), ks AS (SELECT DISTINCT label FROM points WHERE label <> 0),
dg AS (SELECT label, count(l) AS degree FROM ks LEFT JOIN nb ON label = l GROUP BY label),
rk AS (SELECT label, CAST(row_number() OVER (ORDER BY degree DESC, label) AS BIGINT) AS rank FROM dg),
bf AS (SELECT x.rank, list(y.rank) AS before FROM nb JOIN rk x ON x.label = nb.l JOIN rk y ON y.label = nb.o WHERE y.rank < x.rank GROUP BY x.rank),
st AS (SELECT 0::BIGINT AS rank, []::INT[] AS colors
  UNION ALL
  SELECT rank + 1, list_append(colors, CAST(list_min(list_filter(range(1, len(used) + 2), lambda q: NOT list_contains(used, CAST(q AS INT)))) AS INT)) FROM (
    SELECT st.rank, colors, list_transform(coalesce(bf.before, []::BIGINT[]), lambda q: colors[q]) AS used FROM st LEFT JOIN bf ON bf.rank = st.rank + 1 WHERE st.rank < (SELECT count(*) FROM rk))),
lst AS (SELECT colors FROM st ORDER BY rank DESC LIMIT 1), col AS (SELECT label, colors[rank] AS color FROM rk, lst)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT label, color FROM col")
def c2_greedy_coloring(spark, d) -> DataFrame:
    p = pts(spark, d)
    e = materialise(coloring.adjacency(p), "edges")
    return coloring.greedy(e, coloring.degree_order(e, p))


_SHADES = ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for k, (a, b, c) in enumerate([(0.0, 0.0, 0.0), *coloring.palette(12)]))


@query(f"""WITH RECURSIVE {_GREEDY}, sh(k, r, g, b) AS (VALUES {_SHADES}), w AS (SELECT label, CASE WHEN color > 12 THEN color % 12 + 1 ELSE color END AS color FROM col)
SELECT pid, coalesce(w.color, 0) AS color, r, g, b FROM points p LEFT JOIN w ON w.label = p.label JOIN sh ON sh.k = coalesce(w.color, 0)""")
def c3_topo_color(spark, d) -> DataFrame:
    return coloring.topo_color(pts(spark, d)).select("pid", "color", "r", "g", "b")


# ---- metrics on a terrain model ----------------------------------------------------------------


@query(f"""WITH {_nearest_sql(10.0, _TERRAIN)}, s AS (SELECT label, max(z) AS top, arg_max(x, (z, -pid)) AS xa, arg_max(y, (z, -pid)) AS ya FROM points WHERE label <> 0 AND {_XYZ} GROUP BY label),
a AS (SELECT s.*, CAST(round((ya - y0) / -10.0) AS INT) AS row, CAST(round((xa - x0) / 10.0) AS INT) AS col FROM s, g)
SELECT label, xa AS XPos, ya AS YPos, ROUND(v, 4) AS ZPos, ROUND(top - v, 4) AS H FROM a JOIN f USING (row, col)""")
def j2_segments_on_terrain(spark, d) -> DataFrame:
    p = pts(spark, d)
    ref = grid.grid_over(p, 10.0)
    dtm = materialise(models.terrain_model(p, ref, method="nearest"), "dtm")
    m = segments.segment_metrics(p, ["XPos", "YPos", "ZPos", "H"], dtm=dtm, ref=ref)
    return m.select("label", "XPos", "YPos", r("ZPos", 4, "ZPos"), r("H", 4, "H"))
