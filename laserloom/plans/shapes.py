"""Queries of medoids, hulls and principal axes over the whole tables, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laserloom.operators import hulls, predicates, segments, voxel
from laserloom.plans.pointcloud import _SEG, _XYZ, pts, query, r

# ---- thinning and medoids ----------------------------------------------------------------------


def _voxels(size: float) -> str:
    return ", ".join(f"CAST(round({k} / {size}) AS BIGINT) AS v_{k}" for k in "xyz")


@query(f"SELECT DISTINCT {_voxels(0.5)}, 1::BIGINT AS picked, 1::BIGINT AS real FROM points WHERE {_XYZ}")
def a8_subsample_random(spark, d) -> DataFrame:
    """One row for each voxel that was picked from: how many were, and how many of these are points of the table."""
    p = pts(spark, d)
    got = voxel.with_voxel(voxel.subsample_random(p, 0.5), 0.5)
    whole = p.select("pid", "x", "y", "z").distinct().withColumn("is", F.lit(1))
    j = got.join(whole, ["pid", "x", "y", "z"], "left")
    return j.groupBy("v_x", "v_y", "v_z").agg(F.count("*").alias("picked"), F.count("is").alias("real"))


def _medoid_sql(keys: str, source: str) -> str:
    """Medoids by the sums of squares to all others of the group; of equals the first row id."""
    each = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""WITH p AS ({source}), n AS (SELECT {keys}, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT {each}, a.pid, sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS ssd FROM p a JOIN p b USING ({keys}) GROUP BY ALL),
m AS (SELECT {keys}, min(ssd) AS least FROM s GROUP BY {keys})
SELECT {keys}, min(CASE WHEN (ssd - least) / n <= 1e-7 THEN pid END) AS pid, ROUND(1e-6 + CASE WHEN any_value(n) > 1 THEN any_value(least) END / any_value(n), 2) AS mean_square FROM s JOIN n USING ({keys}) JOIN m USING ({keys}) GROUP BY {keys}"""


@query(_medoid_sql("v_x, v_y, v_z", f"SELECT DISTINCT pid, x, y, z, {_voxels(2.0)} FROM points WHERE {_XYZ}"))
def a9_subsample_medoid(spark, d) -> DataFrame:
    p = pts(spark, d).select("pid", "x", "y", "z").distinct()
    m = voxel.subsample_medoid(p, 2.0)
    return m.select("v_x", "v_y", "v_z", "pid", r(F.col("ssd") / F.col("n") + 1e-6, 2, "mean_square"))


@query(_medoid_sql("label", f"SELECT DISTINCT pid, label, x, y, z FROM points WHERE label <> 0 AND {_XYZ}"))
def a10_medoid(spark, d) -> DataFrame:
    p = pts(spark, d).where(predicates.labelled()).select("pid", "label", "x", "y", "z").distinct()
    return voxel.medoid(p, ["label"], ["x", "y", "z"], "pid").select("label", "pid", r(F.col("ssd") / F.col("n") + 1e-6, 2, "mean_square"))


# ---- convex hulls ------------------------------------------------------------------------------


def wrap_sql(group: str, where: str) -> str:
    """CTEs w (g, x, y, k: corners of each group's hull in order, the first one again at the end; whole centimetres) and a (g, area,
    corners): from the first corner on, always to the point that leaves all others to the left."""
    return f"""hp AS (SELECT DISTINCT {group} AS g, CAST(round(x * 100) AS BIGINT) AS x, CAST(round(y * 100) AS BIGINT) AS y FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND {where}),
hs AS (SELECT g, min(x) AS x0, arg_min(y, (x, y)) AS y0 FROM hp GROUP BY g HAVING count(*) > 2),
w AS (SELECT g, x0 AS x, y0 AS y, 0::BIGINT AS dx, -1::BIGINT AS dy, x0, y0, 0 AS k FROM hs
  UNION ALL
  SELECT g, n.x, n.y, n.x - x, n.y - y, x0, y0, k + 1 FROM (
    SELECT w.g, w.x, w.y, w.x0, w.y0, w.k, arg_min({{'x': hp.x, 'y': hp.y}}, (atan2((w.dx * (hp.y - w.y) - w.dy * (hp.x - w.x))::DOUBLE, (w.dx * (hp.x - w.x) + w.dy * (hp.y - w.y))::DOUBLE), -((hp.x - w.x) * (hp.x - w.x) + (hp.y - w.y) * (hp.y - w.y)))) AS n
    FROM w JOIN hp ON hp.g = w.g AND (hp.x <> w.x OR hp.y <> w.y) WHERE w.k = 0 OR w.x <> w.x0 OR w.y <> w.y0 GROUP BY ALL)),
a AS (SELECT g, abs(sum(lx * ny - ly * nx)) / 2e4 AS area, count(*) - 1 AS corners FROM (
    SELECT g, x - x0 AS lx, y - y0 AS ly, lead(x - x0, 1, 0) OVER (PARTITION BY g ORDER BY k) AS nx, lead(y - y0, 1, 0) OVER (PARTITION BY g ORDER BY k) AS ny FROM w) GROUP BY g)"""


@query(f"WITH RECURSIVE {wrap_sql('file', 'true')} SELECT g AS file, x / 100.0::DOUBLE AS x, y / 100.0::DOUBLE AS y, ROUND(area + 1e-6, 4) AS area, corners FROM w JOIN a USING (g) WHERE k > 0")
def e3_convex_extents(spark, d) -> DataFrame:
    """One row for each corner of each file's outline."""
    e = hulls.convex_extents(pts(spark, d)).where("ring_x is not null")
    c = F.slice(F.arrays_zip("ring_x", "ring_y"), 2, F.size("ring_x") - 1)
    e = e.select("file", r(F.col("area") + 1e-6, 4, "area"), (F.size("ring_x") - 1).cast("long").alias("corners"), F.explode(c).alias("c"))
    return e.select("file", F.col("c.ring_x").alias("x"), F.col("c.ring_y").alias("y"), "area", "corners")


@query(f"""WITH RECURSIVE {wrap_sql("label", f"label <> 0 AND {_XYZ}")}, t AS (SELECT label AS g, max(z) - min(z) AS h FROM points WHERE label <> 0 AND {_XYZ} GROUP BY label)
SELECT g AS label, ROUND(area, 5) AS CVH2DArea, ROUND(2 * sqrt(area / pi()), 5) AS CD, ROUND(2 * sqrt(area / pi()) / h, 5) AS AspRatio FROM a JOIN t USING (g) WHERE h > 0 AND area > 0""")
def m_hull_metrics(spark, d) -> DataFrame:
    names = ["CVH2DArea", "CD", "AspRatio"]  # the last needs the first, and the height
    return segments.segment_metrics(pts(spark, d), names).select("label", *[r(n, 5, n) for n in names])


@query(f"""WITH RECURSIVE {wrap_sql("label", f"label <> 0 AND {_XYZ}")} SELECT g AS label, x / 100.0::DOUBLE AS x, y / 100.0::DOUBLE AS y FROM w JOIN a USING (g) WHERE k > 0 AND area > 0""")
def m_hull_rings(spark, d) -> DataFrame:
    """One row for each corner of each segment's outline: XCVH2D and YCVH2D, which agree with CVH2D."""
    m = segments.segment_metrics(pts(spark, d), ["CVH2D", "XCVH2D", "YCVH2D"]).where("CVH2D is not null")
    m = m.select("label", F.explode(F.slice(F.arrays_zip("CVH2D", "XCVH2D", "YCVH2D"), 2, F.size("CVH2D") - 1)).alias("c"))
    return m.where("c.CVH2D[0] = c.XCVH2D and c.CVH2D[1] = c.YCVH2D").select("label", F.col("c.XCVH2D").alias("x"), F.col("c.YCVH2D").alias("y"))


# ---- principal axes ----------------------------------------------------------------------------

_COV = {"xx": "covar_samp(x - mx, x - mx)", "xy": "covar_samp(x - mx, y - my)", "xz": "covar_samp(x - mx, z - mz)", "yy": "covar_samp(y - my, y - my)", "yz": "covar_samp(y - my, z - mz)", "zz": "covar_samp(z - mz, z - mz)"}
#: CTEs ev (label, mean, covariances, l1 >= l2 >= l3): the eigenvalues of a symmetric 3 x 3 matrix in closed form. The one
#: that lies apart comes from the angle, the other two from their sum and product.
_EIGEN = f"""{_SEG}, mu AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s GROUP BY label),
cv AS (SELECT label, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, {", ".join(f"{v} AS {k}" for k, v in _COV.items())} FROM s JOIN mu USING (label) GROUP BY label),
e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv),
e2 AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
e3 AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / nullif(2 * p * p * p, 0)))) / 3 AS phi FROM e2),
e4 AS (SELECT *, CASE WHEN phi < pi() / 6 THEN q + 2 * p * cos(phi) ELSE q + 2 * p * cos(phi + 2 * pi() / 3) END AS l0, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM e3),
e5 AS (SELECT *, (xx + yy + zz - l0) / 2 AS half, CASE WHEN phi < pi() / 6 THEN det / nullif(l0, 0) ELSE yy * zz - yz * yz + xx * zz - xz * xz + xx * yy - xy * xy - l0 * (xx + yy + zz - l0) END AS prod FROM e4),
e6 AS (SELECT *, sqrt(greatest(half * half - prod, 0)) AS off FROM e5),
ev AS (SELECT *, CASE WHEN phi < pi() / 6 THEN l0 ELSE half + off END AS l1, CASE WHEN phi < pi() / 6 THEN half + off ELSE half - off END AS l2, CASE WHEN phi < pi() / 6 THEN half - off ELSE l0 END AS l3 FROM e6)"""


@query(f"WITH {_EIGEN} SELECT label, n AS NPoints, ROUND(CASE WHEN n > 3 THEN greatest(l1, 0) ELSE 0 END, 3) AS PCVar1, ROUND(CASE WHEN n > 3 THEN greatest(l2, 0) ELSE 0 END, 3) AS PCVar2, ROUND(CASE WHEN n > 3 THEN greatest(l3, 0) ELSE 0 END, 3) AS PCVar3 FROM ev")
def m_principal_variances(spark, d) -> DataFrame:
    names = ["PCVar1", "PCVar2", "PCVar3"]
    return segments.segment_metrics(pts(spark, d), ["NPoints", *names]).select("label", "NPoints", *[r(n, 3, n) for n in names])


def _axis(lam: str, name: str) -> str:
    """Columns of the unit eigenvector of lam: the longest of the cross products of the rows of A - lam I."""
    rows = [(f"(xx - {lam})", "xy", "xz"), ("xy", f"(yy - {lam})", "yz"), ("xz", "yz", f"(zz - {lam})")]
    cross = [[f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"] for a, b in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
    size = [f"({' + '.join(f'{v} ** 2' for v in c)})" for c in cross]
    best = f"greatest({', '.join(size)})"
    pick = lambda i: f"CASE {best} WHEN {size[0]} THEN {cross[0][i]} WHEN {size[1]} THEN {cross[1][i]} ELSE {cross[2][i]} END / sqrt({best})"
    return ", ".join(f"{pick(i)} AS {name}{i}" for i in range(3))


@query(f"""WITH {_EIGEN}, ax AS (SELECT label, mx, my, mz, {_axis("l1", "u")}, {_axis("l3", "w")} FROM ev WHERE n > 3),
sc AS (SELECT label, pid, (x - mx) * u0 + (y - my) * u1 + (z - mz) * u2 AS u, (x - mx) * w0 + (y - my) * w1 + (z - mz) * w2 AS w,
  (x - mx) * (u1 * w2 - u2 * w1) + (y - my) * (u2 * w0 - u0 * w2) + (z - mz) * (u0 * w1 - u1 * w0) AS v FROM s JOIN ax USING (label))
SELECT label, pid, ROUND(abs(u), 2) AS u, ROUND(abs(v), 2) AS v, ROUND(abs(w), 2) AS w FROM sc""")
def m_principal_scores(spark, d) -> DataFrame:
    """Size of each point's score on each axis (signs are free), points in order of pid."""
    m = segments.segment_metrics(pts(spark, d), ["XYZ", "UVW"]).where("UVW is not null")
    e = m.select("label", F.explode(F.arrays_zip("XYZ", "UVW")).alias("e"))
    return e.select("label", F.col("e.XYZ.pid").alias("pid"), *[r(F.abs(F.col("e.UVW")[k]), 2, n) for k, n in enumerate("uvw")])


# ---- lists by segment --------------------------------------------------------------------------


@query(f"""WITH {_SEG}, a AS (SELECT label, arg_max(x, (z, -pid)) AS xa, arg_max(y, (z, -pid)) AS ya, min(z) AS z0 FROM s GROUP BY label)
SELECT label, pid, ROUND(x - xa, 6) AS x, ROUND(y - ya, 6) AS y, ROUND(z - z0, 6) AS h FROM s JOIN a USING (label)""")
def m_relative_positions(spark, d) -> DataFrame:
    m = segments.segment_metrics(pts(spark, d), ["XYH"])
    return m.select("label", F.explode("XYH").alias("p")).select("label", "p.pid", *[r(f"p.{k}", 6, k) for k in "xyh"])


@query(f"""WITH {_SEG}, q AS (SELECT *, ROUND(return_number / nullif(number_of_returns, 0), 6) AS opacity, red / nullif(red + green + blue, 0) AS cr, green / nullif(red + green + blue, 0) AS cg, blue / nullif(red + green + blue, 0) AS cb FROM s)
SELECT label, pid, opacity, red, green, blue, ROUND(cr, 6) AS cr, ROUND(cg, 6) AS cg, ROUND(cb, 6) AS cb FROM q""")
def m_point_lists(spark, d) -> DataFrame:
    """Opacity, colours and chromaticities, one row for each point of the lists; all lists run in order of pid."""
    m = segments.segment_metrics(pts(spark, d), ["XYZ", "Opacity", "RGB", "Chroma"])
    e = m.select("label", F.explode(F.arrays_zip("XYZ", "Opacity", "RGB", "Chroma")).alias("e"))
    e = e.where("e.XYZ.pid = e.RGB.pid and e.XYZ.pid = e.Chroma.pid")
    as_double = [F.col(f"e.RGB.{k}").cast("double").alias(k) for k in ("red", "green", "blue")]
    return e.select("label", "e.XYZ.pid", r("e.Opacity", 6, "opacity"), *as_double, *[r(f"e.Chroma.{k}", 6, f"c{k}") for k in "rgb"])


@query(f"WITH {_SEG} SELECT label, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, 32::BIGINT AS digits, true AS inside FROM s GROUP BY label")
def m_boxes_and_ids(spark, d) -> DataFrame:
    """BBOX2D, the length of UUID (hexadecimal digits only) and whether Random lies in 0 to 1."""
    m = segments.segment_metrics(pts(spark, d), ["UUID", "Random", "BBOX2D"])
    return m.select("label", "BBOX2D.*", F.length(F.regexp_extract("UUID", "^[0-9a-f]*$", 0)).cast("long").alias("digits"), F.col("Random").between(0, 1).alias("inside"))


@query(f"WITH {_SEG} SELECT count(DISTINCT label) AS rows, count(DISTINCT label) AS ids FROM s")
def m_unique_ids(spark, d) -> DataFrame:
    m = segments.segment_metrics(pts(spark, d), ["UUID"])
    return m.agg(F.count("*").alias("rows"), F.count_distinct("UUID").alias("ids"))
