"""Queries of the core: name -> (spark, folder) -> DataFrame, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laserloom.operators.spatial import tree_neighbourhoods
from laserloom.operators.spikes import implausible_readings
from laserloom.operators.timestamps import flight_log_instants
from laserloom.plans import fileio, pointcloud, shapes, surfaces  # noqa: F401 (all add to pointcloud.QUERIES)
from laserloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return flight_log_instants(table(spark, d, "flight_log"), table(spark, d, "recorders"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_neighbourhoods(table(spark, d, "points"), table(spark, d, "tree_metrics"), table(spark, d, "stands"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "points"), table(spark, d, "sbet"))


QUERIES: dict[str, Query] = {**pointcloud.QUERIES, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found}
ORACLES: dict[str, str] = dict(pointcloud.ORACLES)

ORACLES["p5_found"] = """
WITH t AS (SELECT DISTINCT label, xpos, ypos FROM tree_metrics WHERE xpos IS NOT NULL AND ypos IS NOT NULL AND label IS NOT NULL),
p AS (SELECT DISTINCT pid, x, y FROM points WHERE x IS NOT NULL AND y IS NOT NULL),
v AS (SELECT stand_id, unnest(x) AS vx, unnest(y) AS vy, generate_subscripts(x, 1) AS pos FROM stands),
g AS (SELECT *, sum(CASE WHEN isnan(vx) OR isnan(vy) THEN 1 ELSE 0 END) OVER (PARTITION BY stand_id ORDER BY pos) AS ring FROM v),
k AS (SELECT * FROM g WHERE NOT (isnan(vx) OR isnan(vy))),
e AS (SELECT stand_id, vx AS x1, vy AS y1,
        coalesce(lead(vx) OVER w, first_value(vx) OVER w) AS x2, coalesce(lead(vy) OVER w, first_value(vy) OVER w) AS y2
      FROM k WINDOW w AS (PARTITION BY stand_id, ring ORDER BY pos)),
s AS (SELECT stand_id, label,
        max(CASE WHEN (xpos - x1) * (x2 - x1) + (ypos - y1) * (y2 - y1) BETWEEN 0 AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
                  AND abs((xpos - x1) * (y2 - y1) - (ypos - y1) * (x2 - x1)) <= 1e-6 * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) THEN 1 ELSE 0 END) AS on_edge,
        sum(CASE WHEN (y1 > ypos) <> (y2 > ypos) AND xpos - x1 < (x2 - x1) * (ypos - y1) / (y2 - y1) THEN 1 ELSE 0 END) AS n
      FROM e JOIN t ON ypos BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY stand_id, label)
SELECT 'tree_tree' AS rel, a.label AS a, b.label AS b FROM t a JOIN t b
  ON a.label < b.label AND b.xpos BETWEEN a.xpos - 2 AND a.xpos + 2
  AND (a.xpos - b.xpos) * (a.xpos - b.xpos) + (a.ypos - b.ypos) * (a.ypos - b.ypos) <= 1.505 * 1.505
UNION ALL
SELECT 'tree_point', t.label, p.pid FROM t JOIN p
  ON p.x BETWEEN t.xpos - 1 AND t.xpos + 1
  AND (t.xpos - p.x) * (t.xpos - p.x) + (t.ypos - p.y) * (t.ypos - p.y) <= 0.505 * 0.505
UNION ALL
SELECT 'stand_tree', stand_id, label FROM s WHERE on_edge = 1 OR n % 2 = 1
"""
