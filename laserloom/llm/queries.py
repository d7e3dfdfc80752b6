"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laserloom.functions.gpstime import LEAP_DATES
from laserloom.llm.bpe import encode_texts
from laserloom.llm.nearest_time import returns_with_trajectory
from laserloom.llm.packing import pack_documents
from laserloom.llm.percentiles import QUANTILES, cell_percentiles, point_percentiles
from laserloom.llm.reading import unlabelled_levels
from laserloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return returns_with_trajectory(table(spark, d, "points"), table(spark, d, "sbet"))


def _rounded(df: DataFrame) -> DataFrame:
    """Percentiles to 6 decimals, as two systems' powers differ in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in QUANTILES})


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(point_percentiles(table(spark, d, "points")))


def p3_by_cell(spark: SparkSession, d: str) -> DataFrame:
    got = _rounded(cell_percentiles(table(spark, d, "points")))
    # as texts: some of these keys are null
    return got.withColumns({k: got[k].cast("string") for k in ("point_source_id", "label", "day")})


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "text", keep=["doc_id"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return unlabelled_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p3_percentiles": p3_percentiles, "p3_by_cell": p3_by_cell, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found}
ORACLES: dict[str, str] = {}

ORACLES["p1_found"] = """
WITH p AS (SELECT DISTINCT pid, point_source_id AS line, CAST(round(gps_time * 1000000) AS BIGINT) AS t FROM points
           WHERE gps_time IS NOT NULL AND point_source_id IS NOT NULL),
s AS (SELECT DISTINCT rec_id, point_source_id AS line, CAST(round(gps_time * 1000000) AS BIGINT) AS t FROM sbet
      WHERE gps_time IS NOT NULL AND point_source_id IS NOT NULL AND altitude IS NOT NULL),
c AS (SELECT p.pid, p.t, s.rec_id, s.t AS st FROM p ASOF JOIN s ON p.line = s.line AND p.t >= s.t
      UNION ALL
      SELECT p.pid, p.t, s.rec_id, s.t AS st FROM p ASOF JOIN s ON p.line = s.line AND p.t <= s.t)
SELECT pid, rec_id FROM (
  SELECT pid, rec_id, row_number() OVER (PARTITION BY pid ORDER BY abs(t - st), st, rec_id) AS k FROM c WHERE abs(t - st) <= 40000
) WHERE k = 1
"""

_G = "ln(1.01 / 0.99)"
_LEAP = "CASE {} ELSE 0 END".format(" ".join(f"WHEN t >= epoch(TIMESTAMP '{day} 00:00:00') - 315964800 + {n} THEN {n}" for day, n in reversed(LEAP_DATES[1:])))


def _percentiles_sql(keys: str, source: str) -> str:
    """Percentiles by exact rank among all values; each is shown as the middle of its bucket, and only if that lies within
    1 % of it."""
    middle = lambda c: f"CASE WHEN {c} = 0 THEN 0.0 ELSE sign({c}) * (2.0 / (1.01 / 0.99 + 1)) * pow(1.01 / 0.99, ceil(ln(abs({c})) / {_G})) END"
    shown = ", ".join(f"round(CASE WHEN abs({middle(c)} - {c}) <= 0.01 * abs({c}) + 1e-12 * abs({c}) THEN {middle(c)} END, 6) AS {c}" for c in QUANTILES)
    return f"""
WITH d AS (SELECT DISTINCT pid, point_source_id, label, file, gps_time, intensity, z FROM points),
t AS (SELECT *, gps_time + 1e9 AS t FROM d),
k AS (SELECT *, CAST(floor((t + 315964800 - {_LEAP}) / 86400) AS INT) AS day FROM t),
f AS (SELECT point_source_id, label, file, day, 'intensity' AS field, intensity AS v FROM k
      UNION ALL SELECT point_source_id, label, file, day, 'z', z FROM k),
b AS (SELECT * FROM f WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)),
g AS ({source}),
r AS (SELECT {keys}, field, v, row_number() OVER (PARTITION BY {keys}, field ORDER BY v) AS k,
        count(*) OVER (PARTITION BY {keys}, field) AS n FROM g),
q AS (SELECT {keys}, field, max(n) AS n,
        {", ".join(f"min(CASE WHEN k >= greatest(1, ceil(n * {q} - 1e-9)) THEN v END) AS {c}" for c, q in QUANTILES.items())}
      FROM r GROUP BY {keys}, field)
SELECT {keys}, field, n, {shown} FROM q
"""


ORACLES["p3_percentiles"] = _percentiles_sql(
    "dim, key",
    """SELECT 'point_source_id' AS dim, CAST(point_source_id AS VARCHAR) AS key, field, v FROM b
      UNION ALL SELECT 'label', CAST(label AS VARCHAR), field, v FROM b
      UNION ALL SELECT 'file', file, field, v FROM b
      UNION ALL SELECT 'day', CAST(day AS VARCHAR), field, v FROM b""",
)
ORACLES["p3_by_cell"] = _percentiles_sql(
    "point_source_id, label, file, day",
    "SELECT CAST(point_source_id AS VARCHAR) AS point_source_id, CAST(label AS VARCHAR) AS label, file, CAST(day AS VARCHAR) AS day, field, v FROM b",
)
