"""Queries that write tables in the file formats and read them back: whole round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laserloom.operators import grid, segments, tiles
from laserloom.plans.pointcloud import dense_sql, query, ref_sql
from laserloom.session import own_dir, table
from laserloom.sources import ascgrid, binary, dbf, register, shapefile


def place(spark: SparkSession, name: str) -> str:
    register(spark)
    return f"{own_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query(f"WITH {ref_sql(10.0)}, {dense_sql()}, v AS (SELECT row, col, max(z) AS value FROM c GROUP BY row, col) SELECT dom.row, dom.col, round(value, 2) AS value FROM dom LEFT JOIN v ON dom.row = v.row AND dom.col = v.col")
def s1_s2_asc_grid(spark, d) -> DataFrame:
    p = table(spark, d, "points")
    ref = grid.grid_over(p, 10.0)
    path = ascgrid.write_asc(grid.rasterize(p, ref), ref, place(spark, "grid.asc"), nodata=-99999)
    return spark.read.format("ascgrid").load(path).select("row", "col", "value")


@query("SELECT DISTINCT label, CAST(npoints AS DOUBLE) AS npoints, uuid, CAST(computed_at AS DATE)::VARCHAR AS day, round(h, 2) AS h, h > 10 AS tall FROM tree_metrics")
def s3_s4_dbf(spark, d) -> DataFrame:
    t = table(spark, d, "tree_metrics").select("label", "npoints", "uuid", F.to_date("computed_at").alias("day"), F.round("h", 2).alias("h"), (F.col("h") > 10).alias("tall")).distinct()
    path = place(spark, "trees.dbf")
    dbf.write_dbf(t, path)
    got = dbf.read_dbf(spark, path)
    return got.select(F.col("label").cast("long").alias("label"), "npoints", "uuid", F.col("day").cast("string").alias("day"), F.round("h", 2).alias("h"), "tall")


@query("SELECT label, h FROM tree_metrics WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY h) = 1")
def s3_dbf_columns(spark, d) -> DataFrame:
    t = table(spark, d, "tree_metrics").where("label is not null").groupBy("label").agg(F.min("h").alias("h"))
    path = place(spark, "trees.dbf")
    dbf.write_dbf(t, path)
    return dbf.read_dbf(spark, path, columns=["label", 2]).select(F.col("label").cast("long").alias("label"), "h")


@query("SELECT stand_id, nullif(trim(attr_species), '') AS species, CAST(len([v FOR v IN x IF NOT isnan(v)]) AS INT) AS vertices, CAST(len([v FOR v IN x IF isnan(v)]) + 1 AS INT) AS parts, list_min([v FOR v IN x IF NOT isnan(v)]) AS xmin, list_max([v FOR v IN y IF NOT isnan(v)]) AS ymax FROM stands")
def s5_s6_shapefile(spark, d) -> DataFrame:
    path = place(spark, "stands.shp")
    shapefile.write_shapefile(shapefile.from_stands(table(spark, d, "stands").select("stand_id", "x", "y", "geometry", "attr_species")), path, "Polygon")
    got = shapefile.read_shapefile(spark, path)
    return got.select(F.col("stand_id").cast("long").alias("stand_id"), F.col("attr_speci").alias("species"), F.size(F.flatten("parts")).alias("vertices"), F.size("parts").alias("parts"), F.col("bbox.xmin").alias("xmin"), F.col("bbox.ymax").alias("ymax"))


@query("SELECT label, xpos AS lon, ypos AS lat FROM tree_metrics WHERE label IS NOT NULL AND xpos BETWEEN 2600000 AND 2600100 AND ypos BETWEEN 1150000 AND 1150060 GROUP BY ALL")
def s5_shapefile_in_box(spark, d) -> DataFrame:
    t = table(spark, d, "tree_metrics").select("label", "xpos", "ypos").distinct().dropna()
    path = place(spark, "trees.shp")
    shapefile.write_shapefile(t.select("label", F.array(F.array(F.struct(F.col("xpos").alias("x"), F.col("ypos").alias("y")))).alias("parts")), path, "Point")
    got = shapefile.read_shapefile(spark, path, box=(2600000, 1150000, 2600100, 1150060), geo=True)
    v = F.col("parts")[0][0]
    return got.select(F.col("label").cast("long").alias("label"), v["lon"].alias("lon"), v["lat"].alias("lat"))


@query(f"SELECT {', '.join(binary.SBET_FIELDS)} FROM sbet WHERE {' AND '.join(f'{c} IS NOT NULL' for c in binary.SBET_FIELDS)}")
def s7_sbet(spark, d) -> DataFrame:
    s = table(spark, d, "sbet").select(*binary.SBET_FIELDS).dropna()
    path = place(spark, "line.sbet")
    s.write.format("sbet").mode("append").save(path)
    return spark.read.format("sbet").load(path).drop("file")


_LAS = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND gps_time IS NOT NULL AND point_source_id IS NOT NULL AND red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL AND intensity BETWEEN 0 AND 65535"


@query(f"SELECT round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, intensity, return_number, number_of_returns, classification, gps_time, point_source_id, red, green, blue FROM points WHERE {_LAS}")
def s10_s11_las(spark, d) -> DataFrame:
    p = table(spark, d, "points").where(_LAS)
    path = place(spark, "cloud.las")
    binary.write_las(p, path, pointFormat=7, scale=0.01, systemId="MERGE")
    got = spark.read.format("las").load(path)
    return got.select(*[F.round(k, 2).alias(k) for k in "xyz"], "intensity", "return_number", "number_of_returns", "classification", "gps_time", "point_source_id", "red", "green", "blue")


@query(f"SELECT 3 AS format, count(*) AS n, min(x) AS xmin, max(y) AS ymax, min(z) AS zmin FROM points WHERE {_LAS}")
def e1_las_headers(spark, d) -> DataFrame:
    """Bounds and count from the header alone."""
    path = place(spark, "cloud.las")
    binary.write_las(table(spark, d, "points").where(_LAS), path, scale=0.01)
    h = binary.las_headers(spark, path)
    return h.select(F.col("point_data_format_id").alias("format"), "n", F.round("min_x", 2).alias("xmin"), F.round("max_y", 2).alias("ymax"), F.round("min_z", 2).alias("zmin"))


@query("SELECT file, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points GROUP BY file")
def e6_extents_to_shapefile(spark, d) -> DataFrame:
    e = tiles.bbox_extents(table(spark, d, "points")).dropna()
    v = F.transform(F.arrays_zip("ring_x", "ring_y"), lambda q: F.struct(q["ring_x"].alias("x"), q["ring_y"].alias("y")))
    path = place(spark, "extents.shp")
    shapefile.write_shapefile(e.select(F.col("file").alias("tile"), F.array(v).alias("parts")), path, "Polygon")
    got = shapefile.read_shapefile(spark, path)
    return got.select(F.col("tile").alias("file"), "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax")


@query("SELECT label, printf('%d', count(*)) AS NPoints FROM points WHERE label <> 0 AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY label")
def s12_csv_export(spark, d) -> DataFrame:
    path = place(spark, "metrics.csv")
    segments.formatted(segments.segment_metrics(table(spark, d, "points"), ["NPoints", "XPos"])).write.option("header", True).csv(path)
    return spark.read.schema("label long, NPoints string, XPos string").option("header", True).csv(path).select("label", "NPoints")


