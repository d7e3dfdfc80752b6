"""Points that arrive tile by tile: associative operators over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laserloom.functions.gpstime import adjusted_to_utc
from laserloom.operators.grid import GridRef, with_cell


def read_points(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_raster(points: DataFrame, ref: GridRef, value: str = "z") -> DataFrame:
    """Running count, sum, least and greatest value of each cell; for update or complete mode. The state is one row per
    cell of the grid, however long the stream."""
    v = F.col(value)
    return with_cell(points, ref).groupBy("row", "col").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def stream_rates(points: DataFrame, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Returns per flight line and window of event time, final once the watermark has passed; for append mode."""
    d = points.where("gps_time is not null and point_source_id is not null").withColumn("at", adjusted_to_utc(F.col("gps_time"))).withWatermark("at", late)
    return d.groupBy(F.window("at", window).alias("w"), "point_source_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "point_source_id", "n")


def stream_distinct(points: DataFrame, late: str = "1 minute") -> DataFrame:
    """Points without repeats of a pid that come within the watermark of each other."""
    return points.withColumn("at", adjusted_to_utc(F.col("gps_time"))).withWatermark("at", late).dropDuplicatesWithinWatermark(["pid"])
