"""Returns in order of time numbered by laser pulse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laserloom.functions.gpstime import week_time


def number_pulses(points: DataFrame, *, by: str = "point_source_id", time: str = "gps_time", row_id: str = "pid", bucket: float = 10.0) -> DataFrame:
    """points with pulse_number, counted from 1 within each source in order of time and row id: a new pulse begins where return_number
    is not above that of the return before.

    Works by time buckets: a first pass numbers within each (source, bucket); the previous return of a
    bucket's first row is the last of the bucket before, found from one row per bucket; bucket offsets
    are running sums over these rows. So a source with a third of all returns spreads over its buckets.
    Rows without a source, time or return_number are left out."""
    d = points.where(f"{by} is not null and {time} is not null and not isnan({time}) and return_number is not null")
    d = d.withColumn("__b", F.floor(F.col(time) / F.lit(bucket)))
    w = Window.partitionBy(by, "__b").orderBy(time, row_id)
    prev = F.lag("return_number").over(w)
    inner = d.withColumn("__new", F.when(prev.isNull(), F.lit(0)).when(F.col("return_number") <= prev, F.lit(1)).otherwise(F.lit(0)))
    inner = inner.withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(F.col(time), F.col(row_id))
    edge = d.groupBy(by, "__b").agg(F.min_by("return_number", order).alias("first"), F.max_by("return_number", order).alias("last"))
    news = inner.groupBy(by, "__b").agg(F.max("__k").alias("inside"))
    per = edge.join(news, [by, "__b"])
    v = Window.partitionBy(by).orderBy("__b")
    before = F.lag("last").over(v)
    per = per.withColumn("starts", F.when(before.isNull() | (F.col("first") <= before), F.lit(1)).otherwise(F.lit(0)))
    per = per.withColumn("offset", F.sum(F.col("starts") + F.col("inside")).over(v.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside"))
    out = inner.join(per.select(by, "__b", "offset"), [by, "__b"])
    return out.withColumn("pulse_number", (F.col("__k") + F.col("offset")).cast("long")).drop("__b", "__new", "__k", "offset")


def pulse_returns(numbered: DataFrame, by: str = "point_source_id") -> DataFrame:
    """Returns of each pulse."""
    return numbered.groupBy(by, "pulse_number").agg(F.count("*").alias("pulse_returns"))


def pulse_index(numbered: DataFrame, by: str = "point_source_id", time: str = "gps_time", row_id: str = "pid") -> DataFrame:
    """numbered with ind_pulse: the place of a return in a matrix of pulses (rows) and returns (columns), counted
    down the columns: pulse + (rank in pulse - 1) * pulses of the source."""
    n = numbered.groupBy(by).agg(F.max("pulse_number").alias("__n"))
    k = F.row_number().over(Window.partitionBy(by, "pulse_number").orderBy(time, row_id))
    d = numbered.withColumn("__k", k).join(n, by)
    return d.withColumn("ind_pulse", F.col("pulse_number") + (F.col("__k") - 1) * F.col("__n")).drop("__k", "__n")


def line_times(points: DataFrame, weeks: DataFrame, *, by: str = "point_source_id", week: str = "gps_week", seconds: str = "gps_time", form: str = "adjusted", out: str = "time") -> DataFrame:
    """points with `out`: their seconds of the GPS week as full time, the week being that of their flight line.

    weeks: one row a line (of several the least week counts); form as in gpstime.week_time. Lines without a week, and null
    seconds, get a null. The lookup has a row for each line, so AQE broadcasts it where it is small."""
    w = weeks.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.min(week).alias("__week"))
    d = points.join(w, F.col(by) == F.col("__by"), "left")
    return d.withColumn(out, week_time(F.col("__week"), F.col(seconds), form)).drop("__by", "__week")
