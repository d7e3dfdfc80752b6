"""Percentiles with a guaranteed relative error, from counts in signed logarithmic buckets.

A value v falls into bucket ceil(log(|v|) / log(g)) of its sign, g = (1 + e) / (1 - e), so the middle of
each bucket is within the relative error e of every value in it. A sketch is a table of counts; sketches
of partitions, files or days are merged by adding the counts of equal buckets, in any order and exactly.
The number of buckets of a group is bounded by the range of its values, not by their number, and counting
runs map-side before each shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laserloom.functions.gpstime import adjusted_to_utc

#: Relative error of the queries.
ERROR = 0.01
#: Values closer to zero than this (the least normal double) count as zero.
ZERO = 2.2250738585072014e-308
#: Added to bucket numbers so that their sign can hold that of the value (with an error of 0.001 they reach 354,000).
SHIFT = 1_000_000
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def bucket(v: Column, error: float = ERROR) -> Column:
    """Bucket of a value as INT, in the order of the values; null for null, NaN and infinite values."""
    g = math.log((1 + error) / (1 - error))
    k = (F.ceil(F.ln(F.abs(v)) / F.lit(g)) + F.lit(SHIFT)) * F.signum(v)
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(1.7976931348623157e308))
    return F.when(usable, F.when(F.abs(v) < F.lit(ZERO), F.lit(0)).otherwise(k.cast("int")))


def bucket_value(b: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket."""
    g = (1 + error) / (1 - error)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * F.lit(2.0 / (g + 1)) * F.pow(F.lit(g), F.abs(b) - F.lit(SHIFT)))


def sketch(df: DataFrame, keys: list[str], value: str, *, error: float = ERROR) -> DataFrame:
    """keys, bucket, n. Null, NaN and infinite values are not counted; null keys make a group."""
    d = df.select(*[F.col(f"`{k}`") for k in keys], bucket(F.col(f"`{value}`").cast("double"), error).alias("bucket")).where("bucket is not null")
    return d.groupBy(*[f"`{k}`" for k in keys], "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys (or a union of sketches) as sketches by `keys`."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float] = QUANTILES, *, error: float = ERROR) -> DataFrame:
    """keys, n and one column for each quantile q: the ceil(q * n)-th value (the first at least), with
    the relative error at most. Groups without values have no row."""
    whole = Window.partitionBy(*keys)
    d = sketches.withColumns({"__total": F.sum("n").over(whole), "__upto": F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("__total") * F.lit(q) - F.lit(1e-9)))
    first = {c: F.min(F.when(F.col("__upto") >= rank(q), F.col("bucket"))).alias(c) for c, q in quantiles.items()}
    got = d.groupBy(*keys).agg(F.max("__total").alias("n"), *first.values())
    return got.select(*keys, "n", *[bucket_value(F.col(c), error).alias(c) for c in quantiles])


def distinct_readings(points: DataFrame, *, error: float = ERROR) -> DataFrame:
    """Line, label, file, day and the buckets of intensity and z of distinct points.

    day counts from 1970-01-01; a point without gps_time has none. Buckets are taken before the shuffle
    that removes exact duplicates, as they are narrower than the values. It goes by label and block of 2^14 row ids:
    copies meet, a label's points stay together for the counts that follow, and a label with a third of all
    points spreads over its blocks."""
    day = F.unix_date(F.to_date(adjusted_to_utc(F.col("gps_time"), exact=True)))
    d = points.select("pid", "point_source_id", "label", "file", day.alias("day"), bucket(F.col("intensity"), error).alias("bi"), bucket(F.col("z"), error).alias("bz"))
    return d.withColumn("block", F.shiftright("pid", 14)).repartition("label", "block").distinct().drop("block")


def _each_field(d: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field and bucket of each reading."""
    each = F.explode(F.array(F.struct(F.lit("intensity").alias("field"), F.col("bi").alias("bucket")), F.struct(F.lit("z").alias("field"), F.col("bz").alias("bucket"))))
    return d.select(*keys, each.alias("e")).select(*keys, "e.field", "e.bucket").where("bucket is not null")


def point_percentiles(points: DataFrame, *, error: float = ERROR) -> DataFrame:
    """dim, key, field, n and percentiles of intensity and z by flight line, label, file and day.

    One pass counts the distinct points by all four at once (grouping sets, partly before the shuffle). A null key is a
    group of its own (key null)."""
    dims = ["point_source_id", "label", "file", "day"]
    e = _each_field(distinct_readings(points, error=error), dims)
    sets = e.groupingSets([[F.col(c), F.col("field"), F.col("bucket")] for c in dims], *dims, "field", "bucket")
    counts = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # of the bits of g, one for each column in order, that of the dimension is 0
    own = [(c, F.col("g") == sum(1 << (5 - i) for i in range(4) if dims[i] != c)) for c in dims]
    dim = F.coalesce(*[F.when(is_own, F.lit(c)) for c, is_own in own])
    key = F.coalesce(*[F.when(is_own, F.col(c).cast("string")) for c, is_own in own])
    keys = ["dim", "key", "field"]
    return percentiles(counts.select(dim.alias("dim"), key.alias("key"), "field", "bucket", "n"), keys, error=error)


def cell_percentiles(points: DataFrame, *, error: float = ERROR) -> DataFrame:
    """point_source_id, label, file, day, field, n and percentiles for each combination that has points."""
    keys = ["point_source_id", "label", "file", "day", "field"]
    e = _each_field(distinct_readings(points, error=error), keys[:-1])
    return percentiles(e.groupBy(*keys, "bucket").agg(F.count("*").alias("n")), keys, error=error)
