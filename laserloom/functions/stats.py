"""Statistics with the definitions the metrics use, as column builders and bounded multi-pass operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hazen(sorted_values: Column, p: float) -> Column:
    """Quantile of a sorted array: position n * p + 0.5 held to 1..n, linear between neighbours.
    Null for an empty or null array."""
    n = F.size(sorted_values)
    at = F.least(F.greatest(n * F.lit(p) + F.lit(0.5), F.lit(1.0)), n.cast("double"))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, n)
    a, b = F.element_at(sorted_values, low), F.element_at(sorted_values, high)
    return F.when(n > 0, a + (b - a) * (at - low))


def hazen_of(values: Column, p: float) -> Column:
    """Aggregate: Hazen quantile of a group that fits a row (a segment, not a table)."""
    return hazen(F.array_sort(F.collect_list(values)), p)


def std0(v: Column) -> Column:
    """Sample standard deviation; 0 for a single value, null for none."""
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))


def kurtosis3(v: Column) -> Column:
    """Population kurtosis, 3 for a normal distribution; null where all values are equal."""
    return F.kurtosis(v) + F.lit(3.0)


def fraction(condition: Column) -> Column:
    """Share of rows that meet a condition (null counts as not met)."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def mode_smallest(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value by keys; of equals the smallest. Two aggregations, both map-side first."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return c.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("__n"), F.col(value))).alias(out))


def exact_hazen(df: DataFrame, value: str, probs: list[float], bins: int = 2048, few: int = 20_000) -> list[float | None]:
    """Exact Hazen quantiles of a whole column without sorting or gathering it.

    Each pass counts values in `bins` intervals of the range that still holds a wanted order statistic,
    until the interval has at most `few` values (or one distinct value); only those reach the driver."""
    d = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = d.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probs)
    need: set[int] = set()
    spots = []
    for p in probs:
        at = min(max(n * p + 0.5, 1.0), float(n))
        k = math.floor(at)
        spots.append((k, min(k + 1, n), at - k))
        need |= {k, min(k + 1, n)}
    found: dict[int, float] = {}
    todo = [(low, high, 0, n, sorted(need))]  # values in [low, high], how many lie below, how many in it
    while todo:
        a, b, below, size, ks = todo.pop()
        part = d.where((F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b)))
        if a == b or size <= few:
            at = below
            for v, c in sorted((r[0], r[1]) for r in part.groupBy("v").count().collect()):
                for k in ks:
                    if at < k <= at + c:
                        found[k] = v
                at += c
            continue
        width = (b - a) / bins
        i = F.least(F.floor((F.col("v") - F.lit(a)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        got = sorted(tuple(r) for r in part.groupBy(i.alias("i")).agg(F.count("*"), F.min("v"), F.max("v")).collect())
        at = below
        for _, c, lo, hi in got:
            inside = [k for k in ks if at < k <= at + c]
            if inside:
                todo.append((lo, hi, at, c, inside))
            at += c
    return [found[i] + (found[j] - found[i]) * f for i, j, f in spots]
