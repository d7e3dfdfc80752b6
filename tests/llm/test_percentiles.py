import math
import random

from pyspark.sql import functions as F

from laserloom.llm import percentiles as P


def rank(v, q):
    v = sorted(v)
    return v[max(1, math.ceil(q * len(v) - 1e-9)) - 1]


def test_error_is_bounded_and_merging_is_exact(spark):
    r = random.Random(3)
    rows = []
    for n in range(6000):
        g = r.choice("aab")
        rows.append((g, n % 7, r.choice([r.gauss(0, 1), -math.exp(r.uniform(-10, 20)), math.exp(r.uniform(-10, 20)), 0.0, 1e-12])))
    rows += [("a", 1, None), ("a", 1, float("nan")), ("a", 2, float("inf")), ("a", 2, -float("inf")), (None, 3, 5.0), ("c", 1, -3.0), ("d", 1, None)]
    d = spark.createDataFrame(rows, "g string, day int, v double").withColumn("bucket", F.lit("clash"))
    whole = P.percentiles(P.sketch(d, ["g"], "v"), ["g"])
    merged = P.percentiles(P.merge(P.sketch(d, ["g", "day"], "v"), ["g"]), ["g"])
    parts = P.sketch(d.where("day < 3"), ["g"], "v").unionByName(P.sketch(d.where("day >= 3"), ["g"], "v"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect())) == sorted(map(str, P.percentiles(P.merge(parts, ["g"]), ["g"]).collect()))
    got = {x.g: x for x in whole.collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, x in got.items():
        v = [k for a, _, k in rows if a == g and k is not None and math.isfinite(k)]
        assert x.n == len(v)
        for c, q in P.QUANTILES.items():
            want = rank(v, q)
            assert abs(x[c] - want) <= P.ERROR * abs(want) * (1 + 1e-9) + P.ZERO, (g, c, x[c], want)


def test_empty_and_ties(spark):
    d = spark.createDataFrame([("a", 5.0)] * 10, "g string, v double")
    x = P.percentiles(P.sketch(d, ["g"], "v"), ["g"]).first()
    assert x.n == 10 and len({x[c] for c in P.QUANTILES}) == 1 and abs(x.p50 - 5) <= 0.05
    assert P.percentiles(P.sketch(d.limit(0), ["g"], "v"), ["g"]).count() == 0


def test_points_count_once(spark, small):
    p = spark.read.parquet(f"{small}/points.parquet")
    got = P.point_percentiles(p)
    assert got.exceptAll(P.point_percentiles(p.unionByName(p))).count() == 0
    n = p.select("pid", "z").distinct().where("z is not null").count()
    sums = {r.dim: r.n for r in got.where("field = 'z'").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    assert sums == {k: n for k in ("point_source_id", "label", "file", "day")}
