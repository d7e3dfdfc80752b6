import math
import random

import pytest
from pyspark.sql import functions as F

from laserloom.operators import spatial

P = "id long, x double, y double"


def brute(a, b, r):
    return {(i, j) for i, x, y in a for j, u, v in b if None not in (i, j, x, y, u, v) and not any(math.isnan(w) or math.isinf(w) for w in (x, y, u, v)) and (x - u) ** 2 + (y - v) ** 2 <= r * r}


def near(spark, a, b, r, **k):
    kw = {"left_id": "id", "right_id": "id", "left_xy": ("x", "y"), "right_xy": ("x", "y")} | k
    return {tuple(x) for x in spatial.within_distance(spark.createDataFrame(a, P), spark.createDataFrame(b, P), r, **kw).collect()}


@pytest.mark.parametrize("r,scale", [(0.5, 5), (1.505, 20), (300.0, 5000), (0.5, 2.6e6)])
def test_within_distance(spark, r, scale):
    rnd = random.Random(1)
    a = [(i, round(rnd.uniform(-scale, scale), 2), round(rnd.uniform(-5, 5), 2)) for i in range(150)]
    b = [(i, round(rnd.uniform(-scale, scale), 2), round(rnd.uniform(-5, 5), 2)) for i in range(300)]
    a += [(900, None, 1.0), (901, float("nan"), 1.0), (None, 1.0, 1.0), (902, float("inf"), 0.0), a[0]]
    b += [(800, 1.0, None), b[1], (801, a[1][1], a[1][2]), (802, 1e100, 0.0)]
    assert near(spark, a, b, r) == brute(a, b, r)


def test_edge_of_the_radius_counts(spark):
    assert near(spark, [(1, 0.0, 0.0)], [(2, 3.0, 4.0), (3, 3.0, 4.0000001)], 5.0) == {(1, 2)}


def test_hot_place(spark):
    a = [(i, 1.0, 1.0) for i in range(5)]
    b = [(i, 1.0, 1.0) for i in range(2000)] + [(i, i * 1.0, 7.0) for i in range(3000, 3100)]
    assert len(near(spark, a, b, 0.1)) == 10_000


def test_empty(spark):
    assert near(spark, [], [(1, 0.0, 0.0)], 1.0) == set() == near(spark, [(1, 0.0, 0.0)], [], 1.0)


def test_clashing_names(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, "p", 7, 8)], "id long, x double, y double, __block string, a long, rel long")
    assert spatial.within_distance(a, a, 1.0, left_id="id", right_id="id", left_xy=("x", "y"), right_xy=("x", "y")).collect() == [(1, 1)]


def test_codes_keep_order_within_a_box(spark):
    d = spark.range(4096).select((F.col("id") % 64).alias("i"), F.floor(F.col("id") / 64).alias("j"))
    rows = spatial.add_morton(d, {"c": ("i", "j")}).collect()
    assert len({r.c for r in rows}) == 4096
    by = {(r.i, r.j): r.c for r in rows}
    inside = [by[i, j] for i in range(5, 20) for j in range(9, 31)]
    assert min(inside) == by[5, 9] and max(inside) == by[19, 30]


NAN = float("nan")
REGIONS = [
    (1, [0.0, 10.0, 10.0, 0.0, NAN, 2.0, 2.0, 8.0, 8.0, 2.0], [0.0, 0.0, 10.0, 10.0, NAN, 2.0, 8.0, 8.0, 2.0, 2.0]),  # open ring with a hole
    (2, [0.0, 4.0, 4.0, 2.0, 0.0, 0.0], [0.0, 0.0, 4.0, 1.0, 4.0, 0.0]),  # concave, closed
    (3, [], []),
    (4, None, None),
    (5, [50.0, 60.0, 55.0], [50.0, 50.0, 5000.0]),  # large
    (1, [0.0, 10.0, 10.0, 0.0, NAN, 2.0, 2.0, 8.0, 8.0, 2.0], [0.0, 0.0, 10.0, 10.0, NAN, 2.0, 8.0, 8.0, 2.0, 2.0]),
]


def test_in_regions(spark):
    reg = spark.createDataFrame(REGIONS, "rid long, vx array<double>, vy array<double>")
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 2.0, 5.0), (4, 10.0, 3.0), (5, 2.0, 3.0), (6, 55.0, 2000.0), (7, 0.0, 0.0), (8, None, 1.0), (9, 1.0, NAN), (1, 1.0, 1.0), (10, 10.00001, 3.0)]
    got = {tuple(r) for r in spatial.in_regions(reg, spark.createDataFrame(pts, P), region_id="rid", point_id="id", region_xy=("vx", "vy")).collect()}
    assert got == {(1, 1), (2, 1), (1, 3), (1, 4), (1, 5), (5, 6), (1, 7), (2, 7)}
    none = spatial.in_regions(reg.limit(0), spark.createDataFrame(pts, P), region_id="rid", point_id="id", region_xy=("vx", "vy"))
    assert none.count() == 0


def test_found_on_data(spark, small):
    from laserloom.plans.queries import QUERIES

    got = QUERIES["p5_found"](spark, small)
    assert got.columns == ["rel", "a", "b"] and got.groupBy("rel").count().count() == 3 and got.count() == got.distinct().count()
