import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laserloom.llm.nearest_time import END, Buffer, nearest_time, stream_nearest

KW = {"by": ("e", "e"), "times": ("t", "t"), "ids": ("i", "k"), "tolerance": 0.04}


def brute(left, right, tol=40_000):
    out = set()
    us = lambda t: round(t * 1e6)
    bad = lambda r: any(v is None or v != v for v in r)
    for e, t, i in left:
        if bad((e, t, i)):
            continue
        c = [(abs(us(t) - us(u)), us(u), k) for f, u, k in right if not bad((f, u, k)) and f == e and abs(us(t) - us(u)) <= tol]
        if c:
            out.add((i, min(c)[2]))
    return out


def frames(spark, left, right):
    a = spark.createDataFrame(left, "e int, t double, i long").selectExpr("*", "'x' as __t", "1 as __b")
    return a, spark.createDataFrame(right, "e int, t double, k long").selectExpr("*", "'y' as __i")


@pytest.mark.parametrize("bucket", [0.05, 4.0, 1000.0])
def test_agrees_with_brute_force(spark, bucket):
    r = random.Random(2)
    left = [(r.choice([1, 1, 1, 2, None]), 3e8 + round(r.uniform(0, 20), 6), n) for n in range(800)]
    right = [(r.choice([1, 2, 2, None]), 3e8 + round(r.uniform(0, 20), 6), n) for n in range(300)]
    left += [(1, None, 900), (1, float("nan"), 901), (1, 3e8 + 1, None), left[0], left[0]]
    right += [(1, 3e8 + 5, 700), (1, 3e8 + 5, 600), (1, None, 701), right[0]]
    left += [(1, 3e8 + 5.01, 910), (1, 3e8 + 5.04, 911), (1, 3e8 + 4.96, 912), (7, 3e8, 913)]
    got = nearest_time(*frames(spark, left, right), **KW, bucket=bucket).collect()
    assert {tuple(x) for x in got} == brute(left, right) and len(got) == len({tuple(x) for x in got})


def test_ties_take_the_earlier(spark):
    got = nearest_time(*frames(spark, [(1, 10.0, 1)], [(1, 10.02, 5), (1, 9.98, 6), (1, 9.98, 4)]), **KW).collect()
    assert got == [(1, 4)]


def test_empty(spark):
    a, b = frames(spark, [(1, 1.0, 1)], [(1, 1.0, 2)])
    assert nearest_time(a.limit(0), b, **KW).count() == 0 == nearest_time(a, b.limit(0), **KW).count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_buffer_emits_alike_however_it_is_fed(rows, step, tol):
    rows = sorted(rows)
    left = [(t, n) for n, (t, s) in enumerate(rows) if s]
    right = [(t, n) for n, (t, s) in enumerate(rows) if not s]
    arr = lambda x: (np.array([v[0] for v in x], np.int64), np.array([v[1] for v in x], np.int64))
    whole = Buffer(tol)
    whole.add(*arr(left), *arr(right))
    want = sorted(zip(*map(list, whole.advance(END))))
    b, got = Buffer(tol), []
    for k in range(0, len(rows), step):
        part = [(n, r) for n, r in enumerate(rows)][k : k + step]
        b.add(*arr([(r[0], n) for n, r in part if r[1]]), *arr([(r[0], n) for n, r in part if not r[1]]))
        got += zip(*map(list, b.advance(part[-1][1][0])))
        held = part[-1][1][0]
        assert all(t >= held - tol for t in b.lt) and all(t >= held - 2 * tol for t in b.rt)  # evicted
    got += zip(*map(list, b.advance(END)))
    assert sorted(got) == want


def test_stream(spark, tmp_path):
    r = random.Random(5)
    left = [(r.choice([1, 2]), round(r.uniform(0, 300), 3), n) for n in range(400)]
    right = [(r.choice([1, 2]), round(r.uniform(0, 300), 3), n) for n in range(300)]
    for k in range(3):  # arrival in order, by the hundred seconds, and a last row that closes the watermark
        for name, rows, cols in (("l", left, "e int, t double, i long"), ("r", right, "e int, t double, k long")):
            part = [x for x in rows if k * 100 <= x[1] < (k + 1) * 100] + ([(9, 5000.0, 9999)] if k == 2 else [])
            spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, cols: spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    q = stream_nearest(read("l", "e int, t double, i long"), read("r", "e int, t double, k long"), **KW, delay="110 seconds", bucket=30.0)
    s = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    s.awaitTermination(240)
    got = {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got - {(9999, 9999)} == brute(left, right)


def test_found_on_data(spark, small):
    from laserloom.llm.queries import QUERIES

    got = QUERIES["p1_found"](spark, small)
    assert got.columns == ["pid", "rec_id"] and got.count() == got.select("pid").distinct().count() > 0
