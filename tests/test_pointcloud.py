"""Hand-checked values and properties of the point cloud operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laserloom.functions import gpstime, stats
from laserloom.geometry import hull
from laserloom.operators import coloring, components, grid, hulls, models, predicates, pulses, segmentation, segments, tiles, voxel

XYZ = "pid long, x double, y double, z double"


def test_statistics(spark):
    d = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "v double")
    q = d.agg(*[stats.hazen_of(F.col("v"), p) for p in (0.01, 0.25, 0.5, 0.75, 0.9)], stats.kurtosis3(F.col("v")), F.skewness("v")).first()
    assert list(q)[:5] == [1, 1.5, 3, 7, 10] and abs(q[5] - 2.0707692) < 1e-6 and abs(q[6] - 0.8483207) < 1e-6
    one = spark.createDataFrame([(3.0,)], "v double").agg(stats.std0(F.col("v")), stats.hazen_of(F.col("v"), 0.5)).first()
    assert tuple(one) == (0.0, 3.0)


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_exact_hazen_of_a_column(spark, few):
    v = np.round(np.random.RandomState(1).lognormal(3, 2, 3000), 2)
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    s = np.sort(v)
    for p, got in zip((0.0, 0.01, 0.5, 0.99, 1.0), stats.exact_hazen(d, "v", [0.0, 0.01, 0.5, 0.99, 1.0], bins=16, few=few)):
        at = min(max(len(s) * p + 0.5, 1), len(s))
        k = int(at)
        want = s[k - 1] + (s[min(k, len(s) - 1)] - s[k - 1]) * (at - k)
        assert got == pytest.approx(want, abs=1e-12)
    assert stats.exact_hazen(d.limit(0), "v", [0.5]) == [None]


def test_gps_time(spark):
    d = spark.createDataFrame([(1167264018.0,), (1167264010.0,)], "t double")
    got = [str(r[0]) for r in d.select(gpstime.gps_to_utc(F.col("t"))).collect()]
    assert got == ["2017-01-01 00:00:00", "2016-12-31 23:59:52"]
    assert str(d.select(gpstime.gps_to_utc(F.col("t"), exact=True)).collect()[1][0]) == "2016-12-31 23:59:53"
    w = spark.createDataFrame([(1, 10.0)], "w int, s double")
    assert w.select(gpstime.week_time(F.col("w"), F.col("s")), gpstime.week_time(F.col("w"), F.col("s"), "adjusted")).first() == (604810.0, 604810.0 - 1e9)
    with pytest.raises(ValueError):
        gpstime.week_time(F.col("w"), F.col("s"), "other")


def test_cells_and_rasters(spark):
    p = spark.createDataFrame([(1, 0.0, 1.0, 5.0), (2, 0.0, 0.0, 1.0), (3, 1.0, 0.0, 2.0), (4, 0.4, 0.2, 3.0), (5, None, 0.0, 9.0)], XYZ)
    ref = grid.grid_over(p, 1.0)
    got = {r.pid: (r.row, r.col) for r in grid.with_cell(p, ref).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (2, 2), 4: (2, 1)} and (ref.nrows, ref.ncols) == (2, 2)
    r = {(x.row, x.col): x.value for x in grid.rasterize(p, ref, "z", "max", fill=-1.0, dense=True).collect()}
    assert r == {(1, 1): 5, (1, 2): -1, (2, 1): 3, (2, 2): 2}
    assert grid.rasterize(p.limit(0), ref).count() == 0 and grid.grid_over(p.limit(0), 1.0).nrows == 0
    with pytest.raises(ValueError):
        grid.grid_over(p, 0)


def dense(spark, a):
    return spark.createDataFrame([(i + 1, j + 1, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)], "row int, col int, value double"), grid.GridRef(0, 0, 1, -1, *a.shape)


def back(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.row - 1, r.col - 1] = r[name]
    return out


@pytest.mark.parametrize("size", [3, 9])
def test_focal_replicates_edges(spark, size):
    a = np.random.RandomState(2).rand(11, 14)
    k = np.random.RandomState(3).rand(size, size)
    df, ref = dense(spark, a)
    pad = np.pad(a, size // 2, mode="edge")
    want = np.array([[(pad[i : i + size, j : j + size] * k).sum() for j in range(14)] for i in range(11)])
    assert np.allclose(back(grid.focal(df, ref, k.tolist()), a.shape), want)


def test_nearest_fill(spark):
    a = np.full((40, 170), np.nan)
    a[3, 5], a[30, 160], a[3, 9] = 1, 2, 3
    df, ref = dense(spark, a)
    got = {(r.row, r.col): (r.value, r.dist) for r in grid.nearest_fill(df, ref, tile=32).collect()}
    src = [(j, i, a[i, j]) for i, j in zip(*np.nonzero(~np.isnan(a)))]
    for i in range(40):
        for j in range(170):
            d, _, _, v = min((math.hypot(i - y, j - x), x, y, v) for x, y, v in src)
            assert got[i + 1, j + 1][0] == v and abs(got[i + 1, j + 1][1] - d) < 1e-9
    none = grid.nearest_fill(*dense(spark, np.full((3, 3), np.nan)))
    assert none.count() == 9 and none.where("value is not null").count() == 0


def test_idw_by_tiles_and_by_scatter_agree(spark):
    a = np.random.RandomState(4).rand(30, 30) * 100 + 1000
    a[np.random.RandomState(5).rand(30, 30) < 0.8] = np.nan
    df, ref = dense(spark, a)
    cells = df.where("value is not null")
    want = np.full(a.shape, np.nan)
    for i in range(30):
        for j in range(30):
            num = den = 0.0
            for y, x in zip(*np.nonzero(~np.isnan(a))):
                d = math.hypot(i - y, j - x)
                if d <= 6:
                    w = (d or 0.001) ** -3
                    num, den = num + w * a[y, x], den + w
            want[i, j] = num / den if den else np.nan
    assert np.allclose(back(grid.idw(cells, ref, 6), a.shape), want, atol=1e-3, equal_nan=True)


def test_dilate_and_erode(spark):
    _, ref = dense(spark, np.zeros((9, 9)))
    one = spark.createDataFrame([(5, 5)], "row int, col int")
    big = grid.dilate(one, ref, 2)
    assert big.count() == 13 and grid.erode(big, ref, 2).collect() == [(5, 5)]
    assert grid.dilate(spark.createDataFrame([(1, 1)], "row int, col int"), ref, 1).count() == 3


def test_models(spark):
    rows = [(i, float(i % 10), float(i // 10), 100.0 + (i % 10), 2) for i in range(100)] + [(200, 4.2, 4.1, 130.0, 5), (201, 2.0, 2.0, 50.0, 5)]
    p = spark.createDataFrame(rows, XYZ + ", classification int")
    ref = grid.grid_over(p, 1.0)
    for method in ("nearest", "idw", "linear", "natural"):
        m = {(r.row, r.col): r for r in models.elevation_models(p, ref, method=method).collect()}
        assert len(m) == 100 and all(r.height >= 0 for r in m.values())
        top = max(m.values(), key=lambda r: r.height)
        assert abs(top.height - 26) < 1.5 and top.surface == 130.0 and top.density_overall == 2
    with pytest.raises(ValueError):
        models.terrain_model(p.where("classification = 5"), ref)
    with pytest.raises(ValueError):
        models.elevation_models(p, ref, layers=("roof",))
    h = {r.pid: r.h for r in models.heights(p).collect()}
    assert h[200] == 26.0 and h[201] == 0.0 and h[5] == 0.0
    h = {r.pid: r.h for r in models.heights(p, method="linear").collect()}
    assert len(h) == 102 and abs(h[200] - 25.8) < 1e-6 and h[201] == 0.0 and abs(h[5]) < 1e-6


@pytest.mark.parametrize("nrows, ncols", [(150, 9), (40, 70), (1, 30)])
def test_reach_is_that_of_the_whole_grid(spark, nrows, ncols):
    r = np.random.RandomState(nrows)
    at = {(int(r.randint(nrows)) + 1, int(r.randint(ncols)) + 1) for _ in range(5)}
    ref = grid.GridRef(0.0, 0.0, 1.0, -1.0, nrows, ncols)
    want = max(min(math.hypot(i - a, j - b) for a, b in at) for i in range(1, nrows + 1) for j in range(1, ncols + 1))
    d = spark.createDataFrame([(*k, 1.0) for k in sorted(at)] + [(1, 1, None)], "row int, col int, value double")
    assert grid.reach(d, ref) == pytest.approx(want)


def test_unbounded_idw_takes_its_radius_from_the_whole_grid(spark):
    # two strips of ground and an empty stretch between them, which the data mask leaves out
    r = np.random.RandomState(5)
    rows = [(float(x), float(y), float(r.rand() * 50), 2) for x in (0, 1, 24, 25) for y in range(20) if r.rand() < 0.6 or (x, y) in ((0, 0), (25, 19))]
    p = spark.createDataFrame(rows, "x double, y double, z double, classification int")
    ref = grid.grid_over(p, 1.0)
    v = {(round((y - ref.y0) / ref.dy), round((x - ref.x0) / ref.dx)): z for x, y, z, _ in rows}
    near = lambda i, j: min(math.hypot(i - a, j - b) for a, b in v)
    radius = math.ceil(max(near(i, j) for i in range(1, ref.nrows + 1) for j in range(1, ref.ncols + 1)))

    def brute(i, j):
        w = [((math.hypot(i - a, j - b) or 0.001) ** -3.0, z) for (a, b), z in v.items() if math.hypot(i - a, j - b) <= radius]
        return sum(k * z for k, z in w) / sum(k for k, _ in w)

    got = {(x.row, x.col): x.terrain for x in models.elevation_models(p, ref, layers=("terrain",)).collect()}
    assert radius > 10 and 0 < len(got) < ref.nrows * ref.ncols
    assert all(t == pytest.approx(brute(*k), abs=1e-3) for k, t in got.items())


def test_linear_interpolation_of_a_plane(spark):
    i, j = np.meshgrid(np.arange(30), np.arange(40), indexing="ij")
    a = 3.0 * i - 2.0 * j
    gaps = a.copy()
    gaps[5:20, 8:30] = np.nan
    from laserloom.geometry.interpolate import fill_linear

    assert np.allclose(fill_linear(gaps), a, atol=1e-4)


def test_predicates(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0, 1.0), (2, 0.0, 5.0, 1.0), (3, 10.0, 10.0, 1.0), (4, 10.1, 5.0, 1.0), (5, None, 5.0, 1.0)], XYZ)
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    got = predicates.clip(p, square)
    assert {r.pid for r in got.collect()} == {1, 2, 3} and got.columns == p.columns
    assert predicates.clip(got, square).count() == got.count()
    hole = [square, [(4, 4), (6, 4), (6, 6), (4, 6)]]
    assert {r.pid for r in predicates.clip(p, hole).collect()} == {2, 3}
    with pytest.raises(ValueError):
        predicates.close_ring([(0, 0), (1, 1), (0, 0)])
    s = predicates.cross_section(spark.createDataFrame([(1, 3.0, 0.5, 7.0), (2, 3.0, 2.5, 7.0), (3, -1.0, 0.0, 1.0)], XYZ), (0, 0), (10, 0), 2).collect()
    assert [(r.pid, r.rho, r.z, r.d) for r in s] == [(1, 3.0, 7.0, 0.5)]


@pytest.mark.parametrize("bucket", [0.5, 2.0, 100.0])
def test_pulses(spark, bucket):
    n = [1, 2, 3, 1, 1, 2]
    p = spark.createDataFrame([(i, 7, float(i), v) for i, v in enumerate(n)] + [(90, None, 1.0, 1), (91, 8, None, 1)], "pid long, point_source_id int, gps_time double, return_number int")
    d = pulses.number_pulses(p, bucket=bucket)
    assert [r.pulse_number for r in d.orderBy("pid").collect()] == [1, 1, 1, 2, 3, 3]
    assert [r.pulse_returns for r in pulses.pulse_returns(d).orderBy("pulse_number").collect()] == [3, 1, 2]
    assert [r.ind_pulse for r in pulses.pulse_index(d).orderBy("pid").collect()] == [1, 4, 7, 2, 3, 6]


def test_medoid(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 10.0, 0.0)], "pid long, x double, y double")
    m = voxel.medoid(p, [], ["x", "y"], "pid").first()
    assert (m.pid, m.ssd, m.n) == (2, 68.0, 3)
    one = voxel.medoid(p.where("pid = 1"), [], ["x", "y"], "pid").first()
    assert one.pid == 1 and one.ssd is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40))
def test_medoid_is_that_of_all_pairs(spark, rows):
    d = spark.createDataFrame([(i, k, float(x), float(y)) for i, (k, x, y) in enumerate(rows)], "pid long, k int, x double, y double")
    got = {r.k: r.ssd for r in voxel.medoid(d, ["k"], ["x", "y"], "pid").collect()}
    for k in {r[0] for r in rows}:
        own = np.array([r[1:] for r in rows if r[0] == k], float)
        ssd = ((own[:, None] - own[None]) ** 2).sum((1, 2)).min()
        assert got[k] == (None if len(own) == 1 else pytest.approx(ssd, abs=1e-6))


def test_echo_ratio(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.1, 0.1, 1.0), (3, 0.2, 0.1, 1.0), (4, 0.1, 0.2, 1.2)], XYZ)
    e = {r.pid: r.echo_ratio for r in voxel.echo_ratio(p, 0.5).collect()}
    assert e == {1: 0.25, 2: 0.75, 3: 0.75, 4: 0.75}
    c = {r.pid: r.echo_ratio for r in voxel.echo_ratio(p, 0.5, "cumulative").collect()}
    assert c == {1: 1.0, 2: 0.75, 3: 0.75, 4: 0.75}
    assert voxel.echo_ratio(p.limit(0)).count() == 0
    with pytest.raises(ValueError):
        voxel.echo_ratio(p, 0.5, "other")


def test_colouring(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    o = coloring.degree_order(e, spark.createDataFrame([(1,), (2,), (3,), (9,), (0,), (None,)], "label long"))
    for f in (coloring.greedy, coloring.greedy_local):
        assert {r.label: r.color for r in f(e, o).collect()} == {2: 1, 1: 2, 3: 2, 9: 1}
    r = np.random.RandomState(6)
    pairs = {(min(a, b), max(a, b)) for a, b in r.randint(1, 40, (150, 2)).tolist() if a != b}
    e = spark.createDataFrame(sorted(pairs), "a long, b long")
    o = coloring.degree_order(e, e.select(F.col("a").alias("label")).union(e.select("b")))
    a, b = ({x.label: x.color for x in f(e, o).collect()} for f in (coloring.greedy, coloring.greedy_local))
    assert a == b and all(a[x] != a[y] for x, y in pairs)


def test_topo_color(spark, small):
    p = spark.read.parquet(f"{small}/points.parquet")
    d = coloring.topo_color(p)
    c = {r.label: r.color for r in d.select("label", "color").distinct().collect() if r.label}
    assert all(c[r.a] != c[r.b] for r in coloring.adjacency(p).collect())
    assert d.where("coalesce(label, 0) = 0 and color <> 0").count() == 0
    with pytest.raises(ValueError):
        coloring.topo_color(p, colormap="auto")


def test_components(spark):
    r = np.random.RandomState(7)
    edges = [(int(a), int(a) + 1) for a in range(100, 160)] + [(int(a), int(b)) for a, b in r.randint(0, 60, (40, 2))]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_open_by_reconstruction(spark):
    a = np.zeros((20, 20))
    a[2:10, 2:10] = 1
    a[5, 10:15] = 1  # a thin arm of the large patch stays
    a[15, 15] = 1  # a lone cell goes
    df, ref = dense(spark, a)
    got = back(components.open_by_reconstruction(df.where("value = 1"), ref, 2).withColumn("value", F.lit(1.0)), a.shape)
    a[15, 15] = 0
    assert (np.nan_to_num(got) == a).all()


def test_watershed_and_peaks(spark):
    i, j = np.meshgrid(np.arange(40), np.arange(40), indexing="ij")
    a = np.maximum(20 - np.hypot(i - 10, j - 10), 15 - np.hypot(i - 28, j - 30))
    df, ref = dense(spark, a)
    s = back(segmentation.watershed(df, ref, radius=1.5), a.shape, "segment")
    assert len(np.unique(s[~np.isnan(s)])) == 2 and s[10, 10] != s[28, 30] and s[9, 12] == s[10, 10]
    assert {(r.row, r.col) for r in segmentation.peaks(df, ref).collect()} == {(11, 11), (29, 31)}


def test_superpixels_cover_the_image(spark):
    a = np.random.RandomState(8).rand(30, 30)
    df, ref = dense(spark, a)
    got = segmentation.superpixels(df, ref, radius=4.0, rounds=2)
    assert got.count() == 900 and 5 < got.select("superpixel").distinct().count() < 60


def test_hulls_contain_all_points():
    r = np.random.RandomState(9)
    for d in (2, 3, 4):
        p = r.randn(200, d)
        h = hull.convex_hull(p)
        assert (p @ h.normals.T - h.offsets).max() < 1e-9
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 2) for z in (0, 3)], float)
    assert hull.area_and_volume(cube, hull.convex_hull(cube)) == pytest.approx((22, 6))
    assert hull.convex_hull(cube[:4]) is None and hull.ring_2d(np.array([[0, 0], [1, 1], [2, 2.0]])) is None
    q = r.rand(150, 2)
    tri = hull.delaunay(q)
    assert sum(hull.ring_area(q[t]) for t in tri) == pytest.approx(hull.ring_area(q[hull.ring_2d(q)]))
    g = np.array([[x, y] for x in range(9) for y in range(9)], float)
    assert hull.alpha_shape(g).measure == pytest.approx(64)
    c = g[~((g[:, 0] > 2) & (g[:, 1] > 2))]  # an L
    assert hull.alpha_shape(c).measure == pytest.approx(28, abs=0.6)


def test_segment_metrics(spark):
    r = np.random.RandomState(10)
    rows = []
    for label, n in ((1, 300), (2, 5), (3, 1), (0, 10), (None, 3)):
        for k in range(n):
            x, y, z = r.rand(3) * [4, 4, 10]
            rows.append((len(rows), float(x), float(y), float(z), float(r.randint(0, 500)), 1 + k % 2, 2, 10, 20, 30, label))
    p = spark.createDataFrame(rows, XYZ + ", intensity double, return_number int, number_of_returns int, red int, green int, blue int, label long")
    m = {x.label: x for x in segments.segment_metrics(p, ["all"]).collect()}
    assert set(m) == {1, 2}  # one point has no hull
    xyz = np.array([x[1:4] for x in rows if x[-1] == 1])
    one = m[1]
    h = (xyz[:, 2] - xyz[:, 2].min()) / np.ptp(xyz[:, 2])
    assert one.NPoints == 300 and one.HMean == pytest.approx(h.mean()) and one.HStdDev == pytest.approx(h.std(ddof=1)) and one.H == pytest.approx(np.ptp(xyz[:, 2]))
    assert [one.PCVar1, one.PCVar2, one.PCVar3] == pytest.approx(np.linalg.eigvalsh(np.cov(xyz.T))[::-1])
    assert np.var(np.array(one.UVW), axis=0, ddof=1) == pytest.approx([one.PCVar1, one.PCVar2, one.PCVar3])
    assert 0 < one.CCH3DVol <= one.CVH3DVol <= 160 and one.CVH2DArea <= 16 and 0 < one.Sphericity < 1.0001 * 6
    assert one.RChroQ50 == pytest.approx(1 / 6) and one.BChroHQ50 == pytest.approx(0.5) and one.FRFrac == 0.5
    few = segments.segment_metrics(p, ["NPoints", "PCVar1"]).collect()
    assert {x.label: x.PCVar1 == 0 for x in few} == {1: False, 2: False, 3: True}
    assert segments.select_metrics(["pointpatternmetrics"], p.columns)[0] == "HMean"
    assert not any(n.startswith("I") and n[1].isupper() for n in segments.select_metrics(["all"], ["x"]))
    with pytest.raises(ValueError):
        segments.select_metrics(["nothing"], p.columns)
    assert segments.segment_metrics(p.limit(0), ["scalar"]).count() == 0


def test_large_segments_are_reduced_to_hull_candidates(spark):
    p = spark.range(30_000).selectExpr("id as pid", "5L as label", "rand(1) x", "rand(2) y", "rand(3) z").withColumns({k: F.lit(0.5) for k in "rgb"})
    few = segments.hull_candidates(p)
    assert few.count() < 5000
    a, b = (np.array([[r.x, r.y, r.z] for r in d.collect()]) for d in (p, few))
    assert hull.area_and_volume(a, hull.convex_hull(a)) == pytest.approx(hull.area_and_volume(b, hull.convex_hull(b)))


def test_tiles(spark):
    a = spark.createDataFrame([(1, 2.0, 5)], "pid long, x double, red int")
    b = spark.createDataFrame([(2, 3.0, 9)], "pid long, x double, blue int")
    m = tiles.merge_points([a, b], source="part")
    assert sorted(map(tuple, m.collect())) == [(1, 2.0, 5, 1), (2, 3.0, 0, 2)] and m.columns == ["pid", "x", "red", "part"]
    with pytest.raises(ValueError):
        tiles.merge_points([])
    rec = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (1, 8, "c")], "part int, record_id int, value string")
    assert [tuple(r) for r in tiles.merge_records(rec).collect()] == [(7, "ab")]
    e = spark.createDataFrame([("in", 2.0, 2.0, 3.0, 3.0), ("around", -9.0, -9.0, 20.0, 20.0), ("cross", -5.0, 4.0, 15.0, 5.0), ("out", 11.0, 11.0, 12.0, 12.0), ("corner", 9.0, 9.0, 30.0, 30.0)], "f string, xmin double, ymin double, xmax double, ymax double")
    assert {r.f for r in tiles.prune(e, [(0, 0), (10, 0), (10, 10), (0, 10)]).collect()} == {"in", "around", "cross", "corner"}
    assert tiles.promoted_format(6) == 7 and tiles.promoted_format(3) == 3
    g = tiles.add_guid(a).first().uuid
    assert len(g) == 32 and int(g, 16) >= 0


def test_large_segments_are_thinned_for_alpha_shapes(spark):
    p = spark.range(60_000).selectExpr("id as pid", "5L as label", "rand(1) x", "rand(2) y", "rand(3) z").withColumns({k: F.lit(0.5) for k in "rgb"})
    few = segments.thinned(p, 1000)
    assert 500 < few.count() < 2000 and set(few.columns) == set(p.columns) and segments.thinned(p, 100_000).count() == 60_000


def test_natural_neighbours():
    from laserloom.geometry.interpolate import fill_natural

    a = np.full((40, 40), np.nan)
    r = np.random.RandomState(11)
    i, j = r.randint(0, 40, (2, 250))
    a[i, j] = 2.0 * i + j
    got = fill_natural(a)
    inner = got[8:32, 8:32] - (2.0 * np.arange(40)[:, None] + np.arange(40))[8:32, 8:32]
    assert not np.isnan(got).any() and np.abs(inner).mean() < 1.0 and (got[i, j] == a[i, j]).all()


def test_outlines(spark):
    p = spark.range(20_000).selectExpr("cast(id % 2 as string) as file", "rand(1) * 100 as x", "rand(2) * 50 as y")
    for d in (hulls.convex_extents(p), hulls.concave_extents(p)):
        for r in d.collect():
            assert 4800 < r.area <= 5000 and r.ring_x[0] == r.ring_x[-1]


def test_stream_of_tiles(spark, small, tmp_path):
    from laserloom.streaming import ingest

    p = spark.read.parquet(f"{small}/points.parquet")
    p.repartition(4).write.parquet(str(tmp_path / "in"))
    ref = grid.grid_over(p, 5.0)
    s = ingest.read_points(spark, str(tmp_path / "in"), p, 1)
    q = ingest.stream_raster(s, ref).writeStream.format("memory").queryName("raster").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = grid.with_cell(p, ref).groupBy("row", "col").agg(F.count("z").alias("n"), F.max("z").alias("high"))
    assert spark.table("raster").select("row", "col", "n", "high").exceptAll(want).count() == 0
    r = ingest.stream_rates(s, late="30 years").writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    r.awaitTermination(120)
    assert spark.table("rates").columns == ["start", "end", "point_source_id", "n"]


def test_nearest_fill_across_wide_gaps_needs_few_cells(spark, monkeypatch):
    """Two corners of an empty grid: the nearest of each cell is found without tiles as wide as the gap."""
    from laserloom.operators.grid import GridRef

    def never(*_, **__):
        raise AssertionError("tiles with a halo of the gap's width")

    monkeypatch.setattr(grid, "tiled", never)
    ref = GridRef(0.0, 0.0, 1.0, -1.0, 700, 900)
    cells = spark.createDataFrame([(1, 1, 5.0), (700, 900, 7.0), (1, 3, 6.0)], "row int, col int, value double")
    got = grid.nearest_fill(cells, ref, whole=True).toPandas()
    assert len(got) == 700 * 900 and not got.duplicated(["row", "col"]).any()
    d = np.stack([np.hypot(got.row - r, got.col - k) for r, k in ((1, 1), (1, 3), (700, 900))])
    assert np.allclose(got.dist, d.min(0)) and (got.value == np.array([5.0, 6.0, 7.0])[d.argmin(0)]).all()
    some = spark.createDataFrame([(350, 2, None), (1, 1, 5.0), (650, 880, None), (700, 900, 7.0)], "row int, col int, value double")
    assert {(x.row, x.col): x.value for x in grid.nearest_fill(some, ref).collect()} == {(350, 2): 5.0, (1, 1): 5.0, (650, 880): 7.0, (700, 900): 7.0}


def test_small_kernels_move_each_cell_about_once(spark, monkeypatch):
    def never(*_):
        raise AssertionError("every cell copied once for each cell of the kernel")

    monkeypatch.setattr(grid, "_scatter", never)
    a = np.random.RandomState(3).rand(9, 140)
    df, ref = dense(spark, a)
    wide = np.pad(a, 1, mode="edge")
    assert np.allclose(back(grid.focal(df, ref, [[1 / 9] * 3] * 3), a.shape), sum(wide[i : i + 9, j : j + 140] for i in range(3) for j in range(3)) / 9)
    none = grid.focal(df.withColumn("value", F.lit(None).cast("double")), ref, [[1 / 9] * 3] * 3)
    assert none.count() == a.size and none.where("value is not null").count() == 0
