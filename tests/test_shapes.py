"""Triangulations and alpha shapes of many sets at once, against one set at a time and against the definition."""

from fractions import Fraction

import numpy as np
import pytest

from laserloom.geometry import hull, shapes
from laserloom.operators import segments


def sets(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of 1 to 120 points to the centimetre, with repeated, flat and coarse ones; and their numbers."""
    r = np.random.RandomState(seed)
    out = [np.round(r.rand(n, 3) * [8, 7, 20], 2) for n in (1, 3, 5, 6, 17, 60, 120)]
    out += [np.repeat(out[4], 2, axis=0), out[5] * [1, 1, 0], np.round(r.rand(80, 3) * 3, 1), np.round(r.rand(40, 3) * [5, 5, 0.01], 3)]
    return np.concatenate(out), np.repeat(np.arange(len(out)), [len(x) for x in out])


@pytest.mark.parametrize("d", [2, 3])
def test_many_alpha_shapes_are_those_of_each_set(d):
    p, group = sets(d)
    p = p[:, :d]
    got = shapes.alpha_shapes(p, group)
    for k, a in enumerate(got):
        at = np.flatnonzero(group == k)
        b = hull.alpha_shape(p[at])
        assert (a is None) == (b is None)
        if a is not None:
            assert (a.alpha, a.measure, a.surface) == pytest.approx((b.alpha, b.measure, b.surface), rel=1e-9)
            assert {tuple(x) for x in np.sort(a.boundary, 1).tolist()} == {tuple(x) for x in np.sort(at[b.boundary], 1).tolist()}


def test_no_point_is_lost_beside_an_outlier_and_no_sphere_holds_a_point():
    p = np.random.RandomState(5).rand(24, 3) * [8, 7, 20]
    p[3, 2] = 98_900.0
    tri, near = shapes.delaunay_many(p, np.zeros(24, int))
    assert set(tri.ravel().tolist()) == set(range(24))
    q = p - p.mean(0)
    q = q / np.abs(q).max() + np.random.RandomState(0).uniform(-1e-7, 1e-7, q.shape)
    f = [[Fraction(float(v)) for v in x] for x in q]

    def det(m):
        return m[0][0] if len(m) == 1 else sum((-1) ** j * m[0][j] * det([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m)))

    inside = 0
    for t in tri.tolist():
        turn = det([[a - b for a, b in zip(f[k], f[t[0]])] for k in t[1:]])
        for k in set(range(24)) - set(t):
            rows = [[*(a - b for a, b in zip(f[i], f[k])), sum((a - b) ** 2 for a, b in zip(f[i], f[k]))] for i in t]
            inside += (det(rows) > 0) == (turn > 0) if turn else 1
    assert inside in (0, len(tri) * 20)  # all on the same side, by the sign's convention
    corners = {tuple(x) for x in np.sort(tri, 1).tolist()}
    assert len(corners) == len(tri) and (near[near >= 0] < len(tri)).all()


def test_sets_that_do_not_fit_together_are_made_one_by_one(monkeypatch):
    p, group = sets(9)
    want = [a and a.measure for a in shapes.alpha_shapes(p, group)]
    init = shapes._Hulls.__init__

    def broken(self, *a):
        init(self, *a)
        self.fail(np.array([1, 3]))

    monkeypatch.setattr(shapes._Hulls, "__init__", broken)
    assert [a and a.measure for a in shapes.alpha_shapes(p, group)] == pytest.approx(want)


def test_alpha_shapes_of_large_segments_are_of_all_their_points(spark):
    r = np.random.RandomState(2)
    p = np.concatenate([r.rand(21_000, 3) * [8, 8, 20], r.rand(90, 3) * 5])
    group = np.repeat([0, 1], [21_000, 90])
    d = spark.createDataFrame([(i, int(g) + 7, *map(float, x)) for i, (g, x) in enumerate(zip(group, p))], "pid long, label long, x double, y double, z double")
    got = {x.label: x for x in segments.segment_metrics(d, ["CCH2DArea", "CCH3DArea", "CCH3DVol", "CCH3DRa", "CVH3DLac"]).collect()}
    flat, solid = shapes.alpha_shapes(p[:, :2], group), shapes.alpha_shapes(p, group)
    for k, n in ((0, 21_000), (1, 90)):
        x = got[k + 7]
        assert (x.CCH2DArea, x.CCH3DArea, x.CCH3DVol, x.CCH3DRa) == pytest.approx((flat[k].measure, solid[k].surface, solid[k].measure, len(solid[k].boundary) / n), rel=1e-6)
        assert 0 < x.CVH3DLac < 1


def test_segments_stay_whole_over_batches():
    import pandas as pd

    p, group = sets(4)
    d = pd.DataFrame({"label": group, "pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
    cols = ["CCH2D", "CCH3DVol", "CVH2DArea"]
    one = pd.concat(segments._kernel(cols, False, 0.0)(iter([d])), ignore_index=True)
    many = pd.concat(segments._kernel(cols, False, 0.0, batch=30)(d[i : i + 7] for i in range(0, len(d), 7)), ignore_index=True)
    assert one["label"].tolist() == many["label"].tolist() == list(range(11)) and one["CCH2D"].tolist() == many["CCH2D"].tolist()
    for c in cols[1:]:
        assert one[c].isna().tolist() == many[c].isna().tolist() and one[c].dropna().tolist() == pytest.approx(many[c].dropna().tolist())


def test_many_sets_take_far_less_time_than_one_by_one():
    import time

    r = np.random.RandomState(6)
    p, group = r.rand(150 * 50, 3) * [8, 8, 20], np.repeat(np.arange(150), 50)
    began = time.process_time()
    many = segments.shapes_of_many(group, np.arange(len(p)), p, None, {"CCH3DVol", "CVH3DVol"})
    took = time.process_time() - began
    began = time.process_time()
    one = [hull.alpha_shape(p[group == k]).measure for k in range(150)]
    assert took < (time.process_time() - began) / 2
    assert [m["CCH3DVol"] for m in many] == pytest.approx(one)
    assert all(m["CVH3DVol"] >= m["CCH3DVol"] for m in many)


def test_convex_hull_of_more_points_than_it_looks_ahead():
    p = np.round(np.random.RandomState(7).rand(2000, 3) * [4, 5, 6], 1)
    h = hull.convex_hull(p)
    assert (p @ h.normals.T <= h.offsets + 1e-6).all() and len(h.facets) == 2 * len(h.vertices) - 4
    assert hull.area_and_volume(p, h)[1] == pytest.approx(120, rel=0.05)


def test_no_metric_thins_its_segments(spark, monkeypatch):
    def never(*_):
        raise AssertionError("metrics of a part of the points")

    monkeypatch.setattr(segments, "thinned", never)
    p, group = sets(11)
    n = np.arange(len(p))
    rows = [(int(i), int(g) + 1, *map(float, x), float(i % 50), int(i % 2) + 1, 2, int(i % 7) + 1, 5, int(i % 3)) for i, g, x in zip(n, group, p)]
    d = spark.createDataFrame(rows, "pid long, label long, x double, y double, z double, intensity double, return_number int, number_of_returns int, red int, green int, blue int")
    got = {x.label: x for x in segments.segment_metrics(d, ["scalar"]).collect()}
    want = shapes.alpha_shapes(p, group)
    assert {5, 6, 7} <= set(got)  # sets of 17, 60 and 120 points
    for k, x in got.items():
        assert x.NPoints == (group == k - 1).sum() and x.CCH3DVol == pytest.approx(want[k - 1].measure) and x.CCH3DRa == pytest.approx(len(want[k - 1].boundary) / x.NPoints)


def test_only_the_shapes_asked_for_are_listed():
    p, _ = sets(12)
    p = p[16:200]
    few = segments.shapes_of(np.arange(len(p)), p, None, {"CVH3DVol", "CCH3DVol"})
    assert not {"CVH3D", "CCH3D", "CCH2D"} & set(few) and few["CVH3DVol"] > few["CCH3DVol"] > 0
    all_ = segments.shapes_of(np.arange(len(p)), p, None, {"CVH3D", "CCH3D", "CVH3DVol", "CCH3DVol"})
    assert len(all_["CVH3D"]) == all_["__cvh3d_facets"] and len(all_["CCH3D"]) == all_["__cch3d_facets"]
