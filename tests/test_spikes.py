import numpy as np
import pyarrow as pa
import pytest

from laserloom.operators import spikes
from laserloom.operators.streams import groups


def line(n=1000, seed=0):
    r = np.random.RandomState(seed)
    return 1000 + 5 * np.sin(np.arange(n) / 100) + r.rand(n) * 25 * (r.rand(n) < 0.6)


def found(v, rule=spikes.Z, t=None):
    return set(np.flatnonzero(spikes.faults(np.asarray(v, float), rule, t)).tolist())


def test_spikes_and_bursts():
    v = line()
    v[[100, 400]] += [150, -90]
    v[600:618] -= np.linspace(80, 300, 18)
    v[800] = 99999
    assert found(v) == {100, 400, 800, *range(600, 618)}


def test_normal_behaviour_is_no_case():
    assert found(line()) == set()
    v = line()
    v[500:] += 900  # relief
    assert found(v) == set()


def test_each_line_has_its_own_measure():
    r = np.random.RandomState(8)
    flat = 1000 + r.rand(2000) * 3 * (r.rand(2000) < 0.6)
    flat[[50, 900]] += [20, -25]
    flat, tall = flat + r.rand(2000) * 0.05, 1000 + r.rand(2000) * 0.05 + r.rand(2000) * 34 * (r.rand(2000) < 0.5)
    tall[700] += 150
    assert found(flat) == {50, 900} and found(tall) == {700}


def test_a_quiet_stretch_is_judged_by_its_whole_line(spark):
    r = np.random.RandomState(9)
    v = 1000 + r.rand(6000) * 0.05 + np.where(np.arange(6000) < 3000, r.rand(6000) * 0.4, r.rand(6000) * 30 * (r.rand(6000) < 0.5))
    v[1000] += 25  # a lone tree on the quiet stretch
    v[1500] += 120
    d = spark.createDataFrame([(i, 1, i * 0.02, float(x)) for i, x in enumerate(v)], "id long, line int, t double, z double")
    got = spikes.flag(d, row_id="id", source="line", time="t", rules=(spikes.Z,), bucket=10.0)
    assert {r.rec_id for r in got.collect()} == {1500}


def test_level_changes_and_bright_targets():
    r = np.random.RandomState(1)
    v = np.round(np.exp(r.randn(2000) * 0.4) * 600)
    v[1000:] *= 2.2
    v[50] = 60  # dark
    v[90] = 3  # no target is so dark
    v[60] = 600 * 4  # bright
    v[[500, 1500]] = [600 * 15, 1320 * 20]
    v[70] = -1
    assert found(v, spikes.INTENSITY) == {500, 1500, 70, 90}


def test_runs():
    v = line()
    v[300:308] = v[300]
    v[500:507] = v[500]  # too short
    assert found(v) == set(range(300, 308))
    assert found(np.full(50, 7.0)) == set()  # a source that never varies
    assert found([5.0] * 3) == set() and found([]) == set() and found([-9999.0]) == {0}


@pytest.mark.parametrize("most", [200_000, 60])
def test_runs_are_counted_on_the_whole_line(spark, most):
    n, r = 3000, np.random.RandomState(6)
    v = line(n, 6)
    v[400:1900] = v[400]  # stuck through whole buckets of 350 readings
    t = np.arange(n) * 0.02
    v[2446:2454] = v[2446]  # eight, four of them on either side of a bucket's end and a gap beyond the halo
    t[2450:] += 5 * 7.0
    v[2796:2803] = v[2796]  # seven across the next end
    rows = [(i, 1, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))]
    rows += [(10_000 + i, 2, i * 0.02, 7.0) for i in range(1000)]  # a line that never varies
    d = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "id long, line int, t double, z double")
    got = {x.rec_id for x in spikes.flag(d, row_id="id", source="line", time="t", rules=(spikes.Z,), bucket=7.0, most=most).collect()}
    assert got == {*range(400, 1900), *range(2446, 2454)}


def test_climbs_and_gaps():
    t = np.sort(np.concatenate([np.arange(0, 60, 0.1), np.arange(66, 90, 0.1)]))
    v = 2000 + 2.5 * t + np.random.RandomState(2).randn(len(t)) * 0.05
    assert found(v, spikes.ALTITUDE, t) == set()
    v[[10, 300, len(v) - 3]] += [12, -15, 30]
    assert found(v, spikes.ALTITUDE, t) == {10, 300, len(v) - 3}


def test_short_lines():
    r = np.random.RandomState(7)
    t = np.arange(12.0)
    v = 2000 + 2.5 * t + r.randn(12) * 0.05
    assert found(v, spikes.ALTITUDE, t) == set()
    for k in (0, 5, 11):
        w = v.copy()
        w[k] += 40
        assert found(w, spikes.ALTITUDE, t) == {k}
        assert found(w[max(k - 3, 0) : k + 4], spikes.ALTITUDE, t[max(k - 3, 0) : k + 4]) == {min(k, 3)}
    w = v + np.where(t < 6, 0, 300)  # a lasting change of level
    assert found(w, spikes.ALTITUDE, t) == set()
    assert found([600, 700, 500, 9000, 650, 620, 580], spikes.INTENSITY) == {3} and found([600, 700, 500, 60, 650, 620, 580], spikes.INTENSITY) == set()
    assert found([1000, 1000.4, 1300, 1000.2, 1000.1, 1000.3]) == {2} and found([2000.0, 2500.0, 2100.0], spikes.ALTITUDE) == set()


def recurring(n=12_800, seed=10):
    """Every profile of 128 readings has the same tower in it, and two readings stand out elsewhere."""
    r = np.random.RandomState(seed)
    v = 1000 + r.randn(n) * 0.3
    v[np.arange(40, n, 128)] += 12
    v[[5000, 9001]] += [12, -12]
    return v


def medians(m, steps=0):
    return np.broadcast_to(np.median(m, axis=1, keepdims=True), m.shape).copy()


def test_what_recurs_in_every_profile_is_normal(monkeypatch):
    assert found(recurring()) == {5000, 9001}
    monkeypatch.setattr(spikes, "principal", medians)  # each profile's own median knows no shape
    assert found(recurring()) > {5000, 9001}


def test_the_low_rank_part_holds_climbs(monkeypatch):
    r = np.random.RandomState(11)
    t = np.arange(3200) * 0.5
    v = 2000 + 3.0 * t + r.randn(3200) * 0.05  # 48 m within a profile
    v[[100, 2000]] += [9, -9]
    part = spikes.sparse_part(v, np.ones(3200, bool), spikes.ALTITUDE)
    assert set(np.flatnonzero(np.abs(part) >= spikes.ALTITUDE.floor)) == {100, 2000} == found(v, spikes.ALTITUDE, t)
    monkeypatch.setattr(spikes, "principal", medians)
    assert (np.abs(spikes.sparse_part(v, np.ones(3200, bool), spikes.ALTITUDE)) >= spikes.ALTITUDE.floor).sum() > 1000


def test_a_long_stuck_run_of_altitudes(spark):
    n, r = 60_000, np.random.RandomState(12)
    v = 2000 + 20 * np.sin(np.arange(n) / 3000) + r.randn(n) * 0.05
    v[20_000:44_000] = 2003.25  # 480 s
    d = spark.createDataFrame([(i, 1, i * 0.02, float(x)) for i, x in enumerate(v)], "rec_id long, line int, t double, altitude double")
    got = spikes.flag(d, row_id="rec_id", source="line", time="t", rules=(spikes.ALTITUDE,), bucket=120.0, halo=10.0)
    assert {x.rec_id for x in got.collect()} == set(range(20_000, 44_000))


def test_principal_splits_low_rank_and_sparse():
    r = np.random.RandomState(3)
    low = np.outer(r.randn(60), r.randn(40))
    s = np.zeros((60, 40))
    s[r.rand(60, 40) < 0.05] = 20
    got = spikes.principal(low + s)
    assert np.abs(got - low).max() < 1.0 and np.abs(got - low).mean() < 0.05


def test_groups_in_pieces_judge_each_row_once():
    n = 1000
    t = pa.table({"a": np.repeat([1, 1, 2], [600, 300, 100]), "b": np.repeat([1, 2, 2], [600, 300, 100]), "i": np.arange(n)})
    own = []
    for piece, first, last in groups(t.to_batches(max_chunksize=37), ("a", "b"), 100, 20):
        ids = piece.column("i").to_numpy()
        assert len(ids) <= 100 + 40 + 37 and len(set(zip(piece.column("a").to_numpy(), piece.column("b").to_numpy()))) == 1
        own += ids[first:last].tolist()
    assert own == list(range(n))


@pytest.mark.parametrize("hot", [False, True])
def test_flag(spark, hot):
    n = 3000
    v, w = line(n, 4), line(n, 5)
    v[[7, 1500, 2999]] += 200
    rows = [(i, 1 if hot or i % 2 else 1, i * 0.02, float(v[i])) for i in range(n)]
    rows += [(10_000 + i, 2, i * 0.02, float(w[i])) for i in range(n)]
    rows += [rows[7], (50_000, None, 1.0, 9e9), (50_001, 1, None, 9e9), (50_002, 1, 3.0, None), (50_003, 1, float("nan"), 1.0), (None, 1, 2.0, 9e9), (50_004, 3, 5.0, -9999.0)]
    d = spark.createDataFrame(rows, "id long, line int, t double, z double").withColumnsRenamed({}).selectExpr("*", "1 as field", "2 as __t")
    kw = {"row_id": "id", "source": "line", "time": "t", "rules": (spikes.Z,), "bucket": 7.0}
    got = {tuple(r) for r in spikes.flag(d, **kw).collect()}
    assert got == {("z", 7), ("z", 1500), ("z", 2999), ("z", 50_004)}
    assert {tuple(r) for r in spikes.flag(d, **kw, most=100).collect()} >= got - {("z", 50_004)}
    assert spikes.flag(d.limit(0), **kw).count() == 0


def test_found_on_data(spark, small):
    from laserloom.plans.queries import QUERIES

    got = QUERIES["p2_found"](spark, small)
    assert got.columns == ["tbl", "field", "rec_id"] and 0 < got.count() == got.distinct().count()
