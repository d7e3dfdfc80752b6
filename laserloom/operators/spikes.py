"""Readings that a source cannot have measured: spikes, stuck values and impossible values.

The readings of a source (in order of time) are laid out as profiles: rows of a matrix with a fixed
number of readings each, the counterpart of daily profiles for sources that live seconds, not
months. Robust principal components split the matrix into a low-rank part (level, trend and shape
common to the profiles: the normal behaviour of the source) and a sparse part. The sparse part decides: a
reading is a case if its own is large, in its field's unit and by the mean sparse part of its whole source. What
recurs in every profile is normal, however far it stands out; a climb is a trend. A check then passes over
readings that agree with the clean ones before or after them (the edge of a lasting change of level, which no
low rank holds). Constant runs and impossible values are tested separately and never serve as normal readings.

Work is split by source and time bucket, with rows near an edge repeated in the neighbouring bucket,
so a source with a third of all rows spreads over the cluster; a bucket is read in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laserloom.operators.streams import groups
from laserloom.session import materialise

# kinds of rows: a case, a suspect with its sparse part, sum and count of sparse parts, an equal stretch with its length, a
# reading of such a stretch, a least or greatest possible value; bucket, piece and place tell where a stretch begins
_CASE, _SUSPECT, _SCALE, _STRETCH, _READING, _RANGE = range(6)
_ARROW = pa.schema([("kind", pa.int32()), ("field", pa.string()), ("source", pa.int64()), ("rec_id", pa.int64()), ("value", pa.float64()), ("n", pa.int64()), ("bucket", pa.int64()), ("piece", pa.int64()), ("place", pa.int64()), ("ends", pa.bool_())])


@dataclass(frozen=True)
class Rule:
    """How one field is judged.

    possible: lowest and highest value that can be measured; floor: the least sparse part that counts,
    in units of the field, or in octaves if log; down: the same for readings below the normal behaviour, if another;
    scale: if set, a sparse part must also be so many times the mean one of the whole source; k: the check's
    distance from the clean readings on either side, in robust standard deviations of these; context: clean
    readings taken on either side; profile: readings in a row of the matrix; run: equal readings that
    make a stuck value; drift: change per second that a gap in the readings may hide."""

    field: str
    possible: tuple[float, float]
    floor: float
    k: float = 3.0
    log: bool = False
    down: float = 0.0
    context: int = 32
    profile: int = 128
    run: int = 8
    drift: float = 0.0
    scale: float = 0.0


#: Returns: heights vary by relief and canopy, on each line by its own measure; brightness varies by factors, and
#: farther down (a dark target sends back a tenth) than up.
Z = Rule("z", (-500.0, 9000.0), floor=5.0, scale=10.3)
INTENSITY = Rule("intensity", (0.0, np.inf), floor=2.5, down=4.0, log=True)
#: The sensor climbs, but smoothly.
ALTITUDE = Rule("altitude", (-500.0, 20000.0), floor=7.5, context=15, profile=32, drift=6.0)
#: Heavy departures from a profile's median are cut to so many robust standard deviations before the split.
CUT = 50.0


def principal(m: np.ndarray, steps: int = 25) -> np.ndarray:
    """The low-rank part of m by principal component pursuit (inexact augmented Lagrangian).

    The singular values come from the smaller Gram matrix."""
    rows, cols = m.shape
    lam = 1.0 / np.sqrt(max(rows, cols))
    norm = np.linalg.norm(m)
    if norm == 0:
        return m.copy()
    top = np.sqrt(max(np.linalg.eigvalsh(m @ m.T if rows <= cols else m.T @ m)[-1], 1e-300))
    y = m / max(top, np.abs(m).max() / lam)
    mu = 1.25 / top
    s = np.zeros_like(m)
    low = m
    for _ in range(steps):
        a = m - s + y / mu
        if rows <= cols:
            w, u = np.linalg.eigh(a @ a.T)
            sv = np.sqrt(np.maximum(w, 0))
            keep = sv > 1.0 / mu
            uk = u[:, keep]
            low = (uk * (1 - 1.0 / (mu * sv[keep]))) @ (uk.T @ a)
        else:
            w, v = np.linalg.eigh(a.T @ a)
            sv = np.sqrt(np.maximum(w, 0))
            keep = sv > 1.0 / mu
            vk = v[:, keep]
            low = (a @ vk) @ (vk * (1 - 1.0 / (mu * sv[keep]))).T
        b = m - low + y / mu
        s = np.sign(b) * np.maximum(np.abs(b) - lam / mu, 0)
        gap = m - low - s
        y = y + mu * gap
        mu *= 1.5
        if np.linalg.norm(gap) < 1e-3 * norm:
            break
    return low


def runs(v: np.ndarray, least: int) -> np.ndarray:
    """Which readings belong to a run of at least `least` equal ones."""
    if not len(v):
        return np.zeros(0, bool)
    cut = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
    length = np.diff(cut)
    return np.repeat(length >= least, length)


def stretches(v: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of the equal stretches of v that have at least `least` readings or touch one of its ends."""
    if not len(v):
        return []
    cut = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v)).tolist()
    return [(i, j) for i, j in zip(cut[:-1], cut[1:]) if j - i >= least or not i or j == len(v)]


def possible(v: np.ndarray, rule: Rule) -> np.ndarray:
    return (v >= rule.possible[0]) & (v <= rule.possible[1])


def sparse_part(v: np.ndarray, usable: np.ndarray, rule: Rule) -> np.ndarray:
    """What the low-rank part of the profiles leaves of each reading, in units of v. v: readings in order; unusable
    ones are filled for the matrix."""
    n, width = len(v), min(rule.profile, len(v))
    rows = -(-n // width)
    mid = np.median(v[usable])
    m = np.full(rows * width, np.nan)
    m[:n] = np.where(usable, v, np.nan)
    m = m.reshape(rows, width)
    level = np.nanmedian(np.where(np.isnan(m).all(1, keepdims=True), mid, m), axis=1, keepdims=True)
    scale = max(1.4826 * np.nanmedian(np.abs(m - level)), rule.floor / 50, 1e-12)
    x, own = (np.where(np.isnan(m), level, m) - mid) / scale, (level - mid) / scale
    low = principal(own + np.clip(x - own, -CUT, CUT))
    return ((x - low) * scale).ravel()[:n]


@dataclass
class Findings:
    """sure: cases whatever the rest of the source looks like (without runs, which are counted on the whole source);
    suspects (positions) with their sparse parts count if these are large by the measure of the whole source, to which
    total and count of sparse parts go."""

    sure: np.ndarray
    suspects: np.ndarray
    parts: np.ndarray
    total: float
    count: int


def examine(values: np.ndarray, rule: Rule, seconds: np.ndarray | None = None, own: np.ndarray | None = None) -> Findings:
    """Judge the readings of a stretch of one source, given in order, without nulls. own: those whose sparse parts
    are added up here (the others are added up elsewhere)."""
    sure = ~possible(values, rule)
    rest = ~sure & ~runs(values, rule.run)
    v = np.log2(np.maximum(values, 0) + 0.5) if rule.log else values.astype(float)
    v = np.where(rest, v, 0.0)
    t = np.zeros(len(v)) if seconds is None else seconds
    own = np.ones(len(v), bool) if own is None else own
    far: dict[int, float] = {}
    total, count = 0.0, 0
    if rest.sum() < 2 * rule.run:
        far = _few(v, t, rest, rule)
        kept = rest.copy()
        kept[list(far)] = False
        if kept.any():
            off = np.abs(v - np.median(v[kept]))
            total, count = float(off[kept & own].sum()), int((kept & own).sum())
    for _ in range(3):  # again without the cases found, as a burst may hide some of its own
        if rest.sum() < 2 * rule.run:
            break
        part = sparse_part(v, rest, rule)
        size = np.abs(part)
        mean = size[rest].mean()
        total, count = float(size[rest & own].sum()), int((rest & own).sum())
        if rule.down:
            size = np.where(part < 0, size * (rule.floor / rule.down), size)
        least = max(rule.floor, 0.4 * rule.scale * mean)
        hit = _alone(v, t, rest, rest & (size >= least), part, 0.5 * least, rule)
        far.update(zip(hit.tolist(), size[hit].tolist()))
        gone = hit[size[hit] >= max(rule.floor, rule.scale * mean)]
        if not len(gone):
            break
        rest[gone] = False
    pos = np.array(sorted(far), np.int64)
    by = np.array([far[k] for k in pos.tolist()], float)
    if not rule.scale:
        sure[pos] = True
        pos, by = pos[:0], by[:0]
    return Findings(sure, pos, by, total, count)


def faults(values: np.ndarray, rule: Rule, seconds: np.ndarray | None = None) -> np.ndarray:
    """The cases among the readings of a whole source, given in order, without nulls."""
    values = np.asarray(values, float)
    f = examine(values, rule, seconds)
    out = f.sure.copy()
    w = values[possible(values, rule)]
    if len(w) and w.min() < w.max():  # a run counts where the source's values vary
        out |= runs(values, rule.run)
    if f.count:
        out[f.suspects[f.parts >= max(rule.floor, rule.scale * f.total / f.count)]] = True
    return out


def _few(v: np.ndarray, t: np.ndarray, rest: np.ndarray, rule: Rule) -> dict[int, float]:
    """Departures (by position) where there are too few readings for profiles: each is held against the median of the
    up to five on either side of it, of which at least three in all."""
    near = replace(rule, context=5, run=3)
    far: dict[int, float] = {}
    for k in np.flatnonzero(rest):
        cand = np.arange(len(v)) == k
        for way, floor in ((1.0, rule.floor), (-1.0, rule.down or rule.floor)):
            hit, by = _departures(v, t, rest, cand, np.array([way]), near, few=1)
            if len(hit) and by[0] >= floor:
                far[int(k)] = float(by[0]) * rule.floor / floor
    return far


def _alone(v: np.ndarray, t: np.ndarray, rest: np.ndarray, cand: np.ndarray, part: np.ndarray, least: float, rule: Rule) -> np.ndarray:
    """Candidates (positions) that agree with neither side, being off both by `least` at least."""
    hit, by = _departures(v, t, rest, cand, np.sign(part[cand]), rule)
    return hit[by >= least]


def _departures(v: np.ndarray, t: np.ndarray, rest: np.ndarray, cand: np.ndarray, way: np.ndarray, rule: Rule, few: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (positions) that lie off the clean readings on both sides by more than these vary, and by how much; way:
    the side on which each must lie (1 above, -1 below). A side with less than `few` clean readings says nothing."""
    clean, which = np.flatnonzero(rest & ~cand), np.flatnonzero(cand)
    if not len(which) or len(clean) < rule.run:
        return which[:0], np.zeros(0)
    at = np.searchsorted(clean, which)
    offs = np.arange(rule.context)
    near, when = v[clean], t[clean]

    def side(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Median and spread of the clean readings on one side (on their trend, if the field drifts), and what the
        time to them allows."""
        ok = (pos >= 0) & (pos < len(clean))
        held = np.clip(pos, 0, len(clean) - 1)
        w = np.where(ok, near[held], np.nan)
        none = ok.sum(1) < few
        w[none, :] = 0.0
        slack = rule.drift * np.abs(when[held[:, 0]] - t[which])
        if rule.drift and w.shape[1] > 7:
            half = w.shape[1] // 2
            ago = np.where(ok | none[:, None], when[held], np.nan) - t[which][:, None]
            enough = ok[:, half:].sum(1) >= few
            far = np.where(enough[:, None], w[:, half:], 0.0)
            with np.errstate(all="ignore"):
                gap = np.nanmedian(ago[:, :half], axis=1) - np.nanmedian(np.where(enough[:, None], ago[:, half:], 0.0), axis=1)
                slope = np.where(enough & (np.abs(gap) > 1e-9), (np.nanmedian(w[:, :half], axis=1) - np.nanmedian(far, axis=1)) / gap, 0.0)
            w = w - np.clip(slope, -rule.drift, rule.drift)[:, None] * ago
        med = np.nanmedian(w, axis=1)
        dev = np.nanmedian(np.abs(w - med[:, None]), axis=1)
        med[none], dev[none], slack[none] = np.nan, np.nan, 0.0
        return med, dev, slack

    lm, ld, ls = side(at[:, None] - 1 - offs)
    rm, rd, rs = side(at[:, None] + offs)
    x = v[which]
    left = np.isnan(rm) | (ls <= rs) & ~np.isnan(lm)  # the side nearer in time
    mid, slack = np.where(left, lm, rm), np.where(left, ls, rs)
    above = np.fmin(x - np.fmax(lm, rm), x - mid - slack)
    below = np.fmin(np.fmin(lm, rm) - x, mid - slack - x)
    beyond = np.where(way > 0, above, below)
    far = beyond > rule.k * 1.4826 * np.fmax(ld, rd)
    return which[far], beyond[far]


def flag(
    df: DataFrame,
    *,
    row_id: str,
    source: str,
    time: str,
    rules: tuple[Rule, ...],
    tie: tuple[str, ...] = (),
    bucket: float = 30.0,
    halo: float = 2.0,
    most: int = 200_000,
) -> DataFrame:
    """(field, rec_id) of every reading that is a case under its rule.

    df's rows with null row_id, source or time (NaN counts as null) take no part; null and NaN readings
    are passed over. Exact duplicates count once; ties in time are ordered by `tie`, then row_id. A
    stretch with fewer than 2 * run readings within reach has no profiles: there each reading is held against those
    next to it; fewer than four within reach are tested for impossible values and runs only.
    Empty tables give no rows. Columns that are not named here are not read. bucket and halo are seconds;
    one large shuffle, of the named columns only. What is found goes to the shared folder: runs are put together
    over the whole source, whatever buckets they reach through, and rules with a scale are held against the mean
    sparse part of each whole source.
    """
    fields = [r.field for r in rules]
    t, lit = F.col("__t"), F.lit
    num = [F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(fields)]
    ties = [F.col(c).cast("double").alias(f"__o{i}") for i, c in enumerate(tie)]
    base = df.select(F.col(row_id).cast("long").alias("__id"), F.col(source).cast("long").alias("__s"), F.col(time).cast("double").alias("__t"), *ties, *num)
    base = base.where("__id is not null and __s is not null and __t is not null and not isnan(__t)")
    own: Column = F.floor(t / lit(bucket))
    near = F.array_distinct(F.array(own, F.floor((t - lit(halo)) / lit(bucket)), F.floor((t + lit(halo)) / lit(bucket))))
    rows = base.select("*", F.explode(near).alias("__b")).withColumn("__own", F.col("__b") == F.floor(t / lit(bucket)))
    order = ["__s", "__b", "__t", *[f"__o{i}" for i in range(len(tie))], "__id"]
    rows = rows.repartition("__s", "__b").sortWithinPartitions(*order)
    overlap = 4 * max(r.profile for r in rules)
    schema = "kind int, field string, source long, rec_id long, value double, n long, bucket long, piece long, place long, ends boolean"
    names = _ARROW.names

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, piece = None, 0
        for table, first, last in groups(batches, ("__s", "__b"), most, overlap):
            col = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            ids, mine, when, source = col("__id"), col("__own").copy(), col("__t"), int(table.column("__s")[0].as_py())
            now = source, int(table.column("__b")[0].as_py())
            group, piece = now, piece + 1 if now == group else 0
            mine[:first], mine[last:] = False, False
            if not mine.any():
                continue
            once = np.append(True, ids[1:] != ids[:-1])
            rows: list[tuple] = []
            for i, rule in enumerate(rules):
                v = table.column(f"__f{i}").to_numpy()
                sel = np.flatnonzero(once & ~np.isnan(v))
                if not len(sel):
                    continue
                f = examine(v[sel], rule, when[sel], mine[sel])
                hit = sel[f.sure]
                none = (None, None, None, None)
                rows += [(_CASE, rule.field, source, int(k), 0.0, 0, *none) for k in ids[hit[mine[hit]]]]
                if rule.scale:
                    rows += [(_SUSPECT, rule.field, source, int(ids[k]), float(d), 0, *none) for k, d in zip(sel[f.suspects], f.parts) if mine[k]]
                    rows.append((_SCALE, rule.field, source, None, f.total, f.count, *none))
                sel = sel[mine[sel]]
                w = v[sel]
                for i, j in stretches(w, rule.run):
                    rows.append((_STRETCH, rule.field, source, None, float(w[i]), j - i, now[1], piece, i, j == len(w)))
                    rows += [(_READING, rule.field, source, int(k), 0.0, 0, now[1], piece, i, None) for k in ids[sel[i:j]]]
                w = w[possible(w, rule)]
                if len(w):
                    rows += [(_RANGE, rule.field, source, None, float(x), 0, *none) for x in (w.min(), w.max())]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=_ARROW)

    # a small table: cases, suspects, the equal stretches at the ends of each bucket, and a few rows per bucket
    found = materialise(rows.mapInArrow(judge, schema), "spikes")
    of = lambda kind: found.where(F.col("kind") == kind)
    out = of(_CASE).select("field", "rec_id").unionByName(_runs(of, rules))
    relative = {r.field: r for r in rules if r.scale}
    if relative:  # suspects are held against their whole source
        scale = of(_SCALE).groupBy("field", "source").agg(F.try_divide(F.sum("value"), F.sum("n")).alias("mean"))
        least = F.coalesce(*[F.when(F.col("field") == f, F.greatest(F.lit(r.floor), F.lit(r.scale) * F.col("mean"))) for f, r in relative.items()])
        far = of(_SUSPECT).join(scale, ["field", "source"]).where(F.col("value") >= least)
        out = out.unionByName(far.select("field", "rec_id"))
    return out.distinct()


def _runs(of: Callable[[int], DataFrame], rules: tuple[Rule, ...]) -> DataFrame:
    """field, rec_id of the readings in runs: stretches that meet at the ends of buckets and pieces are put together, and
    their whole length counts, if the source's possible values vary."""
    along = Window.partitionBy("field", "source").orderBy("bucket", "piece", "place")
    before = lambda c: F.lag(c).over(along)
    s = of(_STRETCH).withColumn("goes_on", F.coalesce((F.col("place") == 0) & before("ends") & (before("value") == F.col("value")), F.lit(False)))
    s = s.withColumn("run", F.sum((~F.col("goes_on")).cast("long")).over(along))
    s = s.withColumn("length", F.sum("n").over(Window.partitionBy("field", "source", "run")))
    least = F.coalesce(*[F.when(F.col("field") == r.field, F.lit(r.run)) for r in rules])
    key = ["field", "source", "bucket", "piece", "place"]
    vary = of(_RANGE).groupBy("field", "source").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select("field", "source")
    long = s.where(F.col("length") >= least).select(*key).join(vary, ["field", "source"], "left_semi")
    return of(_READING).join(long, key, "left_semi").select("field", "rec_id")


def implausible_readings(points: DataFrame, sbet: DataFrame) -> DataFrame:
    """tbl, field, rec_id of the faulty readings of returns and trajectory."""
    a = flag(points, row_id="pid", source="point_source_id", time="gps_time", rules=(Z, INTENSITY), tie=("return_number",))
    b = flag(sbet, row_id="rec_id", source="point_source_id", time="gps_time", rules=(ALTITUDE,), bucket=120.0, halo=10.0)
    return a.select(F.lit("points").alias("tbl"), "field", "rec_id").unionByName(b.select(F.lit("sbet").alias("tbl"), "field", "rec_id"))
