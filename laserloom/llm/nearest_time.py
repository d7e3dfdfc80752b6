"""The record nearest in time, for the same entity and within a tolerance.

A stateful join in event time. Both sides are buffered for each entity; once the watermark has passed a
left row's time by more than the tolerance, no nearer right row can come, and the row is emitted with its
nearest candidate; right rows that no pending or future left row can reach are evicted. The buffer thus
holds about two tolerances of data, whatever the length of the stream.

`Buffer` is that operator for one entity. `stream_nearest` runs it in Structured Streaming. Stored tables are
replayed in order of event time (`nearest_time`): the rows are spread by entity and time bucket, right rows
within reach of the next bucket are repeated there, each partition is sorted by time, and each Arrow batch
moves the watermark on. As the replay is in order, no row is late, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = np.iinfo(np.int64).max


class Buffer:
    """Pending left rows and candidate right rows of one entity, times in whole units (LONG)."""

    def __init__(self, tolerance: int, state: tuple | None = None):
        self.tol = tolerance
        none = np.zeros(0, np.int64)
        self.lt, self.li, self.rt, self.ri = state or (none, none, none, none)

    def state(self) -> tuple:
        return self.lt, self.li, self.rt, self.ri

    def add(self, lt: np.ndarray, li: np.ndarray, rt: np.ndarray, ri: np.ndarray) -> None:
        if len(lt):
            self.lt, self.li = np.append(self.lt, lt), np.append(self.li, li)
        if len(rt):
            t, i = np.append(self.rt, rt), np.append(self.ri, ri)
            o = np.lexsort((i, t))
            self.rt, self.ri = t[o], i[o]

    def advance(self, watermark: int) -> tuple[np.ndarray, np.ndarray]:
        """(left id, right id) of the left rows that are due and have a partner; due rows leave."""
        due = self.lt < watermark - self.tol if watermark < END else np.ones(len(self.lt), bool)
        t, i = self.lt[due], self.li[due]
        self.lt, self.li = self.lt[~due], self.li[~due]
        got = i[:0], i[:0]
        if len(t) and len(self.rt):
            # first of equal times, so that the smallest id of equals is taken
            at = np.searchsorted(self.rt, t, side="left")
            right = np.minimum(at, len(self.rt) - 1)
            left = np.searchsorted(self.rt, self.rt[np.maximum(at - 1, 0)], side="left")
            dl = np.where(at > 0, t - self.rt[left], END)
            dr = np.where(at < len(self.rt), self.rt[right] - t, END)
            best, d = np.where(dl <= dr, left, right), np.minimum(dl, dr)
            ok = d <= self.tol
            got = i[ok], self.ri[best[ok]]
        if watermark == END:
            keep = slice(0, 0)
        else:
            oldest = min(int(self.lt.min()) if len(self.lt) else END, watermark)
            keep = slice(int(np.searchsorted(self.rt, oldest - self.tol, side="left")), None)
        self.rt, self.ri = self.rt[keep], self.ri[keep]
        return got


def _sides(left: DataFrame, right: DataFrame, by: tuple[str, str], times: tuple[str, str], ids: tuple[str, str], unit: float, tol: int, bucket: int) -> DataFrame:
    """Both sides as (__e, __b, __t, __s, __i), right rows in every bucket that they can reach."""

    def side(df: DataFrame, k: int) -> DataFrame:
        t = F.col(times[k])
        whole = F.when(~F.isnan(t), F.round(t / F.lit(unit)).cast("long")) if dict(df.dtypes)[times[k]] in ("double", "float") else t.cast("long")
        d = df.select(F.col(by[k]).alias("__e"), whole.alias("__t"), F.lit(k).cast("int").alias("__s"), F.col(ids[k]).cast("long").alias("__i"))
        return d.where("__e is not null and __t is not null and __i is not null")

    b = lambda c: F.expr(f"cast(floor(({c}) / {bucket}) as long)")
    a = side(left, 0).withColumn("__b", b("__t"))
    r = side(right, 1).withColumn("__b", F.explode(F.sequence(b(f"__t - {tol}"), b(f"__t + {tol}"))))
    return a.unionByName(r)


def nearest_time(left: DataFrame, right: DataFrame, *, by: tuple[str, str], times: tuple[str, str], ids: tuple[str, str], tolerance: float, unit: float = 1e-6, bucket: float = 4.0) -> DataFrame:
    """(left id, right id): each left row's nearest right row of the same entity, if within `tolerance`.

    times are in seconds (DOUBLE) and compared in whole `unit`s, or already whole units (LONG). Defined
    results: rows with null (or NaN) time, entity or id take no part; no row for a left row without a
    partner; of two right rows equally near the earlier wins, of equal times the smaller id; exact
    duplicates count once; empty tables give no rows. Other columns are not read, so their names don't
    matter. One shuffle of entity, time and id; a hot entity spreads over its time buckets.
    """
    tol, width = round(tolerance / unit), max(1, round(bucket / unit))
    rows = _sides(left, right, by, times, ids, unit, tol, width)
    rows = rows.repartition("__e", "__b").sortWithinPartitions("__e", "__b", "__t", "__s", "__i")
    names = list(ids) if ids[0] != ids[1] else [ids[0], f"{ids[1]}_right"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, buf = None, None
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            e, b, t, s, i = (col(c) for c in ("__e", "__b", "__t", "__s", "__i"))
            again = np.zeros(len(t), bool)
            again[1:] = (e[1:] == e[:-1]) & (b[1:] == b[:-1]) & (t[1:] == t[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1])
            again[0] = last == (e[0], b[0], t[0], s[0], i[0])
            last = (e[-1], b[-1], t[-1], s[-1], i[-1])
            change = np.append(True, (e[1:] != e[:-1]) | (b[1:] != b[:-1]))
            cut = np.append(np.flatnonzero(change), len(t))
            out = []
            for x, y in zip(cut[:-1], cut[1:]):
                if (e[x], b[x]) != key:
                    if buf is not None:
                        out.append(buf.advance(END))
                    key, buf = (e[x], b[x]), Buffer(tol)
                w = slice(x, y)
                l, r = (s[w] == 0) & ~again[w], (s[w] == 1) & ~again[w]
                buf.add(t[w][l], i[w][l], t[w][r], i[w][r])
                if y == len(t):  # more of this entity may follow
                    out.append(buf.advance(int(t[y - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=names)
        if buf is not None:
            got = buf.advance(END)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=names)

    return rows.mapInArrow(run, schema)


def stream_nearest(left: DataFrame, right: DataFrame, *, by: tuple[str, str], times: tuple[str, str], ids: tuple[str, str], tolerance: float, delay: str, unit: float = 1e-6, bucket: float = 60.0, epoch: float = 0.0) -> DataFrame:
    """The same join over two streams in append mode; `delay` is the lateness that the watermark grants.

    times are seconds since `epoch` (Unix seconds of its zero). State is kept for each entity and time
    bucket and ends with it. Rows later than the watermark may be dropped, as in any stream."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    tol, width, zero = round(tolerance / unit), max(1, round(bucket / unit)), round(epoch / unit)
    ms = lambda units: int((units + zero) * unit * 1000)
    rows = _sides(left, right, by, times, ids, unit, tol, width)
    rows = rows.withColumn("__at", F.timestamp_micros(((F.col("__t") + F.lit(zero)) * F.lit(unit * 1e6)).cast("long"))).withWatermark("__at", delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        buf = Buffer(tol, tuple(np.frombuffer(x, np.int64) for x in held) if held else None)
        for f in frames:
            t, s, i = (f[c].to_numpy(np.int64) for c in ("__t", "__s", "__i"))
            buf.add(t[s == 0], i[s == 0], t[s == 1], i[s == 1])
        mark = state.getCurrentWatermarkMs()
        now = int(mark / 1000 / unit) - zero
        a, b = buf.advance(now) if mark > 0 else (np.zeros(0, np.int64),) * 2
        ends = int(buf.lt.max() if len(buf.lt) else -(1 << 62))
        if len(buf.lt) or len(buf.rt):
            state.update(tuple(x.tobytes() for x in buf.state()))
            wake = max(ends, int(buf.rt.max()) if len(buf.rt) else ends) + tol
            state.setTimeoutTimestamp(max(ms(wake) + 1, mark + 1))
        elif state.exists:
            state.remove()
        # an id that came twice is emitted once
        yield pd.DataFrame({ids[0]: a, ids[1]: b}).drop_duplicates()

    blob = "lt binary, li binary, rt binary, ri binary"
    return rows.groupBy("__e", "__b").applyInPandasWithState(run, f"`{ids[0]}` long, `{ids[1]}` long", blob, "append", GroupStateTimeout.EventTimeTimeout)


def returns_with_trajectory(points: DataFrame, sbet: DataFrame, tolerance: float = 0.04) -> DataFrame:
    """pid, rec_id: each return's trajectory record on its own flight line with a known altitude."""
    known = sbet.where(F.col("altitude").isNotNull())
    return nearest_time(points, known, by=("point_source_id", "point_source_id"), times=("gps_time", "gps_time"), ids=("pid", "rec_id"), tolerance=tolerance)
