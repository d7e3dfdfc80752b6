"""Time texts of mixed spelling, precision and zone as one UTC instant.

Each value is reduced to a mask of its character classes (a digit is 9, a run of letters is A, the
rest stays). Values are grouped by mask; a mask is mapped to a parser once per worker and its values
are then taken apart and converted as arrays. Civil readings without a zone of their own go through
the transition table of the given zone. No value is parsed one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from laserloom.functions.timezones import ABBREVIATIONS, US, canonical, zone_table

#: Layouts of civil readings, tried in this order on the first value of a new mask.
_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_ZONE = r"(?: ?(?P<z>[A-Za-z]+(?:[+-]\d{2}:?\d{2})?|[+-]\d{2}(?::?\d{2})?))?(?:\[(?P<zn>[A-Za-z_/+0-9-]+)\])?"
LAYOUTS = {
    "iso": rf"^(?P<Y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})[A-Za-z ]{_TIME}{_ZONE}$",
    "ordinal": rf"^(?P<Y>\d{{4}})-(?P<j>\d{{3}})[A-Za-z ]{_TIME}{_ZONE}$",
    "basic": rf"^(?P<Y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[A-Za-z](?P<H>\d{{2}})(?P<M>\d{{2}})(?:(?P<S>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE}$",
    "dots": rf"^(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<Y>\d{{4}}),? {_TIME}{_ZONE}$",
    "slash12": rf"^(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<Y>\d{{4}}),? {_TIME} ?(?P<p>[AaPp][Mm])$",
    "slash": rf"^(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<Y>\d{{4}}),? {_TIME}{_ZONE}$",
    "mail": rf"^(?P<w>[A-Za-z]+), (?P<d>\d{{1,2}}) (?P<mon>[A-Za-z]+) (?P<Y>\d{{4}}) {_TIME}{_ZONE}$",
    "day_month": rf"^(?P<d>\d{{1,2}}) (?P<mon>[A-Za-z]+) (?P<Y>\d{{4}}),? {_TIME}{_ZONE}$",
    "month_day12": rf"^(?P<mon>[A-Za-z]+) (?P<d>\d{{1,2}}), (?P<Y>\d{{4}}),? {_TIME} ?(?P<p>[AaPp][Mm]){_ZONE}$",
    "month_day": rf"^(?P<mon>[A-Za-z]+) (?P<d>\d{{1,2}}), (?P<Y>\d{{4}}),? {_TIME}{_ZONE}$",
    "number": r"^(?P<n>\d+)(?:\.(?P<f>\d*))?$",
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

#: Fixed values: (GPS second from which it holds, leap seconds), since 1980-01-06.
LEAPS = (
    (0, 0), (46828801, 1), (78364802, 2), (109900803, 3), (173059204, 4), (252028805, 5), (315187206, 6),
    (346723207, 7), (393984008, 8), (425520009, 9), (457056010, 10), (504489611, 11), (551750412, 12),
    (599184013, 13), (820108814, 14), (914803215, 15), (1025136016, 16), (1119744017, 17), (1167264018, 18),
)
GPS_EPOCH = 315_964_800
WEEK = 604_800
FIRST, LAST = 1_420_070_400, 1_704_067_200  # the years 2015 to 2023, Unix seconds


def gps_to_utc_us(gps_us: np.ndarray) -> np.ndarray:
    """Microseconds since the GPS epoch to microseconds UTC, by the leap seconds of their date."""
    starts = np.array([s * US for s, _ in LEAPS], np.int64)
    leaps = np.array([n for _, n in LEAPS], np.int64)
    return GPS_EPOCH * US + gps_us - leaps[np.clip(np.searchsorted(starts, gps_us, side="right") - 1, 0, None)] * US


def masks(values: pa.Array) -> pa.Array:
    """Character-class masks of trimmed texts."""
    m = pc.replace_substring_regex(values, r"[0-9]", "9")
    return pc.replace_substring_regex(m, r"[A-Za-z]+", "A")


def tidy(values: pa.Array) -> pa.Array:
    """Trim (also no-break spaces), unify minus signs."""
    v = pc.replace_substring_regex(values, "[−‐-–]", "-")
    return pc.utf8_trim(pc.replace_substring_regex(v, "[   ﻿]", " "), " \t\r\n\f\v")


def _ints(a: pa.Array, default: int = 0) -> np.ndarray:
    a = pc.if_else(pc.equal(pc.coalesce(a, pa.scalar("")), ""), pa.scalar(str(default)), a)
    return pc.cast(a, pa.int64()).to_numpy(zero_copy_only=False)


def _micros(a: pa.Array) -> np.ndarray:
    """Digits after the point as microseconds; digits beyond the sixth are cut off."""
    s = pc.utf8_slice_codeunits(pc.utf8_rpad(pc.coalesce(a, pa.scalar("")), 6, "0"), 0, 6)
    return pc.cast(s, pa.int64()).to_numpy(zero_copy_only=False)


def _lookup(a: pa.Array, of) -> np.ndarray:
    """of() on the distinct values only."""
    d = pc.dictionary_encode(pc.coalesce(a, pa.scalar("")))
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return np.array([of(x) for x in d.dictionary.to_pylist()] or [None], object)[d.indices.to_numpy(zero_copy_only=False)]


def _offset_minutes(text: str) -> int | str | None:
    """Minutes of an offset or abbreviation; 'none' if nothing is written; None if unknown."""
    if not text:
        return "none"
    m = re.fullmatch(r"([A-Za-z]*)(?:([+-])(\d{2}):?(\d{2})?)?", text)
    if not m:
        return None
    base = 0
    if m[1]:
        base = ABBREVIATIONS.get(m[1].upper())
        if base is None or (m[2] and m[1].upper() not in ("UTC", "GMT")):
            return None
    if m[2]:
        h, k = int(m[3]), int(m[4] or 0)
        if h > 18 or k > 59:
            return None
        base += (h * 60 + k) * (-1 if m[2] == "-" else 1)
    return base


def _civil_us(Y, m, d, H, M, S, f) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of a civil reading as if in UTC, and whether it exists."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (H <= 23) & (M <= 59) & (S <= 59) & (Y >= 1)
    m1 = np.where((m >= 1) & (m <= 12), m, 1)
    month = ((Y - 1970) * 12 + (m1 - 1)).astype("datetime64[M]")
    days = month.astype("datetime64[D]").astype(np.int64)
    length = (month + 1).astype("datetime64[D]").astype(np.int64) - days
    ok &= d <= length
    return (((days + d - 1) * 24 + H) * 60 + M) * 60 * US + S * US + f, ok


class Converter:
    """Parsers by mask, kept for the life of a worker's task."""

    def __init__(self) -> None:
        self.by_mask: dict[str, str | None] = {}

    def layout(self, mask: str, example: str) -> str | None:
        if mask not in self.by_mask:
            self.by_mask[mask] = next((k for k, r in LAYOUTS.items() if re.match(r, example)), None)
        return self.by_mask[mask]

    def __call__(self, values: pa.Array, weeks: pa.Array, zones: pa.Array, orders: pa.Array):
        """(utc_us, number of instants, layout) of each value."""
        n = len(values)
        out, count = np.zeros(n, np.int64), np.zeros(n, np.int8)
        names = np.full(n, None, object)
        values = tidy(pc.cast(values, pa.string()))
        enc = pc.dictionary_encode(masks(values))
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        codes = pc.fill_null(enc.indices, -1).to_numpy(zero_copy_only=False)
        rows = np.argsort(codes, kind="stable")
        cut = np.searchsorted(codes[rows], np.arange(len(enc.dictionary) + 1))
        by_layout: dict[str, list[np.ndarray]] = {}
        for i, mask in enumerate(enc.dictionary.to_pylist()):
            own = rows[cut[i] : cut[i + 1]]
            # AM/PM and a zone share a mask, so the first value decides only among such layouts
            for pick in self._split(values, own, mask):
                k = self.layout(pick[1], values[int(pick[0][0])].as_py())
                if k:
                    by_layout.setdefault(k, []).append(pick[0])
        for k, parts in by_layout.items():
            own = np.concatenate(parts)
            take = pa.array(own)
            got = pc.extract_regex(pc.take(values, take), LAYOUTS[k])
            u, c = self.number(got, pc.take(weeks, take)) if k == "number" else self.civil(k, got, pc.take(zones, take), pc.take(orders, take))
            out[own], count[own], names[own] = u, c, k
        return out, count, names

    @staticmethod
    def _split(values: pa.Array, own: np.ndarray, mask: str):
        if " A" not in mask or "/" not in mask and not mask.startswith("A 9"):
            return [(own, mask)]
        half = pc.match_substring_regex(pc.take(values, pa.array(own)), r"(?i)\d ?[ap]m\b").to_numpy(zero_copy_only=False)
        return [(own[h], mask + s) for h, s in ((half, "/12"), (~half, "")) if h.any()]

    @staticmethod
    def number(got: pa.Array, weeks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The magnitude tells the clock, as all instants lie in 2015 to 2023."""
        text = pc.struct_field(got, "n")
        long = pc.greater(pc.utf8_length(text), 17)
        whole = _ints(pc.if_else(long, pa.scalar("0"), text))
        micros = _micros(pc.struct_field(got, "f"))
        week = pc.fill_null(pc.cast(weeks, pa.int64()), -1).to_numpy(zero_copy_only=False)
        out, count = np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int8)

        def put(pick, us):
            us = us[pick]
            fit = (us >= FIRST * US) & (us < LAST * US)
            out[pick] = us
            count[pick] = fit

        t = np.minimum(whole, 4_000_000_000) * US + micros
        put((whole < WEEK) & (week >= 0), gps_to_utc_us(np.clip(week, 0, 5000) * WEEK * US + t))
        put((whole >= 10**8) & (whole < 10**9 - WEEK), gps_to_utc_us(t + 10**9 * US))
        put((whole >= 10**9) & (whole < 1_400_000_000), gps_to_utc_us(t))
        put((whole >= 1_400_000_000) & (whole < 10**10), t)
        put((whole >= 10**12) & (whole < 10**13), np.minimum(whole, 10**13) * 1000 + micros // 1000)
        put((whole >= 10**15) & (whole < 10**16), whole)
        return out, count

    def civil(self, kind: str, got: pa.Array, zones: pa.Array, orders: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        has = {x.name for x in got.type}
        part = lambda k: pc.struct_field(got, k)
        Y, M, S = _ints(part("Y")), _ints(part("M")), _ints(part("S"))
        H, f = _ints(part("H")), _micros(part("f"))
        ok = np.ones(len(Y), bool)
        if "p" in has:
            afternoon = pc.equal(pc.utf8_lower(part("p")), "pm").to_numpy(zero_copy_only=False)
            ok &= (H >= 1) & (H <= 12)
            H = H % 12 + 12 * afternoon
        if "mon" in has:
            found = _lookup(part("mon"), lambda x: MONTHS.get(x[:3].lower(), 0) if len(x) >= 3 else 0).astype(np.int64)
            readings = [(found, _ints(part("d")), ok)]
        elif "j" in has:
            j = _ints(part("j"))
            leap = ((Y % 4 == 0) & (Y % 100 != 0)) | (Y % 400 == 0)
            day = (Y - 1970).astype("datetime64[Y]").astype("datetime64[D]") + (np.maximum(j, 1) - 1)
            month = day.astype("datetime64[M]")
            readings = [(month.astype(np.int64) % 12 + 1, (day - month.astype("datetime64[D]")).astype(np.int64) + 1, ok & (j >= 1) & (j <= 365 + leap))]
        elif "a" in has:
            a, b = _ints(part("a")), _ints(part("b"))
            order = pc.fill_null(pc.utf8_lower(pc.utf8_trim_whitespace(orders)), "").to_numpy(zero_copy_only=False)
            readings = [(b, a, ok & (order != "mdy")), (a, b, ok & (order != "dmy"))]
        else:
            readings = [(_ints(part("m")), _ints(part("d")), ok)]

        minutes = _lookup(part("z"), _offset_minutes) if "z" in has else np.full(len(Y), "none", object)
        unknown = np.equal(minutes, None)
        own = ~unknown & (minutes != "none")
        named = part("zn") if "zn" in has else pa.nulls(len(Y), pa.string())
        bracket = ~own & ~unknown & np.not_equal(_lookup(named, lambda x: x or None), None)
        names = np.where(bracket, _lookup(named, canonical), _lookup(zones, canonical))
        offset = np.zeros(len(Y), np.int64)
        offset[own] = minutes[own].astype(np.int64)

        out, second, count = np.zeros(len(Y), np.int64), np.zeros(len(Y), np.int64), np.zeros(len(Y), np.int8)
        for m, d, valid in readings:
            us, real = _civil_us(Y, m, d, H, M, S, f)
            real &= valid & ~unknown
            u1, u2, c = us - offset * 60 * US, us.copy(), real.astype(np.int8)
            rest = ~own
            c[rest] = 0
            for zone in {x for x in names[rest & real] if x is not None}:
                pick = rest & real & (names == zone)
                u1[pick], u2[pick], c[pick] = zone_table(zone).to_utc(us[pick])
            # a second way of reading counts unless it denotes the same instant
            same = (c == 1) & (count == 1) & (out == u1)
            out = np.where(count == 0, u1, out)
            count = np.where(same, count, np.minimum(count + c, 2)).astype(np.int8)
        return out, count


def normalise_timestamps(
    df: DataFrame,
    value: str,
    *,
    week: str | None = None,
    zone: str | None = None,
    order: str | None = None,
    out: str = "utc_us",
) -> DataFrame:
    """Add `out` (LONG, microseconds UTC), `out`_instants (0, 1, 2 = more than one) and `out`_layout.

    value: STRING column; week: GPS week for seconds of week; zone: IANA name for readings without a
    zone; order: 'dmy' or 'mdy' for slash dates. Defined results: null, empty, unknown spellings,
    impossible dates, dates or times of day alone give no instant (`out` null, 0); readings the clock
    skipped give 0, readings it showed twice give 2 and a null `out`; so do slash dates that can be
    read two ways. Columns of df that already bear one of the three names are replaced. One narrow
    pass, no shuffle.
    """
    added = [out, f"{out}_instants", f"{out}_layout"]
    keep = [c for c in df.columns if c not in added]
    from pyspark.sql import functions as F

    tail = "_" * max([len(x) for x in keep], default=0)  # names that no column has
    args = {f"{tail}v": (value, "string"), f"{tail}w": (week, "int"), f"{tail}z": (zone, "string"), f"{tail}o": (order, "string")}
    src = df.select(*[F.col(f"`{c}`") for c in keep], *[(F.col(f"`{c}`") if c else F.lit(None)).cast(t).alias(a) for a, (c, t) in args.items()])
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField(out, T.LongType()), T.StructField(added[1], T.IntegerType()), T.StructField(added[2], T.StringType())])
    k = len(keep)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Converter()
        for b in batches:
            u, c, names = work(*(b.column(k + i) for i in range(4)))
            cols = [*b.columns[:k], pa.array(u, pa.int64(), mask=c != 1), pa.array(c.astype(np.int32)), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return src.mapInArrow(convert, schema)


def flight_log_instants(flight_log: DataFrame, recorders: DataFrame) -> DataFrame:
    """log_id, utc_us of the records that denote exactly one instant; exact duplicates count once.

    recorders is a fixed table of devices; a record whose device is missing has no zone."""
    from pyspark.sql import functions as F

    dev = recorders.select(F.col("recorder_id").alias("__rid"), F.col("zone").alias("__zone"), F.col("date_order").alias("__order")).dropDuplicates(["__rid"])
    log = flight_log.select("log_id", "recorder_id", "gps_time", "gps_week")
    joined = log.join(dev, F.col("recorder_id") == F.col("__rid"), "left")
    got = normalise_timestamps(joined, "gps_time", week="gps_week", zone="__zone", order="__order")
    return got.where("utc_us is not null and log_id is not null").select("log_id", "utc_us").dropDuplicates(["log_id"])
