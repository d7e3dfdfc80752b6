"""GPS time as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK = 604_800
EPOCH = 315_964_800
ADJUST = 1_000_000_000

#: GPS calendar date from which the leap seconds hold, and their number.
LEAP_DATES = (
    ("1980-01-01", 0), ("1981-07-01", 1), ("1982-07-01", 2), ("1983-07-01", 3), ("1985-07-01", 4),
    ("1988-01-01", 5), ("1990-01-01", 6), ("1991-01-01", 7), ("1992-07-01", 8), ("1993-07-01", 9),
    ("1994-07-01", 10), ("1996-01-01", 11), ("1997-07-01", 12), ("1999-01-01", 13), ("2006-01-01", 14),
    ("2009-01-01", 15), ("2012-07-01", 16), ("2015-07-01", 17), ("2017-01-01", 18),
)


def leap_seconds(gps: Column, exact: bool = False) -> Column:
    """Leap seconds at a time in seconds since 1980-01-06. By default a boundary is met when the GPS
    calendar shows its date; exact: when UTC does (up to 18 s later)."""
    import datetime as dt

    out = F.lit(0)
    for day, n in LEAP_DATES[1:]:
        at = int(dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp()) - EPOCH + (n if exact else 0)
        out = F.when(gps >= at, F.lit(n)).otherwise(out)
    return out


def gps_to_utc(gps: Column, exact: bool = False) -> Column:
    """TIMESTAMP (UTC) of seconds since 1980-01-06; null for null, NaN and times before 1980-01-01."""
    at = F.lit(EPOCH) + gps - leap_seconds(gps, exact)
    ok = gps.isNotNull() & ~F.isnan(gps.cast("double")) & (gps >= F.lit(-5 * 86400))
    return F.when(ok, F.timestamp_micros(F.round(at * F.lit(1e6)).cast("long")))


def adjusted_to_utc(t: Column, exact: bool = False) -> Column:
    """TIMESTAMP (UTC) of adjusted standard GPS time (seconds less 10^9)."""
    return gps_to_utc(t + F.lit(float(ADJUST)), exact)


def week_time(week: Column, seconds: Column, form: str = "satellite", exact: bool = False) -> Column:
    """GPS week and seconds of week as satellite seconds, adjusted seconds or a UTC timestamp."""
    t = week.cast("double") * F.lit(float(WEEK)) + seconds.cast("double")
    if form == "satellite":
        return t
    if form == "adjusted":
        return t - F.lit(float(ADJUST))
    if form == "utc":
        return gps_to_utc(t, exact)
    raise ValueError(f"form must be satellite, adjusted or utc, not {form!r}")
