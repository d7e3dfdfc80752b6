"""Versioned tables of zone transitions, and vectorised conversion through them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import lru_cache
from importlib import metadata

import numpy as np

US = 1_000_000

#: Customary zone abbreviations and their offsets in minutes. Abbreviations that
#: several zones with different offsets share (IST, CST, BST, ...) are left out on purpose.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "NPT": 345, "AEST": 600, "AEDT": 660,
}


def database_version() -> str:
    """Version of the zone database the tables are made from."""
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "system"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: offset[i] seconds hold from starts[i] (microseconds UTC) on."""

    name: str
    version: str
    starts: np.ndarray
    offsets: np.ndarray

    def offset_at(self, utc_us: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.starts, utc_us, side="right") - 1
        return self.offsets[np.clip(k, 0, len(self.offsets) - 1)]

    def to_utc(self, local_us: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first instant, second instant, how many instants show this reading: 0, 1 or 2)."""
        early = self.offset_at(local_us - 86_400 * US)
        late = self.offset_at(local_us + 86_400 * US)
        first, second = local_us - early * US, local_us - late * US
        ok1 = self.offset_at(first) == early
        ok2 = (self.offset_at(second) == late) & (early != late)
        return np.where(ok1, first, second), second, ok1.astype(np.int8) + ok2.astype(np.int8)


def _tidy(name: str) -> str:
    return "_".join(name.strip().replace("\\", "/").split()).lower()


@lru_cache(maxsize=1)
def _known() -> dict[str, str]:
    import zoneinfo

    return {z.lower(): z for z in zoneinfo.available_timezones()}


def canonical(name: str | None) -> str | None:
    """The database's spelling of an untidy zone name, or None."""
    return None if name is None else _known().get(_tidy(name))


@lru_cache(maxsize=700)
def zone_table(name: str, first_year: int = 1970, last_year: int = 2037) -> ZoneTable | None:
    """The transitions of a zone. Days are scanned, then each change is narrowed to the second."""
    import zoneinfo

    real = canonical(name)
    if real is None:
        return None
    zone = zoneinfo.ZoneInfo(real)

    def offset(second: int) -> int:
        return int(dt.datetime.fromtimestamp(second, zone).utcoffset().total_seconds())

    at = int(dt.datetime(first_year, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    end = int(dt.datetime(last_year, 12, 31, tzinfo=dt.timezone.utc).timestamp())
    starts, offsets = [-(2**62)], [offset(at)]
    while at < end:
        after = at + 86_400 * 7
        if offset(after) != offsets[-1]:
            low, high = at, after
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            starts.append(high * US)
            offsets.append(offset(high))
            after = high
        at = after
    return ZoneTable(real, database_version(), np.array(starts, np.int64), np.array(offsets, np.int64))
