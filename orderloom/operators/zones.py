"""Versioned tables of zone transitions and vectorised local-time conversion."""

from __future__ import annotations

import importlib.resources
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def tzdata_version() -> str:
    """Release of the zone data that the tables are made from."""
    try:
        return importlib.resources.files("tzdata").joinpath("zones").parent.joinpath("__init__.py").read_text().split('IANA_VERSION = "')[1].split('"')[0]
    except (ModuleNotFoundError, IndexError, OSError):
        try:
            with open("/usr/share/zoneinfo/tzdata.zi") as f:
                return f.readline().split()[-1]
        except OSError:
            return "system"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets in seconds and the local second from which each holds, by zone.

    A local time that occurs twice takes the offset before the change (the first of the two), one
    that is skipped too; hence an offset holds from its change plus the larger of both offsets.
    """

    version: str
    zones: dict[str, tuple[np.ndarray, np.ndarray]]

    def to_utc(self, local: np.ndarray, zone: str) -> np.ndarray:
        starts, offsets = self.zones[zone]
        return local - offsets[np.searchsorted(starts, local, side="right") - 1]


def _offset(zone: ZoneInfo, second: int) -> int:
    return int((EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())


def _changes(name: str, first: int, last: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    zone = ZoneInfo(name)
    starts, offsets = [-(1 << 62)], [_offset(zone, first)]
    for left in range(first, last, step):
        low, high = left, left + step
        if _offset(zone, high) == offsets[-1]:
            continue
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if _offset(zone, mid) == offsets[-1] else (low, mid)
        new = _offset(zone, high)
        starts.append(high + max(offsets[-1], new))
        offsets.append(new)
    return np.array(starts, dtype=np.int64), np.array(offsets, dtype=np.int64)


def zone_table(names: list[str], first_year: int = 1970, last_year: int = 2100) -> ZoneTable:
    """Tables of the named zones; unknown names are left out (their times stay unreadable)."""
    first, last = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds()) for y in (first_year, last_year))
    zones = {}
    for name in sorted({n for n in names if n}):
        try:
            zones[name] = _changes(name, first, last, 7 * 86400)
        except (KeyError, ValueError, OSError):
            continue
    return ZoneTable(tzdata_version(), zones)
