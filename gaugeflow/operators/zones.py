"""Versioned tables of zone transitions, read from the compiled zone data of the machine (the TZif format, RFC 8536).

A table holds every recorded transition and, after the last one, those of the zone's closing rule for 400 years. The
calendar repeats every 400 years, weekdays included, so later times are looked up whole cycles earlier: no year is
outside the table.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from datetime import date
from pathlib import Path

import numpy as np

SECOND_US = 1_000_000
DAY_S = 86_400
#: Days and microseconds of 400 years of the calendar.
CYCLE_DAYS = 146_097
CYCLE_US = CYCLE_DAYS * DAY_S * SECOND_US
_EPOCH = date(1970, 1, 1).toordinal()
_LOWEST, _HIGHEST = np.iinfo("int64").min, np.iinfo("int64").max


@dataclass(frozen=True)
class Zone:
    """Stretches of constant offset: starts (UTC µs, the first the lowest int), offsets in µs, names. Local times from
    repeats_us on are looked up whole cycles earlier."""

    starts: np.ndarray
    offsets: np.ndarray
    names: np.ndarray
    repeats_us: int = _HIGHEST

    def local_to_utc(self, local: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(instants, how many instants fit) of local times; where names isn't '', only stretches of that name fit."""
        cycles = np.where(local >= self.repeats_us, (local - self.repeats_us) // CYCLE_US + 1, 0)
        at = local - cycles * CYCLE_US
        ends = np.r_[self.starts[1:], _HIGHEST]
        begins = np.r_[_LOWEST, self.starts[1:] + self.offsets[1:]]
        k = np.searchsorted(begins, at, side="right") - 1
        us, fits = np.zeros(len(at), "int64"), np.zeros(len(at), int)
        for c in (k - 1, k, k + 1):
            in_ = (c >= 0) & (c < len(ends))
            c = np.clip(c, 0, len(ends) - 1)
            t = at - self.offsets[c]
            ok = in_ & (t >= self.starts[c]) & (t < ends[c]) & ((names == "") | (self.names[c] == names))
            us = np.where(ok, t + cycles * CYCLE_US, us)
            fits += ok
        return us, fits


@dataclass(frozen=True)
class ZoneTables:
    """Transition tables of named zones, and the version of the zone data they come from."""

    version: str
    zones: dict[str, Zone | None]


def _bytes_of(name: str) -> bytes | None:
    import importlib.resources
    import zoneinfo

    if not re.fullmatch(r"[A-Za-z0-9_+\-]+(/[A-Za-z0-9_+\-]+)*", name):
        return None
    for folder in zoneinfo.TZPATH:
        p = Path(folder, name)
        if p.is_file():
            data = p.read_bytes()
            return data if data[:4] == b"TZif" else None
    try:
        return importlib.resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


def zone_version() -> str:
    """Version of the zone data on this machine, or 'unknown'."""
    import zoneinfo

    for folder in zoneinfo.TZPATH:
        for name, form in (("+VERSION", r"(\S+)"), ("tzdata.zi", r"# version (\S+)"), ("version", r"(\S+)")):
            p = Path(folder, name)
            if p.is_file() and (m := re.match(form, p.open().readline())):
                return m[1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


_NAME = r"(?:[A-Za-z]{3,}|<[A-Za-z0-9+\-]+>)"
_HMS = r"[+\-]?[0-9]{1,3}(?::[0-9]{2}){0,2}"
_RULE = re.compile(rf"(?P<std>{_NAME})(?P<off>{_HMS})(?:(?P<dst>{_NAME})(?P<dstoff>{_HMS})?,(?P<start>[^,/]+)(?:/(?P<at>{_HMS}))?,(?P<end>[^,/]+)(?:/(?P<till>{_HMS}))?)?")


def _seconds(hms: str) -> int:
    parts = [int(x) for x in hms.lstrip("+-").split(":")] + [0, 0]
    return (parts[0] * 3600 + parts[1] * 60 + parts[2]) * (-1 if hms[0] == "-" else 1)


def _day_of(rule: str, year: int) -> int:
    """Days since 1970 of a day rule in a year: Mm.w.d (w-th weekday d of month m, 5 the last), Jn (29 February never
    counted) or n (from 0)."""
    first = date(year, 1, 1).toordinal() - _EPOCH
    if rule[0] == "M":
        m, w, d = map(int, rule[1:].split("."))
        start = date(year, m, 1)
        day = start.toordinal() - _EPOCH + (d - start.isoweekday()) % 7 + 7 * (w - 1)
        month_end = (date(year, m + 1, 1) if m < 12 else date(year + 1, 1, 1)).toordinal() - _EPOCH
        return day - 7 if day >= month_end else day
    if rule[0] == "J":
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        return first + int(rule[1:]) - 1 + (leap and int(rule[1:]) > 59)
    return first + int(rule)


def _closing(rule: str, after_s: int) -> tuple[list[tuple[int, int, str]], int]:
    """(second, offset in seconds, name) of the changes after after_s by a closing rule, for a whole cycle of years from
    the next one on, and the second from which they repeat. No changes: the rule is one offset."""
    m = _RULE.fullmatch(rule)
    if not m or not m["dst"]:
        return [], _HIGHEST
    std = -_seconds(m["off"])  # POSIX counts westward
    dst = -_seconds(m["dstoff"]) if m["dstoff"] else std + 3600
    names = [m[k].strip("<>") for k in ("std", "dst")]
    year = date.fromordinal(after_s // DAY_S + _EPOCH).year
    out = []
    for y in range(year, year + 402):
        out.append((_day_of(m["start"], y) * DAY_S + _seconds(m["at"] or "2") - std, dst, names[1]))
        out.append((_day_of(m["end"], y) * DAY_S + _seconds(m["till"] or "2") - dst, std, names[0]))
    repeats = (date(year + 401, 1, 1).toordinal() - _EPOCH) * DAY_S
    return sorted(x for x in out if x[0] > after_s), repeats


def zone_of(name: str) -> Zone | None:
    """Table of an IANA zone or of a fixed offset ('+05:30'); None for a name that is neither."""
    if m := re.fullmatch(r"([+-])(\d\d):?(\d\d)", name):
        off = (int(m[2]) * 60 + int(m[3])) * 60 * SECOND_US * (-1 if m[1] == "-" else 1)
        return Zone(np.array([_LOWEST]), np.array([off]), np.array([""], object))
    data = _bytes_of(name)
    if data is None:
        return None
    head = struct.Struct(">4sc15x6l")
    _, version, isut, isstd, leaps, times, types, chars = head.unpack_from(data)
    at, width = head.size, 4
    if version != b"\0":  # the second block has 64-bit times
        at += times * 5 + types * 6 + chars + leaps * 8 + isstd + isut
        _, _, isut, isstd, leaps, times, types, chars = head.unpack_from(data, at)
        at, width = at + head.size, 8
    seconds = np.frombuffer(data, f">i{width}", times, at).astype("int64")
    kind = np.frombuffer(data, "u1", times, at + times * width)
    at += times * (width + 1)
    kinds = [struct.unpack_from(">lBB", data, at + 6 * i) for i in range(types)]
    at += types * 6
    letters = data[at : at + chars]
    called = lambda k: letters[k[2] : letters.index(b"\0", k[2])].decode()
    at += chars + leaps * (width + 4) + isstd + isut
    rule = data[at:].strip(b"\n").decode() if width == 8 else ""
    rows = [(int(s), kinds[k][0], called(kinds[k])) for s, k in zip(seconds, kind)]
    last = rows[-1][0] if rows else 0
    more, repeats = _closing(rule, last)
    rows = [(None, kinds[0][0], called(kinds[0])), *rows, *more]
    starts = np.array([_LOWEST, *(r[0] * SECOND_US for r in rows[1:])])
    return Zone(starts, np.array([r[1] * SECOND_US for r in rows]), np.array([r[2] for r in rows], object), repeats if repeats == _HIGHEST else repeats * SECOND_US)


def zone_tables(names: list[str]) -> ZoneTables:
    """Transition tables of IANA zones and fixed offsets; None for a name that is neither."""
    return ZoneTables(zone_version(), {n: zone_of(n) for n in names})
