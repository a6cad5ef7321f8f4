"""Durations and cadences, parsed on the driver to whole microseconds."""

from __future__ import annotations

import re
from datetime import timedelta

#: Microseconds of each unit.
UNIT_US = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}
_FORM = re.compile(r"([1-9][0-9]*)?(h|min|s|D)")

#: Codes of cadences and their kind. Minute codes 1–30 and hour codes 1–12 that divide a day are fixed.
FIXED_CODES = (
    {f"{m}min": m * UNIT_US["min"] for m in range(1, 31) if 1440 % m == 0}
    | {f"{h}h": h * UNIT_US["h"] for h in range(1, 13) if 24 % h == 0}
    | {"day": UNIT_US["D"]}
)
CALENDAR_CODES = ("month", "year")


def parse_duration_us(duration) -> int:
    """Microseconds of '15min', '1h', 'D', 'day', a timedelta or a numpy timedelta64; anything else raises ValueError.

    Null, NaT, calendar units, fractions, zero and negative lengths raise.
    """
    if type(duration).__module__ == "numpy" and type(duration).__name__ == "timedelta64":
        import numpy as np

        if np.isnat(duration) or np.datetime_data(duration)[0] in ("Y", "M", "generic"):
            raise ValueError(f"not a fixed duration: {duration!r}")
        us = int(duration.astype("timedelta64[us]").astype("int64"))
    elif isinstance(duration, timedelta):
        us = duration // timedelta(microseconds=1)
    elif duration == "day":
        us = UNIT_US["D"]
    else:
        m = _FORM.fullmatch(duration) if isinstance(duration, str) else None
        if not m:
            raise ValueError(f"not a fixed duration: {duration!r}")
        us = int(m[1] or 1) * UNIT_US[m[2]]
    if us <= 0:
        raise ValueError(f"a duration must be positive: {duration!r}")
    return us


def cadence_us(code: str | None) -> int:
    """Step of a dataset's cadence code; irregular (None), calendar-based and unknown codes raise ValueError."""
    if code is None or code == "None":
        raise ValueError("the cadence is irregular: a dense axis needs a fixed step")
    if code in CALENDAR_CODES:
        raise ValueError(f"the cadence {code!r} is calendar-based: a dense axis needs a fixed step")
    if code not in FIXED_CODES:
        raise ValueError(f"unknown cadence {code!r}")
    return FIXED_CODES[code]


def natural_unit(step_us: int) -> tuple[str, int]:
    """Largest of D, h, m, s that divides the step, and the step in it."""
    for unit, us in (("D", UNIT_US["D"]), ("h", UNIT_US["h"]), ("m", UNIT_US["min"]), ("s", UNIT_US["s"])):
        if step_us % us == 0:
            return unit, step_us // us
    raise ValueError("steps below a second have no natural unit")


def check_phase(utc_offset: str | None, step_us: int) -> None:
    """Raise unless the offset, reduced by the step, is zero (an axis is anchored at the epoch in UTC)."""
    if utc_offset in (None, ""):
        return
    m = re.fullmatch(r"([+-])([0-9]{2}):([0-9]{2})", utc_offset)
    if not m:
        raise ValueError(f"not an offset: {utc_offset!r}")
    us = (int(m[2]) * 60 + int(m[3])) * UNIT_US["min"] * (-1 if m[1] == "-" else 1)
    if us % step_us:
        raise ValueError(f"utc_offset {utc_offset} shifts the intervals against the UTC axis")
