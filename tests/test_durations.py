from datetime import timedelta

import numpy as np
import pytest

from gaugeflow.functions.durations import cadence_us, check_phase, natural_unit, parse_duration_us

S = 1_000_000


@pytest.mark.parametrize(
    ("given", "seconds"), [("1h", 3600), ("h", 3600), ("15min", 900), ("30s", 30), ("2D", 172_800), ("day", 86_400), (timedelta(minutes=5), 300), (np.timedelta64(90, "m"), 5400)]
)
def test_accepts(given, seconds):
    assert parse_duration_us(given) == seconds * S


@pytest.mark.parametrize(
    "given", ["1.5h", "1H", "T", "W", "2 days", "2day", "1", "", None, "0min", "0h", "-1h", "1h\n", "١h", timedelta(0), timedelta(seconds=-1), np.timedelta64("NaT"), np.timedelta64(1, "M"), np.timedelta64(0, "s"), 5]
)
def test_rejects(given):
    with pytest.raises(ValueError):
        parse_duration_us(given)


@pytest.mark.parametrize(("code", "unit", "n"), [("1h", "h", 1), ("15min", "m", 15), ("12h", "h", 12), ("day", "D", 1)])
def test_cadence(code, unit, n):
    assert natural_unit(cadence_us(code)) == (unit, n)


@pytest.mark.parametrize(("code", "word"), [(None, "irregular"), ("month", "calendar"), ("year", "calendar"), ("7h", "unknown")])
def test_cadence_rejects(code, word):
    with pytest.raises(ValueError, match=word):
        cadence_us(code)


def test_phase():
    check_phase(None, 3600 * S)
    check_phase("+12:00", 3600 * S)
    check_phase("-00:00", 86_400 * S)
    for bad in ("+12:00", "+00:30"):
        with pytest.raises(ValueError, match="shifts"):
            check_phase(bad, 86_400 * S)
