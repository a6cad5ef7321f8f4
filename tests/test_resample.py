"""Hand-computed expectations; times are HH:MM of 2020-01-01 unless a date is given."""

from datetime import UTC, datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gaugeflow.operators.resample import prepare, resample

DAY = datetime(2020, 1, 1, tzinfo=UTC)


def at(text):
    if text is None:
        return None
    if "-" in text:
        return datetime.fromisoformat(text).replace(tzinfo=UTC)
    h, m, *s = text.split(":")
    return DAY + timedelta(hours=int(h), minutes=int(m), seconds=float(s[0]) if s else 0)


def run(spark, readings, **args):
    df = spark.createDataFrame([("a", at(t) if isinstance(t, str) else t, v) for t, v in readings], "series_key string, ts timestamp, value double")
    out = resample(df, **args).selectExpr("unix_micros(ts) AS us", "value").collect()
    return {r.us: r.value for r in out}


def expect(pairs):
    return {int((at(t) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)): v for t, v in pairs}


def every(start, minutes, n, value):
    return [(at(start) + timedelta(minutes=minutes * i), value) for i in range(n)]


RAMP = [(f"{m // 60:02d}:{m % 60:02d}", float(i)) for i, m in enumerate(range(0, 121, 15))]
COV0 = {"min_coverage": 0}
SUM = {"statistic": "sum"}
CASES = {
    "ramp": (RAMP, {}, [("00:00", 2.0), ("01:00", 6.0)]),
    "irregular": ([("00:00", 10.0), ("00:15", 20.0), ("01:00", 100.0)], {}, [("00:00", 48.75)]),
    "gap": ([("00:00", 0.0), ("01:00", 0.0), ("02:00", 0.0), ("12:00", 120.0), ("13:00", 120.0)], {}, [("00:00", 0.0), ("01:00", 0.0), ("12:00", 120.0)]),
    "hourly": ([("00:00", 10.0), ("01:00", 20.0), ("02:00", 30.0)], {}, [("00:00", 15.0), ("01:00", 25.0)]),
    "repeated": ([("00:00", 10.0), ("00:00", 20.0), ("01:00", 40.0)], {}, [("00:00", 27.5)]),
    "single": ([("00:30", 5.0)], {}, []),
    "empty": ([], {}, []),
    "empty_sum": ([], SUM, []),
    "partial_first": ([("00:40", 1.0), ("00:50", 1.0), ("01:00", 1.0), ("01:20", 1.0), ("01:40", 1.0), ("02:00", 1.0)], {}, [("01:00", 1.0)]),
    "sum_outage": ([("01:00", 0.0), ("02:00", 0.5), ("03:00", 0.0), ("07:00", 1.0)], SUM, [("00:00", 0.0), ("01:00", 0.5), ("02:00", 0.0), ("06:00", 1.0)]),
    "messy": ([("15:59:59", 0.5), ("18:00", 0.3)], SUM, [("15:00", 0.5), ("17:00", 0.3)]),
    "microsecond": ([("01:00", 1.0), ("01:00:00.000001", 2.0)], SUM | COV0, [("00:00", 1.0), ("01:00", 2.0)]),
    "before_1970": ([("1969-12-31 22:00", 0.0), ("1969-12-31 23:00", 10.0), ("1970-01-01 00:00", 20.0)], {}, [("1969-12-31 22:00", 5.0), ("1969-12-31 23:00", 15.0)]),
    "sum_before_1970": ([("1969-12-31 23:00", 1.0), ("1969-12-31 23:30", 2.0)], SUM | COV0, [("1969-12-31 22:00", 1.0), ("1969-12-31 23:00", 2.0)]),
    "year_3000": ([("3000-01-01 00:00", 1.0), ("3000-01-02 00:00", 2.0)], SUM, [("2999-12-31 23:00", 1.0), ("3000-01-01 23:00", 2.0)]),
    "missing_time": ([("00:30", 1.0), (None, 2.0)], SUM | COV0, [("00:00", 1.0)]),
    "missing_value": ([("00:30", 1.0), ("01:30", None), ("02:30", float("nan")), ("03:30", float("inf"))], SUM | COV0, [("00:00", 1.0)]),
    "jitter": ([("00:59:59", 1.0), ("02:00:01", 2.0)], SUM | {"round_to": "1min"}, [("00:00", 1.0), ("01:00", 2.0)]),
    "jitter_repeat": ([("00:59:59", 1.0), ("01:00:01", 3.0)], SUM | COV0 | {"round_to": "1min"}, [("00:00", 2.0)]),
    "jitter_mean": ([("00:00:01", 10.0), ("00:59:59", 20.0), ("02:00:01", 30.0)], {"round_to": "1min"}, [("00:00", 15.0), ("01:00", 25.0)]),
    "five_hours": ([("2020-03-05 01:00", 1.0), ("2020-03-05 02:00", 2.0)], SUM | COV0 | {"freq": "5h"}, [("2020-03-04 20:00", 1.0), ("2020-03-05 01:00", 2.0)]),
    "lone_sum": ([("00:30", 2.5)], SUM, []),
    "lone_sum_cov0": ([("00:30", 2.5)], SUM | COV0, [("00:00", 2.5)]),
    "regime_change": (every("00:00", 30, 13, 10.0) + every("06:05", 5, 24, 10.0), {}, [(f"{h:02d}:00", 10.0) for h in range(8)]),
    "outage": ([(f"00:{m:02d}", 0.0) for m in (0, 5, 10, 15)] + [("00:45", 100.0), ("00:50", 100.0), ("00:55", 100.0), ("01:00", 100.0)], {}, []),
    "outage_cov": ([(f"00:{m:02d}", 0.0) for m in (0, 5, 10, 15)] + [("00:45", 100.0), ("00:50", 100.0), ("00:55", 100.0), ("01:00", 100.0)], {"min_coverage": 0.4}, [("00:00", 50.0)]),
    "skipped_8": (every("00:05", 5, 12, 0.1) + every("01:05", 5, 7, 0.1) + [("02:00", 0.1)], SUM, [("00:00", 1.2)]),
    "skipped_9": (every("00:05", 5, 12, 0.1) + every("01:05", 5, 8, 0.1) + [("02:00", 0.1)], SUM, [("00:00", 1.2), ("01:00", 0.9)]),
    "max_gap": (RAMP, {"max_gap": "10min", "min_coverage": 0}, []),
    "sum_ignores_max_gap": ([("01:00", 0.0), ("02:00", 0.5)], SUM | {"max_gap": "1min"}, [("00:00", 0.0), ("01:00", 0.5)]),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    readings, args, pairs = CASES[name]
    assert run(spark, readings, **args) == pytest.approx(expect(pairs), abs=1e-9)


def test_short_early_era(spark):
    got = run(spark, every("00:00", 30, 8, 10.0) + every("03:35", 5, 31, 10.0))
    hours = expect([(f"{h:02d}:00", 10.0) for h in range(6)])
    assert {k: got.get(k) for k in hours} == pytest.approx(hours)


@pytest.mark.parametrize("statistic", ["median", None, 3, ["mean"]])
def test_unsupported(spark, statistic):
    with pytest.raises(ValueError, match="unsupported statistic"):
        run(spark, RAMP, statistic=statistic)


def test_text_values_are_cast_strictly(spark):
    df = spark.createDataFrame([("a", at("00:30"), "1.5")], "series_key string, ts timestamp, value string")
    assert [r.value for r in prepare(df).collect()] == [1.5]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        prepare(df.selectExpr("series_key", "ts", "'x' AS value")).collect()


def test_clashing_columns_and_null_keys(spark):
    rows = [("a", at(t), v, 7, 8, 9) for t, v in RAMP] + [(None, at("00:10"), 1.0, 7, 8, 9)]
    df = spark.createDataFrame(rows, "series_key string, ts timestamp, value double, tile int, us int, bin int")
    assert sorted(r.value for r in resample(df).collect()) == [2.0, 6.0]


def test_series_longer_than_a_tile(spark):
    """Half a year of hours, with a hole of 50 days that no tile boundary may hide or shift."""
    hours = [h for h in range(180 * 24) if not 40 * 24 < h < 90 * 24]
    got = run(spark, [(DAY + timedelta(hours=h), float(h)) for h in hours])
    want = [h for h in hours if h + 1 in set(hours)]
    start = int(DAY.timestamp()) * 10**6
    assert got == pytest.approx({start + h * 3_600_000_000: h + 0.5 for h in want})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3000, 3000), min_size=2, max_size=40, unique=True), st.floats(-1e6, 1e6))
def test_mean_of_a_constant(spark, minutes, value):
    got = run(spark, [(DAY + timedelta(minutes=m), value) for m in minutes], min_coverage=0, gap_multiplier=1e9)
    assert got and all(v == pytest.approx(value, rel=1e-9, abs=1e-9) for v in got.values())


def test_arrays_of_python(spark):
    import numpy as np
    import pandas as pd

    day = datetime(2020, 1, 1)
    times = [day + timedelta(minutes=15 * i) for i in range(9)]
    values = [float(i) for i in range(9)]
    zone = timezone(timedelta(hours=5))
    forms = (
        times, [t.isoformat() for t in times], np.array(times, "datetime64[ns]"), np.array(times, "datetime64[s]"), pd.Series(times), pd.DatetimeIndex(times).tz_localize("UTC"),
        pd.Series(times).dt.tz_localize("UTC").dt.tz_convert("Asia/Tokyo"), [t.replace(tzinfo=UTC).astimezone(zone) for t in times], [*times, None], [*times, pd.NaT],
    )
    for form in forms:
        t, v = resample(form, values + [9.0] * (len(form) - 9))
        assert t.dtype == "datetime64[us]" and t.tolist() == times[:8:4] and v.tolist() == [2.0, 6.0]
    t, v = resample(np.array(["3000-01-01", "3000-01-02"], "datetime64[D]"), ["1", None], statistic="sum", min_coverage=0)
    assert t.tolist() == [datetime(2999, 12, 31, 23)] and v.tolist() == [1.0]
    assert resample([], [])[0].dtype == "datetime64[us]" and resample([], [])[1].size == 0
    for bad, kind in (([float("nan")], TypeError), ([5], TypeError), (["x"], ValueError)):
        with pytest.raises(kind):
            resample(bad, [1.0])
    for bad in (["n/a"], [1.0, 2.0]):
        with pytest.raises(ValueError):
            resample([day], bad)
