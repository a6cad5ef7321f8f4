"""Operators p1 to p5 on small inputs: against brute force, and for nulls, ties, repeats, empty tables and clashing names."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from gaugeflow.operators.current import current_series, current_stations
from gaugeflow.operators.implausible import LOW_STEPS, MAX_SPIKE, SPIKE_STEPS, implausible_altitudes, implausible_readings, profile_suspects, robust_components, spikes, stuck_limits, usual_steps
from gaugeflow.operators.incremental import CommitConflict, IntervalLedger, changed, delivery_intervals, intervals_of, members, merge, pending_intervals, subtract, touched_by, with_pending, within
from gaugeflow.operators.joins import lookup_join
from gaugeflow.operators.regular_grid import regular_grid
from gaugeflow.operators.rolling import rolling_totals, station_rolling_totals
from gaugeflow.operators.timestamps import instant_classes, normalise_times, parse_times, parser_of, same_instants
from gaugeflow.operators.zones import zone_tables

DAY = 86_400_000_000
HOUR = DAY // 24
NAN, INF = float("nan"), float("inf")


# --- joins


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_broadcast_or_salted(spark, how):
    big = spark.createDataFrame([("a" if i % 3 else f"k{i % 7}", i) for i in range(60)] + [(None, 99)], "k string, v int")
    small = spark.createDataFrame([("a", 1), ("k0", 2), ("zz", 3), (None, 4)], "k string, w int")
    one, two = (sorted(map(tuple, lookup_join(big, small, ["k"], how, max_bytes=b).collect()), key=str) for b in (1 << 20, 0))
    want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    assert one == two == want
    with pytest.raises(ValueError, match="both sides"):
        lookup_join(big, big, ["k"])


# --- current state

SERIES = "station_ref string, pos int, ts timestamp, value double, quality_code double, delivery_id long, us string"
DELIVERIES = "delivery_id long, arrived_at timestamp, value int"


def t(us):
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)


def test_current_series(spark):
    rows = [
        ("s", 0, t(0), 1.0, None, 1), ("s", 1, t(0), 2.0, None, 1), ("s", 0, t(0), 9.0, None, 3),  # 3 isn't listed
        ("s", 0, t(5), 1.0, 4.0, 2), ("s", 0, t(5), NAN, 7.0, 1), ("s", 3, t(5), None, NAN, 2),  # the last supplies nothing
        ("s", 0, t(9), -INF, None, 1), (None, 0, t(0), 1.0, 1.0, 1), ("s", 0, None, 1.0, 1.0, 1),
    ]
    s = spark.createDataFrame([(*r, "x") for r in rows * 2], SERIES)
    d = spark.createDataFrame([(1, t(100), 0), (2, t(50), 0), (1, t(100), 0)], DELIVERIES)
    got = {(r.station_ref, r.us): (r.value, r.code) for r in current_series(s, d).collect()}
    assert got == {("s", 0): (2.0, None), ("s", 5): (None, 7.0), ("s", 9): (-INF, None)}
    assert current_series(s.limit(0), d.limit(0)).count() == 0


def test_current_stations_by_arrival_then_load(spark):
    cols = "station_ref string, lon double, lat double, name string, altitude double, variable string, delivery_id long, loaded_at timestamp"
    s = spark.createDataFrame([("s", 1.0, 1.0, "old", NAN, "v", 1, t(1)), ("s", 2.0, 1.0, "new", NAN, "v", 2, t(1)), ("s", 3.0, 1.0, "newer", 5.0, "v", 2, t(2))], cols)
    d = spark.createDataFrame([(1, t(10), 0), (2, t(20), 0)], DELIVERIES)
    assert [(r.name, r.altitude) for r in current_stations(s, d).collect()] == [("newer", 5.0)]


# --- p1


def brute_rolling(daily, periods, windows):
    out = {}
    for e in {p[0] for p in periods if p[0] is not None}:
        days = {d for x, a, z in periods if x == e for d in range(a, z + 1)}
        for d in days:
            row = []
            for w in (1, *windows):
                hit = [(n, v) for x, y, n, v in daily if x == e and y is not None and d - w < y <= d]
                row.append((sum(n for n, _ in hit), sum(v for _, v in hit)))
            out[e, d] = row
    return out


def test_rolling_against_brute_force(spark):
    rng = random.Random(3)
    daily = [(rng.choice(["a", "b", "c"]), rng.randint(-400, 400), rng.randint(0, 3), float(rng.randint(-50, 50))) for _ in range(300)] + [(None, 1, 1, 1.0), ("a", None, 1, 1.0)]
    periods = [("a", -350, -200), ("a", -210, 10), ("b", 100, 100), ("d", 5, 9), (None, 0, 3), ("b", 9, 2), ("a", -350, -200)]
    d = spark.createDataFrame([(*x, 1) for x in daily], "entity string, day int, n long, total double, tile int")
    p = spark.createDataFrame(periods, "entity string, first_day int, last_day int")
    want = brute_rolling(daily, periods, (7, 30))
    for block in (2, 256):
        got = {(r.entity, r.day): r for r in rolling_totals(d, p, block_entities=block).collect()}
        assert set(got) == set(want)
        for k, ((n1, _), (n7, t7), (n30, t30)) in want.items():
            r = got[k]
            assert (r.n_day, r.n_7, r.n_30) == (n1, n7, n30) and r.total_7 == pytest.approx(t7) and r.total_30 == pytest.approx(t30)
            assert r.mean_30 == (pytest.approx(t30 / n30) if n30 else None)


def test_rolling_overflow_stays_in_its_windows(spark):
    r = spark.createDataFrame([("s", 0, 1.7e308), ("s", 1, 1.7e308), ("s", 10 * DAY, 2.0), ("s", 11 * DAY, NAN)], "station_ref string, us long, value double")
    p = spark.createDataFrame([("s", 0, 12 * DAY)], "station_ref string, starts_us long, ends_us long")
    got = {x.day: x for x in station_rolling_totals(r, p).collect()}
    assert len(got) == 12 and got[0].total_7 == INF and got[7].total_7 == 0 and got[10].total_7 == 2 and got[10].total_30 == INF and got[11].n_day == 0


def test_rolling_undefined_days_stay_in_their_windows(spark):
    d = spark.createDataFrame([("s", 0, 1, NAN), ("s", 10, 1, 2.0), ("s", 50, 1, INF), ("s", 50, 1, -INF)], "entity string, day int, n long, total double")
    got = {x.day: x for x in rolling_totals(d, spark.createDataFrame([("s", 0, 60)], "entity string, first_day int, last_day int")).collect()}
    assert got[0].total_7 is got[6].total_7 is got[29].total_30 is got[50].total_7 is got[50].mean_7 is None
    assert got[7].total_7 == 0 and got[30].total_30 == 2 and got[10].total_7 == 2 and got[57].total_7 == 0 and got[0].n_7 == 1


def test_rolling_empty(spark):
    d = spark.createDataFrame([], "entity string, day int, n long, total double")
    assert rolling_totals(d, spark.createDataFrame([], "entity string, first_day int, last_day int")).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        rolling_totals(d.drop("n"), d)


# --- p2


def brute_grid(readings, periods, gap):
    out = {}
    for dep, ref, step, a, b in periods:
        own = sorted((u, v) for r, u, v in readings if r == ref)
        for s in range(a, b, step):
            held = [v for u, v in own if s <= u < s + step]
            lo, hi = [x for x in own if x[0] <= s], [x for x in own if x[0] >= s]
            v = None
            if lo and hi and hi[0][0] - lo[-1][0] <= gap * step:
                (t0, v0), (t1, v1) = lo[-1], hi[0]
                v = v0 if t0 == t1 else v0 + (v1 - v0) * (s - t0) / (t1 - t0)
            state = "observed" if held else "missing" if v is None else "filled"
            out[dep, s] = (len(held), held[0] if v is None and held else v, state)
    return out


def test_grid_against_brute_force(spark):
    rng = random.Random(5)
    readings = [("s", u, float(rng.randint(0, 99))) for u in {rng.randint(-20 * HOUR, 300 * HOUR) for _ in range(150)}] + [("s", 40 * HOUR, 7.0), ("q", 3, 1.0)]
    periods = [(1, "s", HOUR, -5 * HOUR, 200 * HOUR + 1), (2, "s", DAY, 0, 9 * DAY), (3, "none", HOUR, 0, 3 * HOUR)]
    names = {HOUR: "1h", DAY: "day"}
    r = spark.createDataFrame([*readings, ("s", None, 1.0), ("s", 1, None), ("s", 2, NAN), ("s", 3, INF)], "station_ref string, us long, value double").withColumnRenamed("chunk", "x")
    p = spark.createDataFrame([(d, f, names[s], a, b) for d, f, s, a, b in periods] * 2 + [(4, "s", "month", 0, DAY), (5, None, "1h", 0, DAY), (6, "s", "1h", DAY, 0)], "deployment_id long, station_ref string, frequency_interval string, starts_us long, ends_us long")
    want = brute_grid(readings, periods, 3)
    for chunk in (10, 4096):
        rows = regular_grid(r, p, 3, chunk).collect()
        got = {(x.deployment_id, x.slot_us): (x.n_readings, x.value, x.state) for x in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        for k, (n, v, state) in want.items():
            assert got[k][0] == n and got[k][2] == state and got[k][1] == (None if v is None else pytest.approx(v))


def test_grid_null_ids_and_far_future(spark):
    base = 32_503_680_000_000_000
    r = spark.createDataFrame([("s", base + 1, 1.0), ("s", base + 2 * HOUR + 1, 3.0)], "station_ref string, us long, value double")
    p = spark.createDataFrame([(None, "s", "1h", base, base + 3 * HOUR)], "deployment_id long, station_ref string, frequency_interval string, starts_us long, ends_us long")
    got = sorted((x.slot_us - base, x.n_readings, x.state) for x in regular_grid(r, p).collect())
    assert got == [(0, 1, "observed"), (HOUR, 0, "filled"), (2 * HOUR, 1, "observed")]
    assert regular_grid(r.limit(0), p.limit(0)).count() == 0


# --- p3


def ids(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "id long")


def held(df):
    return sorted(r.id for r in members(df, "id").collect())


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_interval_algebra(spark, partitions):
    a = {*range(-3, 9), *range(65_530, 65_545), 200_000}
    b = {0, 1, 5, 65_535, 65_536, 65_544, 900_000}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ia, ib = intervals_of(ids(spark, [*a, *a, None]), "id"), intervals_of(ids(spark, b), "id")
        assert held(ia) == sorted(a) and held(subtract(ia, ib)) == sorted(a - b) and held(merge(ia, ib)) == sorted(a | b)
        assert {(r.lo, r.hi) for r in ia.collect()} == {(-3, 8), (65_530, 65_544), (200_000, 200_000)}
        assert {(r.lo, r.hi) for r in merge(subtract(ia, ib), ib).collect()} == {(-3, 8), (65_530, 65_544), (200_000, 200_000), (900_000, 900_000)}
        none = intervals_of(ids(spark, []), "id")
        assert held(subtract(none, ia)) == [] and held(subtract(ia, none)) == sorted(a)
        far = spark.createDataFrame([(-(1 << 62), -1), (0, 1 << 62)], "lo long, hi long")
        assert [tuple(r) for r in merge(far, none).collect()] == [(-(1 << 62), 1 << 62)]
        assert {tuple(r) for r in subtract(far, ib).collect()} >= {(-(1 << 62), -1), (2, 4), (900_001, 1 << 62)}
        rng = random.Random(2)
        numbers = [rng.randint(0, 300) for _ in range(250)]
        other = [rng.randint(0, 300) for _ in range(80)]
        assert held(subtract(intervals_of(ids(spark, numbers), "id"), intervals_of(ids(spark, other), "id"))) == sorted(set(numbers) - set(other))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_within(spark):
    iv = spark.createDataFrame([(-5, -2, "a"), (0, 0, "b"), (10, 4000, "c"), (5000, 5001, "d")], "lo long, hi long, kind string")
    rows = spark.createDataFrame([(n, 7, 8) for n in (-6, -5, -2, -1, 0, 1, 9, 10, 2047, 2048, 4000, 4001, 5001, 5001, None)], "n int, lo int, hi int")
    want = sorted([(-5, "a"), (-2, "a"), (0, "b"), (10, "c"), (2047, "c"), (2048, "c"), (4000, "c"), (5001, "d"), (5001, "d")])
    got = within(rows, iv, "n", ("kind",))
    assert got.columns == ["n", "lo", "hi", "kind"] and sorted((r.n, r.kind) for r in got.collect()) == want
    assert within(rows, iv.limit(0), "n", ("kind",)).count() == within(rows.limit(0), iv, "n").count() == 0


def test_touched_keys_are_kept_however_they_are_found(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(rng.choice("abc"), rng.randint(-40, 40) * DAY // 2, rng.randint(0, 20), i) for i in range(300)], "k string, us long, delivery_id long, v int")
    d = spark.createDataFrame([(i,) for i in range(20)], "delivery_id long")
    log = spark.createDataFrame([(i, "succeeded") for i in range(21) if i not in (3, 11)], "delivery_id long, run_status string")
    iv = delivery_intervals(d, log)
    whole = {tuple(r) for r in changed(with_pending(rows, iv), ["k", "us"], ["delivery_id"], ["v"]).collect()}
    for most in (1 << 20, 600, 0):
        assert {tuple(r) for r in changed(with_pending(touched_by(rows, iv, "k", "us", most), iv), ["k", "us"], ["delivery_id"], ["v"]).collect()} == whole
    assert whole and touched_by(rows, iv, "k", "us").count() < rows.count() == touched_by(rows, iv, "k", "us", 0).count()


def test_pending_needs_a_success(spark):
    d = spark.createDataFrame([(i,) for i in range(1, 7)], "delivery_id long")
    log = spark.createDataFrame([(1, "failed"), (1, "succeeded"), (2, "failed"), (3, "running"), (5, "succeeded"), (5, "succeeded"), (None, "succeeded"), (6, None)], "delivery_id long, run_status string")
    assert sorted((r.lo, r.hi) for r in pending_intervals(d, log).collect()) == [(2, 4), (6, 6)]


def test_changed(spark):
    rows = [("same", 1, 1.0, False), ("same", 2, 1.0, True), ("diff", 1, 1.0, False), ("diff", 2, 2.0, True), ("new", 1, None, True), ("older", 5, 1.0, False), ("older", 2, 9.0, True), ("null", 1, None, False), ("null", 2, None, True), ("gone", 1, 1.0, False), ("gone", 2, None, True), ("idle", 1, 1.0, False)]
    df = spark.createDataFrame(rows * 2, "k string, o int, v double, is_pending boolean")
    assert {(r.k, r.is_new) for r in changed(df, ["k"], ["o"], ["v"]).collect()} == {("diff", False), ("new", True), ("gone", False)}


def test_ledger_survives_failures_and_late_numbers(spark, tmp_path):
    ledger = IntervalLedger(spark, f"{tmp_path}/ledger")
    process = lambda p: members(p, "id")
    available = lambda n: intervals_of(ids(spark, n), "id")
    assert ledger.outputs() is None and ledger.run(available([]), process) is None
    assert ledger.run(available([1, 2, 4]), process) == 1

    def fails(p):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(available([1, 2, 3, 4, 5]), fails)
    assert ledger.version == 1 and held(ledger.processed()) == [1, 2, 4]
    assert ledger.run(available([1, 2, 3, 4, 5]), process) == 2  # 3 came late
    assert ledger.run(available([1, 2, 3]), process) is None
    assert sorted(r.id for r in ledger.outputs().collect()) == [1, 2, 3, 4, 5]

    def overtaken(p):
        IntervalLedger(spark, ledger.path).run(available(range(1, 8)), process)
        return process(p)

    with pytest.raises(CommitConflict):
        ledger.run(available(range(1, 8)), overtaken)
    assert sorted((r.lo, r.hi) for r in ledger.pending(2).collect()) == [(3, 3), (5, 5)]
    assert sorted(r.id for r in ledger.outputs().collect()) == list(range(1, 8))


def test_ledger_skips_nothing_that_comes_while_it_runs(spark, tmp_path):
    source, ledger = f"{tmp_path}/source", IntervalLedger(spark, f"{tmp_path}/ledger")
    add = lambda lo, hi: ids(spark, range(lo, hi)).write.mode("append").parquet(source)
    available = lambda: intervals_of(spark.read.parquet(source), "id")
    add(0, 5)

    def process(p):
        add(5, 9)
        return members(p, "id")

    assert ledger.run(available(), process) == 1 and held(ledger.processed()) == [0, 1, 2, 3, 4]
    assert ledger.run(available(), lambda p: members(p, "id")) == 2
    assert sorted(r.id for r in ledger.outputs().collect()) == list(range(9))


# --- p4

TABLES = zone_tables(["Europe/Berlin", "Asia/Kolkata", "+12:00", "America/New_York", "Nowhere/Land"])


def one(text, zone=None, order="dmy"):
    r = parse_times(pd.Series([text]), pd.Series([zone], dtype=object), pd.Series([order], dtype=object), TABLES)
    return r["state"][0] if r["state"][0] != "ok" else datetime(1970, 1, 1) + timedelta(microseconds=int(r["us"][0]))


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-03-05T06:07:08Z", None, None, "2024-03-05 06:07:08"),
        ("2024-03-05t06:07:08,25 −03:30", None, "dmy", "2024-03-05 09:37:08.250000"),
        (" 2024-03-05 06:07:08  +0530\t", None, "dmy", "2024-03-05 00:37:08"),
        ("2024-065T06:07:08Z", None, "dmy", "2024-03-05 06:07:08"),
        ("20240305T060708.123456Z", None, "dmy", "2024-03-05 06:07:08.123456"),
        ("20240305060708", "+12:00", "ymd", "2024-03-04 18:07:08"),
        ("1709618828", None, None, "2024-03-05 06:07:08"),
        ("1709618828001", None, None, "2024-03-05 06:07:08.001000"),
        ("1709618828000001", None, None, "2024-03-05 06:07:08.000001"),
        ("05/03/2024 06:07", "Asia/Kolkata", "dmy", "2024-03-05 00:37:00"),
        ("3/5/2024 12:07:00 AM", "America/New_York", "mdy", "2024-03-05 05:07:00"),
        ("24/03/05 6:07", "+12:00", "ymd", "2024-03-04 18:07:00"),
        ("05.03.24, 06:07", "+12:00", "dmy", "2024-03-04 18:07:00"),
        ("5-Mar-2024 06:07:08 CET", "Europe/Berlin", "dmy", "2024-03-05 05:07:08"),
        ("27-Oct-2024 02:30 CEST", "Europe/Berlin", "dmy", "2024-10-27 00:30:00"),
        ("27-Oct-2024 02:30 CET", "Europe/Berlin", "dmy", "2024-10-27 01:30:00"),
        ("Tue, 05 Mar 2024 06:07:08 +0000", None, "dmy", "2024-03-05 06:07:08"),
        ("2024-03-05T24:00", "+12:00", "dmy", "2024-03-05 12:00:00"),
        ("2024-02-29 00:00Z", None, "dmy", "2024-02-29 00:00:00"),
        ("2024-03-05T06:07+02", None, None, "2024-03-05 04:07:00"),
        ("2024-03-05 06:07 UTC+02:00", None, None, "2024-03-05 04:07:00"),
        ("July 1, 2021 12:00", "Europe/Berlin", None, "2021-07-01 10:00:00"),
        ("Thursday, 1 July 2021 12:00 PM", "+12:00", None, "2021-07-01 00:00:00"),
        ("Thu Jul  1 12:00:00 2021", "+12:00", None, "2021-07-01 00:00:00"),
        ("2 Sept. 2021 12:00", "+12:00", None, "2021-09-02 00:00:00"),
        ("2021-W01-1T00:00Z", None, None, "2021-01-04 00:00:00"),
        ("2020-W53-7T00:00Z", None, None, "2021-01-03 00:00:00"),
        ("2021-W53-1T00:00Z", None, None, "unreadable"),
        ("2024-03-05", "+12:00", "dmy", "no clock time"),
        ("05/03/2024", "+12:00", "dmy", "no clock time"),
        ("2016-12-31T23:59:60Z", None, None, "unreadable"),
        ("1985-07-01 12:00", "Europe/Berlin", None, "1985-07-01 10:00:00"),
        ("2045-07-01 12:00", "Europe/Berlin", None, "2045-07-01 10:00:00"),
        ("1998-07-01 12:00 CEST", "Europe/Berlin", None, "1998-07-01 10:00:00"),
        ("2024-03-05T06:07:08Z" + " " * 60, None, None, "2024-03-05 06:07:08"),
        ("2024-03-05" + " " * 5000 + "06:07:08Z", None, None, "2024-03-05 06:07:08"),
        ("27.10.2024, 02:30", "Europe/Berlin", "dmy", "ambiguous"),
        ("31.03.2024, 02:30", "Europe/Berlin", "dmy", "no such time"),
        ("5-Jul-2024 06:07:08 CET", "Europe/Berlin", "dmy", "no such time"),
        ("05/03/2024 06:07", None, "dmy", "no zone"),
        ("05/03/2024 06:07", "Nowhere/Land", "dmy", "no zone"),
        ("05/03/2024 06:07", "+12:00", None, "unreadable"),
        ("Mon, 05 Mar 2024 06:07:08 +0000", None, "dmy", "unreadable"),
        ("2023-02-29 00:00Z", None, "dmy", "unreadable"),
        ("2023-366T00:00:00Z", None, "dmy", "unreadable"),
        ("2024-03-05 25:00Z", None, "dmy", "unreadable"),
        ("13/13/2024 06:07", "+12:00", "dmy", "unreadable"),
        ("3/5/2024 13:07 PM", "+12:00", "mdy", "unreadable"),
        ("n/a", "+12:00", "dmy", "unreadable"),
        ("0000-00-00 00:00", "+12:00", "dmy", "unreadable"),
        ("x" * 100_000, "+12:00", "dmy", "unreadable"),
        ("", "+12:00", "dmy", "no text"),
        (None, "+12:00", "dmy", "no text"),
    ],
)
def test_times(text, zone, order, want):
    got = one(text, zone, order)
    assert (got if isinstance(got, str) else got.isoformat(" ")) == want


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/St_Johns", "Australia/Lord_Howe", "Pacific/Chatham", "America/New_York", "Europe/Dublin", "Africa/Casablanca", "Asia/Tehran", "Pacific/Apia", "America/Sao_Paulo"])
def test_local_times_against_the_zone_library(zone):
    tables = zone_tables([zone])
    z = ZoneInfo(zone)
    local = [datetime(y, m, 1) + timedelta(minutes=15 * i) for y in (1985, 2024, 2045) for m in (3, 4, 9, 10, 11) for i in range(0, 31 * 96, 7)]
    rng = random.Random(zone)
    local += [(datetime(1800, 1, 1) + timedelta(days=rng.uniform(0, 365 * 900))).replace(microsecond=0) for _ in range(4000)]
    got = parse_times(pd.Series([x.isoformat() for x in local]), pd.Series([zone] * len(local)), pd.Series(["dmy"] * len(local)), tables)
    for x, us, state in zip(local, got["us"], got["state"]):
        fits = {u for fold in (0, 1) if (u := x.replace(tzinfo=z, fold=fold).astimezone(UTC)).astimezone(z).replace(tzinfo=None) == x}
        assert state == ("no such time", "ok", "ambiguous")[len(fits)]
        if len(fits) == 1:
            assert t(int(us)) == fits.pop()


def test_normalise_and_pair(spark):
    rows = [(1, "s", "2024-01-01T00:00Z"), (2, "s", "1704067200"), (3, "q", "1704067200"), (4, None, "1704067200"), (5, None, "1704067200"), (6, "s", "2024-01-01T00:00Z"), (7, "s", None), (8, "s", "?")]
    df = spark.createDataFrame([(*r, None, "dmy", 5) for r in rows], "raw_id long, station_ref string, time_text string, zone_name string, date_order string, us int")
    out = normalise_times(df, TABLES)
    assert {r.raw_id: r.time_state for r in out.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "ok", 6: "ok", 7: "no text", 8: "unreadable"}
    assert sorted(map(tuple, same_instants(out.filter("time_state = 'ok'")).collect())) == [(1, 2), (1, 6), (2, 6)]
    assert sorted(map(tuple, same_instants(out.unionByName(out)).collect())) == [(1, 2), (1, 6), (2, 6)]
    assert sorted(map(tuple, instant_classes(out).collect())) == [(1, 1, 2), (2, 1, 2), (6, 1, 2)]
    assert same_instants(out.limit(0)).count() == instant_classes(out.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already has"):
        normalise_times(out, TABLES)


def test_masks_are_kept_within_bounds():
    texts = pd.Series(["x" * (i % 60) + "/" * (i // 60) for i in range(4800)])
    none = pd.Series([None] * len(texts), dtype=object)
    assert set(parse_times(texts, none, none, TABLES)["state"]) == {"unreadable", "no text"} and parser_of.cache_info().currsize <= 4096
    assert parse_times(texts[:0], none[:0], none[:0], TABLES).empty


# --- p5


def test_robust_components_separate_spikes():
    rng = np.random.default_rng(1)
    normal = np.outer(1 + rng.random(40), np.sin(np.linspace(0, 6, 48)) * 10)
    x = normal.copy()
    at = rng.choice(x.size, 30, replace=False)
    x.flat[at] += 40
    x[3, 5] = np.nan
    low = robust_components(x)
    assert np.abs(low - normal).max() < 1 and not np.isnan(low).any()


def test_spike_rule():
    base = [10.0, 10.5] * 10
    for put, want in (({9: 40.0}, {9}), ({9: 40.0, 10: 41.0, 11: 39.0}, {9, 10, 11}), ({9: 40.0, 10: 41.0, 11: 39.0, 12: 40.0}, set()), ({9: 40.0, 11: 40.0}, {9, 11}), ({9: 15.9}, set()), ({0: 40.0}, set())):
        v = np.array(base)
        for k, x in put.items():
            v[k] = x
        assert set(np.flatnonzero(spikes(v, 0.5, np.ones(len(v), bool)))) == want


def slow_spikes(v, step):
    """The rule, group against group."""
    groups = [(a, a + m) for m in (1, 2, 3) for a in range(1, len(v) - m) if max(min(v[a : a + m]) - max(v[a - 1], v[a + m]), min(v[a - 1], v[a + m]) - max(v[a : a + m])) > SPIKE_STEPS * step]
    weight = {g: min(abs(v[i] - np.median(v[max(0, i - 6) : i + 7])) for i in range(*g)) for g in groups}
    apart = lambda g, h: h[1] <= g[0] or h[0] >= g[1]
    out = set()
    for g in groups:
        if not any(apart(g, h) and (h[0] <= g[0] - 1 < h[1] or h[0] <= g[1] < h[1]) and weight[h] > weight[g] for h in groups):
            out |= set(range(*g))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_spikes_against_the_rule_and_none_goes_untested(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 700))
    us = np.cumsum(rng.integers(1, 3, n)) * int(rng.choice([60_000_000, HOUR, 9 * HOUR]))
    v = np.round(np.cumsum(rng.normal(0, 1, n)) + 5 * np.sin(us / DAY * 6.283), int(rng.integers(0, 3)))
    at = rng.random(n) < rng.choice([0.01, 0.2, 0.6])
    v[at] += rng.choice([-30, 20, 60], at.sum())
    want = slow_spikes(v.tolist(), 0.7)
    assert set(np.flatnonzero(spikes(v, 0.7, np.ones(n, bool)))) == want
    near = np.convolve(profile_suspects(us, v, 0.7), np.ones(2 * MAX_SPIKE + 3))[MAX_SPIKE + 1 :][:n] > 0
    assert set(np.flatnonzero(spikes(v, 0.7, near))) == want and LOW_STEPS > 0


def test_spikes_of_a_noisy_minute_source_are_found_at_once():
    import time

    v = np.random.default_rng(1).normal(0, 100, 138_000)
    began = time.perf_counter()
    assert spikes(v, 0.01, np.ones(len(v), bool)).any() and time.perf_counter() - began < 2


def test_every_reading_of_every_tile_is_held_against_the_rule(spark):
    rows, want, every, huge = [], set(), {"hourly": HOUR, "rare": 9 * HOUR, "dense": 60_000_000}, set()
    for name, n in (("hourly", 300), ("rare", 120), ("dense", 3000)):
        rng = np.random.default_rng(n)
        v = np.round(np.cumsum(rng.normal(0, 1, n)), 1)
        at = rng.choice(np.arange(1, n - 1), n // 12, replace=False)
        v[at] += rng.choice([-30, 20, 60], len(at))
        v[n // 3], v[n // 2] = 1e200, -1e300  # finite, too large for the squares a decomposition needs
        d = np.abs(np.diff(v)).round(6)
        want |= {(name, i) for i in slow_spikes(v.tolist(), np.median(d[d > 0]))}
        huge |= {(name, n // 3), (name, n // 2)}
        rows += [(name, i * every[name], float(x)) for i, x in enumerate(v)]
    kinds, enc = spark.createDataFrame([], "station_ref string, variable string"), spark.createDataFrame([], ENC)
    got = {(r.station_ref, r.us // every[r.station_ref]) for r in implausible_readings(_readings(spark, rows), kinds, enc, tile_days=1).collect() if r.reason == "spike"}
    assert got == want and huge <= got


def test_usual_step_is_the_exact_median(spark):
    rng = random.Random(4)
    rows = [(s, x, rng.randint(1, 3)) for s, n in (("a", 501), ("b", 500), ("one", 1), ("two", 2)) for x in (rng.choice([rng.uniform(0.001, 9), 2.0, 2.0001]) for _ in range(n))]
    got = {r.station_ref: r.usual_step for r in usual_steps(spark.createDataFrame(rows, "station_ref string, step double, n long")).collect()}
    assert got == {s: pytest.approx(np.median(np.repeat([x for k, x, _ in rows if k == s], [n for k, _, n in rows if k == s])), rel=1e-15) for s in got} and len(got) == 4


def test_a_run_that_chance_explains_is_not_stuck(spark):
    rows = [("coarse", k, n) for k, n in ((1, 258), (2, 76), (3, 35), (4, 11), (5, 6), (6, 1), (12, 1))] + [("fine", 1, 5000), ("fine", 2, 2), ("fine", 14, 1), ("long", 20, 30), ("long", 2, 90), ("none", 30, 1)]
    got = {r.station_ref: r.stuck_from for r in stuck_limits(spark.createDataFrame(rows, "station_ref string, length long, n long")).collect()}
    assert 12 < got["coarse"] < 20 and got["fine"] == 12 and got["long"] == 40 and got["none"] == 12


def _readings(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "station_ref string, us long, value double, tile int")


ENC = "variable string, min_value double, max_value double"


def test_implausible_readings(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for s, var in (("lvl", "water_level"), ("rain", "precipitation"), ("any", "unknown")):
        v = [2 + 0.5 * np.sin(i / 4) + rng.uniform(-0.05, 0.05) for i in range(24 * 250)]
        for i in (100, 2303, 2304, 5000):  # 2304 hours are a tile
            v[i] = 9.0
        for i in range(2290, 2303):
            v[i] = 2.2
        for i in range(4000, 4030):
            v[i] = 0.0
        v[50] = 99.0 if s != "any" else INF
        want |= {(s, 50, "range")} | {(s, i, "spike") for i in (100, 2303, 2304, 5000) if s != "rain"} | {(s, i, "stuck") for i in [*range(2290, 2303)] + [x for x in range(4000, 4030) if s != "rain"]}
        rows += [(s, i * HOUR, float(x)) for i, x in enumerate(v)]
    rows += [("lvl", None, 1.0), (None, 1, 1.0), ("lvl", 30 * DAY * 12, NAN), ("lvl", 30 * DAY * 13, None), ("one", 0, 1.0), ("flat", 0, 1.0), ("flat", 1, 1.0)]
    kinds = spark.createDataFrame([("lvl", "water_level"), ("rain", "precipitation"), ("any", None), ("lvl", "water_level"), ("flat", "water_level")], "station_ref string, variable string")
    enc = spark.createDataFrame([("water_level", -5.0, 30.0), ("precipitation", 0.0, 50.0), ("x", None, None)], ENC)
    got = {(r.station_ref, r.us // HOUR, r.reason) for r in implausible_readings(_readings(spark, rows), kinds, enc).collect()}
    assert got == want


def test_a_run_across_tiles_is_stuck_as_a_whole(spark):
    v = [float(i % 5) for i in range(24 * 200)]
    for i in range(2300, 2310):
        v[i] = 7.5
    v[2310:2316] = [7.5] * 6
    kinds, enc = spark.createDataFrame([("s", "water_level")], "station_ref string, variable string"), spark.createDataFrame([("water_level", -5.0, 30.0)], ENC)
    got = {r.us // HOUR for r in implausible_readings(_readings(spark, [("s", i * HOUR, x) for i, x in enumerate(v)]), kinds, enc).collect() if r.reason == "stuck"}
    assert got == set(range(2300, 2316))


def test_no_readings(spark):
    kinds, enc = spark.createDataFrame([], "station_ref string, variable string"), spark.createDataFrame([], ENC)
    assert implausible_readings(_readings(spark, []), kinds, enc).count() == 0


def test_altitudes(spark):
    rows = [("a", 100.0, 1), ("a", 101.0, 2), ("a", 99.0, 3), ("a", 700.0, 4), ("a", None, 5), ("a", NAN, 6), ("b", 100.0, 1), ("b", 700.0, 2), ("c", INF, 1), ("c", -500.0, 2), ("c", 9000.5, 3), ("d", 0.0, 1), ("d", 500.0, 2), ("d", 1000.0, 3), (None, 1e9, 1), ("e", 100.0, 1), ("e", 100.0, 1), ("e", 100.0, 1), ("e", 300.0, 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "station_ref string, altitude double, loaded_us long, middle int")
    assert {(r.station_ref, r.loaded_us, r.reason) for r in implausible_altitudes(df).collect()} == {("a", 4, "differs"), ("c", 1, "range"), ("c", 3, "range")}
    assert implausible_altitudes(df.limit(0)).count() == 0


def test_queries_run(spark, data):
    from gaugeflow.plans.problems import QUERIES

    for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found"):
        df = QUERIES[name](spark, data)
        assert df.count() == df.distinct().count() > 0
