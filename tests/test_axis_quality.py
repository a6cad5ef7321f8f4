import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeflow.operators import axis, quality
from gaugeflow.operators.neighbours import in_order, with_neighbours

H = 3_600_000_000
DAY = 24 * H


def slots(spark, rows):
    return spark.createDataFrame(rows, "station_ref string, us long, value double, code double, pos long, tile int")


def test_neighbours_against_whole_windows(spark):
    rng = random.Random(4)
    rows = [(k, u, float(u)) for k in "ab" for u in sorted({rng.randint(-400, 400) * DAY // 3 for _ in range(120)})] + [("c", 0, 1.0), (None, 0, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, u long, v double")
    whole, tiled = Window.partitionBy("k").orderBy("u"), Window.partitionBy("k", "tile").orderBy("u")
    see = lambda w: [F.lag("v", 3).over(w).alias("lag3"), F.lead("v", 3).over(w).alias("lead3"), F.sum("v").over(w.rowsBetween(-3, 3)).alias("s")]
    want = {tuple(r) for r in df.dropna().select("k", "u", *see(whole)).collect()}
    for rows_ in (3, 5, 16, 8192):
        near = with_neighbours(df, "k", "u", ["v"], 3, rows_).select("k", "u", "is_core", *see(tiled)).filter("is_core").drop("is_core")
        assert sorted(map(tuple, near.collect())) == sorted(want)
    sizes = [r["count"] for r in with_neighbours(df, "k", "u", ["v"], 3, 16).groupBy("tile").count().collect()]
    assert max(sizes) <= 22 and with_neighbours(df.limit(0), "k", "u", ["v"], 3).count() == 0  # rows of one key don't gather
    places = sorted(r.place for r in in_order(df.repartition(5), "k", "u", []).collect())
    assert places == list(range(df.dropna().count()))


def test_axis(spark):
    s = slots(spark, [("a", -2 * H, 1.0, None, 0, 7), ("a", H, None, 5.0, 1, 7), ("b", 4 * H, 2.0, None, 0, 7), ("a", 4 * H, 3.0, None, 0, 7), ("a", 4 * H, None, None, 1, 7)])
    b = axis.axis_bounds(s, H)
    assert tuple(b.first()) == (-2 * H, 4 * H, 7)
    last = axis.last_of_slot(s, ["value", "code"])
    assert {(r.station_ref, r.us, r.value, r.code) for r in last.collect() if r.us == 4 * H} == {("a", 4 * H, None, None), ("b", 4 * H, 2.0, None)}
    st = spark.createDataFrame([("a",), ("b",), ("idle",), ("a",), (None,)], "station_ref string")
    dense = axis.dense_grid(st, last, b, H, ["value", "code"]).collect()
    assert len(dense) == 21 and sum(r.value is not None for r in dense) == 2 and sum(r.code is not None for r in dense) == 1
    assert {tuple(r) for r in axis.gap_steps(s, H).collect()} == {("a", -2 * H, 2), ("a", H, 2)}
    none = s.limit(0)
    assert tuple(axis.axis_bounds(none, H).first()) == (None, None, 0)
    assert axis.dense_grid(st, none, axis.axis_bounds(none, H), H, ["value"]).count() == axis.gap_steps(none, H).count() == 0


def test_long_axis_in_chunks(spark):
    st, s = spark.createDataFrame([("a",)], "station_ref string"), slots(spark, [("a", 0, 1.0, None, 0, 0), ("a", 25_001 * H, 2.0, None, 0, 0)])
    assert axis.dense_grid(st, s, axis.axis_bounds(s, H), H, ["value"]).select("us").distinct().count() == 25_002


def test_overlay_mask(spark):
    old = slots(spark, [("a", 0, 1.0, 9.0, 0, 0), ("a", H, 1.0, 9.0, 0, 0), ("a", 2 * H, 1.0, 9.0, 0, 0)])
    new = slots(spark, [("a", 0, None, None, 0, 0), ("a", H, None, 4.0, 0, 0), ("a", 2 * H, 5.0, None, 0, 0), ("b", 0, 6.0, None, 0, 0)])
    got = {tuple(r) for r in axis.overlay(old, new, ["station_ref", "us"], ["value", "code"]).collect()}
    assert got == {("a", 0, 1.0, 9.0), ("a", H, None, 4.0), ("a", 2 * H, 5.0, None), ("b", 0, 6.0, None)}
    again = axis.overlay(spark.createDataFrame(sorted(got), "station_ref string, us long, value double, code double"), new, ["station_ref", "us"], ["value", "code"])
    assert {tuple(r) for r in again.collect()} == got


def test_bounds(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(i, v, c, "x") for i, (v, c) in enumerate([(0.0, 5.0), (10.0, 99.0), (10.1, 5.0), (inf, None), (nan, 5.0), (None, -1.0)])], "i int, value double, code double, lo string")
    got = [(r.value, r.code, r.qc_rejected, r.anc_rejected) for r in quality.qc_filter(df, (0.0, 10.0), {"code": (0.0, None)}).orderBy("i").collect()]
    assert got == [(0.0, 5.0, False, 0), (10.0, 99.0, False, 0), (None, None, True, 0), (None, None, True, 0), (None, 5.0, False, 0), (None, None, False, 1)]


def test_altitudes(spark):
    df = spark.createDataFrame([("a", "12.5"), ("b", None), ("c", "NaN"), ("d", "-9999"), ("e", "1e39"), ("f", "9000"), ("g", "inf")], "station_ref string, altitude string")
    out = quality.altitude_qc(df)
    assert {r.station_ref: (r.altitude, r.altitude_rejected) for r in out.collect()} == {"a": (12.5, False), "b": (None, False), "c": (None, False), "d": (None, True), "e": (None, True), "f": (9000.0, False), "g": (None, True)}
    assert quality.warn_rejected_altitudes(out) == ["d", "e", "g"]


def test_guards(spark):
    s = slots(spark, [("a", 0, 1.0, None, 0, 0), ("z", -H + 1, 1.0, None, 0, 0), ("z", 5, 1.0, None, 0, 0)])
    with pytest.raises(ValueError, match="^2 times.*first: -3599999999 us, off by 1 us"):
        quality.check_aligned(s, H)
    quality.check_aligned(s.limit(0), H)
    st = spark.createDataFrame([("a",), (None,)], "station_ref string")
    with pytest.raises(ValueError, match="unknown stations: z"):
        quality.check_refs(s, st)
    with pytest.raises(ValueError, match="undeclared ancillaries: code, tile"):
        quality.check_roster(s.drop("us"), ["other"])


def test_series_from_arrays(spark):
    from gaugeflow.sources.series import series_from_arrays

    schema = "station_ref string, times array<long>, values array<double>, code array<double>, pos string"
    df = spark.createDataFrame([("a", [5, 6], [1.0, None], [7.0, 8.0], "x"), ("b", [], [], None, "x"), ("c", None, [1.0], [1.0], "x"), ("d", [9], [2.0], None, "x")], schema)
    got = [tuple(r) for r in series_from_arrays(df, extras=("code",)).orderBy("station_ref", "pos").collect()]
    assert got == [("a", 0, 5, 1.0, 7.0), ("a", 1, 6, None, 8.0), ("d", 0, 9, 2.0, None)]
    for bad in (("e", [1, 2], [1.0], None, "x"), ("e", [], [], [1.0], "x"), ("e", [1], None, None, "x")):
        with pytest.raises(Exception, match="unlike length in series e"):
            series_from_arrays(spark.createDataFrame([bad], schema), extras=("code",)).collect()
