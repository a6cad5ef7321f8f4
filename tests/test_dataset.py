import json
from datetime import UTC, datetime, timedelta

import pytest

from gaugeflow.sources.dataset import REPORT, BeforeAxis, Dataset, build_local, encodable_range, merge_dataset
from gaugeflow.sources.files import create_once, names_in, read_text
from gaugeflow.sources.publish import Catalogue, build_and_publish, update_and_publish
from gaugeflow.streaming.merge import merge_stream

T0 = datetime(2020, 1, 1, tzinfo=UTC)
META = {"frequency_interval": "1h", "utc_offset": "+00:00", "owner": "x"}
CODE = {"code": {"units": "1", "precision": 0, "min": 0, "max": 1000, "attrs": {"long_name": "quality"}}}
ENC = {"variable": "streamflow", "units": "m^3/s", "precision": 4, "min_value": 0.0, "max_value": 100000.0}
PLACES = {"A": (8.25, 47.5, "Weir"), "B": (9.75, 46.25, "Gorge"), "C": (10.5, 45.0, "Bridge"), "D": (11.0, 44.5, "Mouth")}


def stations(spark, refs="AB", altitudes=None, kind="double"):
    rows = [(r, *PLACES[r], (altitudes or {}).get(r)) for r in refs]
    return spark.createDataFrame(rows, f"station_ref string, lon double, lat double, name string, altitude {kind}")


def series(spark, data, code=None):
    rows = []
    for ref, (hour, values) in data.items():
        codes = (code or {}).get(ref, [None] * len(values))
        rows += [(ref, i, T0 + timedelta(hours=hour + i), v, c) for i, (v, c) in enumerate(zip(values, codes))]
    df = spark.createDataFrame(rows, "station_ref string, pos int, ts timestamp, value double, code double")
    return df if code is not None else df.drop("code")


BASE = {"A": (0, [1.0, 2.0, 3.0, 4.0]), "B": (0, [10.0, 11.0, 12.0, 13.0])}


@pytest.fixture
def base(spark, tmp_path):
    return build_local(f"{tmp_path}/d", META, stations(spark), series(spark, BASE), **ENC)


@pytest.fixture
def coded(spark, tmp_path):
    code = {"A": [600.0, 500.0, 600.0, 600.0], "B": [600.0] * 4}
    return build_local(f"{tmp_path}/c", META, stations(spark), series(spark, BASE, code), **ENC, ancillary=CODE)


def view(ds, plane="value"):
    ref = {r.station_id: r.station_ref for r in ds.stations().collect()}
    t0, step, n = ds.axis()
    out = {r: [None] * n for r in ref.values()}
    for r in ds.dense().collect():
        out[ref[r.station_id]][(r.us - t0) // step] = r[plane]
    return out


def test_build(spark, base):
    assert view(base) == {"A": [1, 2, 3, 4], "B": [10, 11, 12, 13]}
    assert base.manifest["axis"] | {} == base.manifest["axis"] and base.axis()[1:] == (3_600_000_000, 4)
    assert base.manifest["axis"]["time_unit"] == "h" and base.manifest["attributes"]["meta_owner"] == "x"
    assert "station_altitude" not in base.manifest["variables"]


def test_merge_is_idempotent(spark, base):
    late = series(spark, {"A": (2, [30.0, 40.0, 50.0, 60.0])})
    ds, report = merge_dataset(base, stations(spark), late)
    assert report["new_steps"] == 2 and list(report) == list(REPORT)
    ds, again = merge_dataset(ds, stations(spark), late)
    assert again["new_steps"] == 0
    assert view(ds) == {"A": [1, 2, 30, 40, 50, 60], "B": [10, 11, 12, 13, None, None]}
    assert view(Dataset(spark, base.path, 1)) == {"A": [1, 2, 3, 4], "B": [10, 11, 12, 13]}


def test_new_and_dataless_stations(spark, base):
    ds, report = merge_dataset(base, stations(spark, "ABCD"), series(spark, {"A": (2, [3.0, 4.0]), "C": (2, [99.0, 98.0])}))
    assert report["new_stations"] == 1
    assert view(ds) == {"A": [1, 2, 3, 4], "B": [10, 11, 12, 13], "C": [None, None, 99, 98]}


def test_gap(spark, base):
    ds, report = merge_dataset(base, stations(spark), series(spark, {"A": (8, [7.0])}))
    assert report["gap_steps"] == 4 and report["new_steps"] == 5 and report["written_block"] == 1
    assert view(ds)["A"] == [1, 2, 3, 4, None, None, None, None, 7]


def test_bounds(spark, base):
    ds, report = merge_dataset(base, stations(spark), series(spark, {"A": (1, [20.0, 5e9]), "B": (1, [float("inf"), 150000.0])}))
    assert report["qc_rejected"] == 3
    assert view(ds) == {"A": [1, 20, 3, 4], "B": [10, 11, 12, 13]}


def test_straddle_and_before(spark, base):
    ds, report = merge_dataset(base, stations(spark), series(spark, {"A": (-3, [7.0, 8.0, 9.0, 20.0])}))
    assert report["dropped_before_axis"] == 3 and view(ds)["A"] == [20, 2, 3, 4]
    with pytest.raises(ValueError, match="before the stored axis"):
        merge_dataset(ds, stations(spark, "ABC"), series(spark, {"C": (-3, [9.0])}))
    assert len(Dataset(spark, ds.path).stations().collect()) == 2


def test_guards(spark, base, tmp_path):
    off = series(spark, BASE).selectExpr("station_ref", "pos", "ts + INTERVAL 1 MINUTE AS ts", "value")
    with pytest.raises(ValueError, match="multiples of the step"):
        build_local(f"{tmp_path}/x", META, stations(spark), off, **ENC)
    for meta, word in (({"frequency_interval": "month"}, "calendar"), ({}, "irregular"), ({"frequency_interval": "day", "utc_offset": "+12:00"}, "shifts")):
        with pytest.raises(ValueError, match=word):
            build_local(f"{tmp_path}/x", meta, stations(spark), series(spark, BASE), **ENC)
    with pytest.raises(ValueError, match="unknown stations: B"):
        build_local(f"{tmp_path}/x", META, stations(spark, "A"), series(spark, BASE), **ENC)
    with pytest.raises(ValueError, match="undeclared"):
        merge_dataset(base, stations(spark), series(spark, BASE, {}))
    with pytest.raises(ValueError, match="no series"):
        build_local(f"{tmp_path}/x", META, stations(spark), series(spark, BASE).limit(0), **ENC)
    assert not (tmp_path / "x").exists()


def test_last_row_of_a_time_counts_also_if_missing(spark, tmp_path):
    rows = series(spark, {"A": (0, [1.0, 2.0])}).unionByName(series(spark, {"A": (0, [None, 5.0])}).selectExpr("station_ref", "pos + 10 AS pos", "ts", "value"))
    ds = build_local(f"{tmp_path}/l", META, stations(spark), rows, **ENC)
    assert view(ds) == {"A": [None, 5], "B": [None, None]}


def test_union_mask(spark, coded):
    ds, _ = merge_dataset(coded, stations(spark), series(spark, {"A": (2, [None, None])}, {"A": [100.0, 100.0]}))
    assert view(ds)["A"] == [1, 2, None, None] and view(ds, "code")["A"] == [600, 500, 100, 100]
    ds, _ = merge_dataset(ds, stations(spark), series(spark, {"B": (2, [30.0, 40.0])}))
    assert view(ds)["B"] == [10, 11, 30, 40] and view(ds, "code")["B"] == [600, 600, None, None]
    ds, _ = merge_dataset(ds, stations(spark), series(spark, {"A": (0, [None, float("nan")])}, {"A": [None, None]}))
    assert view(ds)["A"][:2] == [1, 2] and view(ds, "code")["A"][:2] == [600, 500]


def test_bounds_couple_planes(spark, coded):
    ds, report = merge_dataset(coded, stations(spark), series(spark, {"A": (4, [1e9, 5.0])}, {"A": [600.0, 32767.0]}))
    assert (report["qc_rejected"], report["anc_qc_rejected"]) == (1, 1)
    assert view(ds)["A"][4:] == [None, 5] and view(ds, "code")["A"][4:] == [None, None]


def test_altitudes(spark, tmp_path, caplog):
    given = {"A": "123.4", "B": "-9999", "C": "1e39"}
    ds = build_local(f"{tmp_path}/a", META, stations(spark, "ABCD", given, "string"), series(spark, BASE), **ENC)
    got = {r.station_ref: r.station_altitude for r in ds.stations().collect()}
    assert got == {"A": pytest.approx(123.4, rel=1e-6), "B": None, "C": None, "D": None}
    assert "B, C" in caplog.text and "station_altitude" in ds.manifest["variables"]
    with pytest.raises(Exception, match="altitude of station A is no number: n/a"):
        build_local(f"{tmp_path}/b", META, stations(spark, "AB", {"A": "n/a"}, "string"), series(spark, BASE), **ENC)


def test_empty_window_heals_attributes(spark, base):
    ds, report = merge_dataset(base, stations(spark), series(spark, BASE).limit(0))
    assert report == dict.fromkeys(REPORT, 0) and ds.version == 1
    broken = Dataset(spark, base.path)
    broken.manifest["variables"].pop("station_name")
    healed, _ = merge_dataset(broken, stations(spark), series(spark, BASE).limit(0))
    assert healed.version == 2 and json.dumps(healed.manifest, sort_keys=True) == json.dumps(base.manifest, sort_keys=True)


def test_same_place_raises(spark, tmp_path):
    twice = stations(spark, "AB").selectExpr("station_ref", "0.0D AS lon", "-0.0D AS lat", "name", "altitude")
    with pytest.raises(ValueError, match="one place"):
        build_local(f"{tmp_path}/x", META, twice, series(spark, BASE), **ENC)


def test_before_1970_and_days(spark, tmp_path):
    rows = spark.sql("SELECT 'A' AS station_ref, 0 AS pos, TIMESTAMP'1969-12-30 00:00:00' AS ts, 5.0D AS value UNION ALL SELECT 'A', 1, TIMESTAMP'1970-01-02 00:00:00', 6.0D")
    ds = build_local(f"{tmp_path}/p", META | {"frequency_interval": "day"}, stations(spark, "A"), rows, **ENC)
    assert view(ds) == {"A": [5, None, None, 6]} and sorted(ds.manifest["months"]) == ["1969-12", "1970-01"]


def test_publish_and_update(spark, tmp_path):
    cat, member = Catalogue(spark, f"{tmp_path}/cat"), f"{tmp_path}/member"
    entry = build_and_publish(cat, f"{tmp_path}/d", member, META, stations(spark), series(spark, BASE), **ENC)
    assert entry["state"] == "valid" and entry["copied"] == 3
    assert view(Dataset(spark, member)) == {"A": [1, 2, 3, 4], "B": [10, 11, 12, 13]}
    out = update_and_publish(cat, f"{tmp_path}/d", member, stations(spark), series(spark, {"A": (3, [9.0])}))
    assert out["merge"]["new_steps"] == 0 and view(Dataset(spark, member))["A"] == [1, 2, 3, 9]
    assert cat.publish(Dataset(spark, f"{tmp_path}/d"), member)["copied"] == 0
    assert [e["version"] for e in cat.entries(__import__("hashlib").sha256(member.encode()).hexdigest()[:16])] == [1, 2]


def test_publish_names_what_it_copied(spark, base, tmp_path):
    cat, member = Catalogue(spark, f"{tmp_path}/cat"), f"{tmp_path}/member"
    assert cat.publish(base, member, num_groups=2)["copied"] == 3
    ds, _ = merge_dataset(base, stations(spark, "ABC"), series(spark, {"C": (24 * 40, [9.0])}), variable="streamflow")
    assert cat.publish(ds, member)["copied"] == 3  # the new month, the stations, the manifest
    copy = Dataset(spark, member)
    assert view(copy) == view(ds) and copy.manifest["months"]["2020-01"] != copy.manifest["months"]["2020-02"]
    with pytest.raises(ValueError, match="holds 'streamflow'"):
        update_and_publish(cat, base.path, member, stations(spark), series(spark, BASE), variable="stage")


def test_a_commit_counts_once(spark, tmp_path):
    create_once(spark, f"{tmp_path}/c/1.json", "a")
    with pytest.raises(FileExistsError):
        create_once(spark, f"{tmp_path}/c/1.json", "b")
    assert read_text(spark, f"{tmp_path}/c/1.json") == "a" and names_in(spark, f"{tmp_path}/c") == ["1.json"] and names_in(spark, f"{tmp_path}/none") == []
    with pytest.raises(NotImplementedError, match="once only"):
        create_once(spark, "ftp://host/x.json", "a")


def test_other_session_zones_lose_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("SELECT 'A' AS station_ref, 0 AS pos, TIMESTAMP_NTZ'2020-01-31 23:00:00' AS ts, 5.0D AS value UNION ALL SELECT 'A', 1, TIMESTAMP_NTZ'2020-02-01 02:00:00', 6.0D")
        ds = build_local(f"{tmp_path}/z", META, stations(spark, "A"), rows, **ENC)
        t0, step, n = ds.axis()
        assert t0 == 1_580_511_600_000_000 and n == 4 and sorted(ds.manifest["months"]) == ["2020-01", "2020-02"]
        assert ds.facts(lo_us=t0).count() == 2 and ds.facts(lo_us=t0 + step).count() == 1 and ds.facts(hi_us=t0).count() == 1
        ds, _ = merge_dataset(ds, stations(spark, "A"), rows)
        assert view(ds) == {"A": [5, None, None, 6]}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_the_axis_is_checked_against_what_is_stored(spark, base):
    late = series(spark, {"A": (1, [1.0])})
    for change, word in (({"step_us": 60_000_000}, "another step"), ({"n_steps": 0}, "empty"), ({"t0_us": base.axis()[0] + 1}, "off the step"), ({"n_steps": 2}, "outside")):
        broken = Dataset(spark, base.path)
        broken.manifest["axis"] = broken.manifest["axis"] | change
        with pytest.raises(ValueError, match=word):
            merge_dataset(broken, stations(spark), late if word != "outside" else series(spark, {"A": (0, [1.0] * 4)}))
    assert Dataset(spark, base.path).version == 1


def test_limits_fall_back_to_what_can_be_encoded(spark, base):
    assert encodable_range(2, 0.0, 100.0) == (0.0, 655.34) and encodable_range(0, -5.0, 200.0) == (-5.0, 249.0)
    ds = Dataset(spark, base.path)
    for k in ("valid_min", "valid_max"):
        del ds.manifest["variables"]["streamflow"][k]
    top = encodable_range(4, 0.0, 100000.0)[1]
    ds, report = merge_dataset(ds, stations(spark), series(spark, {"A": (0, [top, top + 1, -0.001])}))
    assert report["qc_rejected"] == 2 and view(ds)["A"] == [pytest.approx(top), 2, 3, 4]


def test_one_station_and_old_versions(spark, base):
    ds, _ = merge_dataset(base, stations(spark), series(spark, {"A": (2, [30.0])}))
    a = next(r.station_id for r in ds.stations().collect() if r.station_ref == "A")
    assert ds.facts(station_ids=[a]).count() == 4 and {r.station_id for r in ds.facts(station_ids=[a]).collect()} == {a}
    assert ds.expire() == 1 and view(Dataset(spark, base.path))["A"] == [1, 2, 30, 4]
    with pytest.raises(Exception):
        Dataset(spark, base.path, 1)


def test_chunks_bound_files(spark, tmp_path):
    ds = build_local(f"{tmp_path}/k", META, stations(spark), series(spark, {"A": (0, [1.0] * 50), "B": (0, [2.0] * 50)}), **ENC, chunk_shape=(1, 20))
    files = list((tmp_path / "k" / "facts").rglob("*.parquet"))
    assert len(files) >= 5 and ds.facts().count() == 100


def test_many_unknown_stations_are_counted(spark, tmp_path):
    rows = spark.range(25).selectExpr("format_string('x%02d', id) AS station_ref", "0 AS pos", "TIMESTAMP'2020-01-01 00:00:00' AS ts", "1.0D AS value")
    with pytest.raises(ValueError, match="x00, x01, .*x09 and more, 25 in all"):
        build_local(f"{tmp_path}/x", META, stations(spark), rows, **ENC)


def test_before_the_axis_is_an_error_of_its_own(spark, base):
    with pytest.raises(BeforeAxis):
        merge_dataset(base, stations(spark), series(spark, {"A": (-3, [1.0])}))


def test_stream(spark, base, tmp_path):
    series(spark, {"A": (3, [9.0, 8.0])}).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("station_ref string, pos int, ts timestamp, value double").parquet(f"{tmp_path}/in")
    reports = []
    merge_stream(source, stations(spark), base.path, f"{tmp_path}/cp", lambda i, r: reports.append(r)).awaitTermination()
    assert view(Dataset(spark, base.path))["A"] == [1, 2, 3, 9, 8] and reports[0]["new_steps"] == 1
