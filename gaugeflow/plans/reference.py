"""Queries of the resampling and dataset operators over the tables of a directory, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.columns import finite, floor_us, known, us_of
from gaugeflow.operators import axis, quality
from gaugeflow.operators.current import current_series, current_stations, usable_readings
from gaugeflow.operators.joins import lookup_join
from gaugeflow.operators.resample import gap_threshold, prepare, resample, segments
from gaugeflow.session import shared_dir
from gaugeflow.sources.dataset import Dataset, build_local, merge_dataset
from gaugeflow.sources.publish import Catalogue, update_and_publish
from gaugeflow.sources.series import series_from_arrays as unpack_series
from gaugeflow.sources.tables import table
from gaugeflow.streaming.merge import merge_stream

Query = Callable[[SparkSession, str], DataFrame]
HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Stored slots end and incoming ones begin at these times of 2024, µs since 1970.
STORED_TO = 1_705_708_800_000_000
INCOMING_FROM = 1_705_276_800_000_000



def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def drop_missing(spark, d):
    s = table(spark, d, "series")
    return s.select("station_ref", "pos", "delivery_id", us_of("ts").alias("us"), finite("value").alias("value")).filter("us IS NOT NULL AND value IS NOT NULL")


def series_from_arrays(spark, d):
    """The lines of each order as one series, packed into arrays (an order has a few lines) and taken apart again."""
    line = F.struct("l_linenumber", "l_shipdate", "l_quantity", "l_tax")
    packed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    packed = packed.select("l_orderkey", F.col("lines.l_shipdate").alias("times"), F.col("lines.l_quantity").alias("values"), F.col("lines.l_tax").alias("tax"))
    return unpack_series(packed, "l_orderkey", extras=("tax",)).select("station_ref", "pos", us_of("ts").alias("us"), "value", "tax")


def dup_collapse(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.col("l_suppkey").cast("string"))
    return prepare(li, "key", "l_shipdate", "l_quantity").withColumn("value", F.round("value", 6))


def round_to_1min(spark, d):
    return prepare(_events(spark, d), "event_type", round_to="1min").withColumn("value", F.round("value", 6))


def local_median(spark, d):
    return segments(prepare(_events(spark, d), "event_type")).filter("d IS NOT NULL").select("series_key", "us", "d", "med")


def hole_flags(spark, d):
    s = segments(prepare(_events(spark, d), "event_type")).filter("d IS NOT NULL")
    return s.select("series_key", "us", (F.col("d") > gap_threshold()).alias("is_hole"))


def _resampled(spark, d, **args):
    return _ntz(resample(_events(spark, d), key="event_type", **args)).withColumn("value", F.round("value", 9))


def resample_stations_1h(spark, d):
    r = quality.qc_filter(usable_readings(table(spark, d, "series"), table(spark, d, "deliveries")), (-1000.0, 100000.0)).withColumn("ts", F.timestamp_micros("us"))
    return _ntz(resample(r, freq="1h", key="station_ref")).withColumn("value", F.round("value", 9))


def _qc(spark, d):
    s = table(spark, d, "series").select("station_ref", "pos", "delivery_id", us_of("ts").alias("us"), "value", F.col("quality_code").alias("code"))
    return quality.qc_filter(s, (0.0, 100.0), {"code": (0.0, 500.0)})


def qc_counts(spark, d):
    return _qc(spark, d).groupBy("station_ref").agg(F.count("*").alias("n"), F.sum(F.col("qc_rejected").cast("bigint")).alias("qc_rejected"), F.sum("anc_rejected").alias("anc_rejected"))


def _slots(spark, d, keep=None):
    """Hourly slots of the events of each type; the ancillary is the user, and values over 400 are missing."""
    e = _events(spark, d).select(F.col("event_type").alias("station_ref"), floor_us(us_of("ts"), HOUR).alias("us"), F.when(F.col("value") <= 400, F.col("value")).alias("value"), F.when(F.col("user_id") % 3 > 0, F.col("user_id").cast("double")).alias("code"), F.col("event_id").alias("pos"))
    return axis.last_of_slot(e if keep is None else e.filter(keep), ["value", "code"])


def axis_bounds(spark, d):
    return axis.axis_bounds(_slots(spark, d), HOUR)


def dense_grid(spark, d):
    s = _slots(spark, d)
    return axis.dense_grid(s.select("station_ref"), s, axis.axis_bounds(s, HOUR), HOUR, ["value", "code"])


def gap_steps(spark, d):
    return axis.gap_steps(_slots(spark, d), HOUR)


def alignment_violations(spark, d):
    s = table(spark, d, "series").select("station_ref", "pos", "delivery_id", us_of("ts").alias("us"))
    return quality.alignment_violations(s, 15 * 60_000_000)


def unknown_refs(spark, d):
    """Stations with readings whose registry rows never had an altitude."""
    st = table(spark, d, "stations").filter(known("altitude").isNotNull())
    return quality.unknown_refs(table(spark, d, "series"), st)


def active_stations(spark, d):
    s = table(spark, d, "series").select("station_ref").distinct()
    return current_stations(table(spark, d, "stations"), table(spark, d, "deliveries")).join(s, "station_ref", "left_semi").select("station_ref", "name", "variable")


def new_stations(spark, d):
    st = table(spark, d, "stations")
    old = st.filter("delivery_id % 2 = 0").select("station_ref").distinct()
    return st.filter("delivery_id % 2 = 1").select("station_ref").distinct().join(old, "station_ref", "left_anti")


def merge_overlay(spark, d):
    stored, incoming = _slots(spark, d, F.col("us") < STORED_TO), _slots(spark, d, F.col("us") >= INCOMING_FROM)
    incoming = incoming.withColumn("value", F.when(F.col("us") % (5 * HOUR) > 0, F.col("value") + 1)).withColumn("code", F.when(F.col("us") % (3 * HOUR) > 0, F.col("code")))
    return axis.overlay(stored, incoming, ["station_ref", "us"], ["value", "code"])


def altitude_qc(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string").alias("altitude"))
    return quality.altitude_qc(s).withColumn("altitude", F.col("altitude").cast("double"))


_META = {"frequency_interval": "1h", "utc_offset": "+00:00"}
_BUILD = {"variable": "reading", "units": "1", "precision": 6, "min_value": 0.0, "max_value": 100.0, "ancillary": {"code": {"units": "1", "precision": 0, "min": 0.0, "max": 500.0}}}
#: Of the merge that leaves a gap, stored rows end here and incoming ones begin 90 days later, µs since 1970.
GAP_FROM = 1_685_577_600_000_000


def _given(spark, d, which: str = "all"):
    """Current readings of the deliveries that arrived in the first half of the time ('early'), after it, or of all, put to
    hourly slots; within a slot the last time has the highest pos."""
    deliveries, series = table(spark, d, "deliveries"), table(spark, d, "series")
    if which != "all":
        arrived = us_of("arrived_at")
        r = deliveries.agg(F.min(arrived).alias("lo"), F.max(arrived).alias("hi")).first()
        middle = (r["lo"] + r["hi"]) // 2
        mine = deliveries.filter(arrived <= middle if which == "early" else arrived > middle)
        series = lookup_join(series, mine.select("delivery_id").distinct(), ["delivery_id"], "left_semi")
    return current_series(series, deliveries).select("station_ref", F.col("us").alias("pos"), F.timestamp_micros(floor_us(F.col("us"), HOUR)).alias("ts"), "value", "code")


def _places(spark, d):
    return current_stations(table(spark, d, "stations"), table(spark, d, "deliveries")).select("station_ref", "lon", "lat", "name", "altitude")


def _built(spark, d, given) -> Dataset:
    """A dataset of the readings given and of the stations that have any."""
    path = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    places = lookup_join(_places(spark, d), given.select("station_ref").distinct(), ["station_ref"], "left_semi")
    return build_local(path, _META, places, given, **_BUILD)


def _merged(spark, d, stored="early", incoming="late"):
    return merge_dataset(_built(spark, d, _given(spark, d, stored)), _places(spark, d), _given(spark, d, incoming), variable="reading")


def _facts(ds: Dataset) -> DataFrame:
    return lookup_join(ds.facts(), ds.stations().select("station_id", "station_ref"), ["station_id"]).select("station_ref", "us", "value", "code")


def dataset_build(spark, d):
    return _facts(_built(spark, d, _given(spark, d)))


def dataset_stations(spark, d):
    """Stations of the dataset; altitudes outside the possible are left out."""
    return _built(spark, d, _given(spark, d)).stations().select("station_ref", "station_name", "lon", "lat", F.col("station_altitude").cast("double").alias("altitude"))


def dataset_merge(spark, d):
    return _facts(_merged(spark, d)[0])


def dataset_merge_twice(spark, d):
    ds, _ = _merged(spark, d)
    return _facts(merge_dataset(ds, _places(spark, d), _given(spark, d, "late"))[0])


def dataset_merge_back(spark, d):
    """The later deliveries first, then the earlier ones: what lies before the axis is dropped."""
    return _facts(_merged(spark, d, "late", "early")[0])


def merge_report(spark, d):
    """Reports of merges: later deliveries onto earlier ones, the other way about, after a gap, and of nothing."""
    every = _given(spark, d)
    us = F.unix_micros("ts")
    ds = _built(spark, d, every.filter(us < GAP_FROM))
    reports = {
        "forward": _merged(spark, d)[1],
        "back": _merged(spark, d, "late", "early")[1],
        "gap": merge_dataset(ds, _places(spark, d), every.filter(us >= GAP_FROM + 90 * DAY))[1],
        "nothing": merge_dataset(ds, _places(spark, d), every.limit(0))[1],
    }
    return spark.createDataFrame([(k, *(int(v) for v in r.values())) for k, r in reports.items()], "merge string, " + ", ".join(f"{k} bigint" for k in next(iter(reports.values()))))


def publish_entry(spark, d):
    """Entries of a dataset that is published, merged and published again, and published once more."""
    ds = _built(spark, d, _given(spark, d, "early"))
    cat, member = Catalogue(spark, f"{ds.path}-catalogue"), f"{ds.path}-member"
    entries = [cat.publish(ds, member), update_and_publish(cat, ds.path, member, _places(spark, d), _given(spark, d, "late"), variable="reading")["publish"]]
    last = Dataset(spark, ds.path)
    entries.append(cat.publish(last, member))
    copy = Dataset(spark, member)
    rows = [(i, e["state"], e["version"], e["metadata"]["frequency_interval"], e["copied"] > 0, copy.axis()[2], len(copy.manifest["months"]), copy.facts().count()) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "step int, state string, version bigint, frequency_interval string, copied_any boolean, n_steps bigint, months bigint, facts bigint")


def stream_merge(spark, d):
    """The later deliveries, streamed from Parquet files into a dataset of the earlier ones."""
    ds = _built(spark, d, _given(spark, d, "early"))
    _given(spark, d, "late").write.parquet(f"{ds.path}-stream")
    source = spark.readStream.schema("station_ref string, pos bigint, ts timestamp, value double, code double").parquet(f"{ds.path}-stream")
    merge_stream(source, _places(spark, d), ds.path, f"{ds.path}-checkpoint").awaitTermination()
    return _facts(Dataset(spark, ds.path))


_ARGS = {
    "resample_mean_1h": {"freq": "1h"},
    "resample_mean_6h": {"freq": "6h"},
    "resample_mean_1d": {"freq": "day"},
    "resample_mean_1h_cov0": {"freq": "1h", "min_coverage": 0},
    "resample_mean_1h_max_gap": {"freq": "1h", "max_gap": "30min", "min_coverage": 0.5},
    "resample_mean_1h_multiplier": {"freq": "1h", "gap_multiplier": 6.0},
    "resample_mean_1h_round": {"freq": "1h", "round_to": "1min"},
    "resample_sum_1h": {"freq": "1h", "statistic": "sum"},
    "resample_sum_6h": {"freq": "6h", "statistic": "sum"},
    "resample_sum_1d": {"freq": "day", "statistic": "sum"},
    "resample_sum_6h_cov0": {"freq": "6h", "statistic": "sum", "min_coverage": 0},
}
_PLAIN = (
    drop_missing, series_from_arrays, dup_collapse, round_to_1min, local_median, hole_flags, resample_stations_1h, qc_counts, axis_bounds, dense_grid, gap_steps, alignment_violations, unknown_refs,
    active_stations, new_stations, merge_overlay, altitude_qc, dataset_build, dataset_stations, dataset_merge, dataset_merge_twice, dataset_merge_back, merge_report, publish_entry, stream_merge,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _PLAIN} | {k: partial(_resampled, **a) for k, a in _ARGS.items()} | {"qc_filter": _qc}

_FLOOR = lambda x, f: f"({x} - ((({x}) % {f}) + {f}) % {f})"
_PREP = "SELECT event_type AS k, epoch_us(ts) AS t, avg(value) AS v FROM events GROUP BY ALL"


def _segments(prep: str) -> str:
    return f"""prep AS ({prep}), seg0 AS (
  SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lag(t) OVER w AS t_1 FROM prep WINDOW w AS (PARTITION BY k ORDER BY t)
), seg1 AS (SELECT *, t1 - t AS d FROM seg0 WHERE t1 IS NOT NULL
), meds AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) < 15 THEN median(d) OVER (PARTITION BY k)
    ELSE median(d) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) END AS med FROM seg1
)"""


def _mean_sql(f: int, hole: str = "med * 3.0", cover: float = 0.75, prep: str = _PREP, digits: int = 9) -> str:
    return f"""WITH {_segments(prep)}, bins AS (
  SELECT *, unnest(range({_FLOOR("t", f)}, t1, {f})) AS b FROM meds WHERE d <= {hole}
), cut AS (SELECT *, greatest(t, b) AS a, least(t1, b + {f}) AS e FROM bins
), piece AS (
  SELECT k, b, e - a AS dur, (v + (v1 - v) * ((a - t) / d) + v + (v1 - v) * ((e - t) / d)) / 2 * (e - a) AS area FROM cut
) SELECT k AS series_key, make_timestamp(b) AS ts, round(sum(area) / sum(dur), {digits}) AS value FROM piece GROUP BY k, b HAVING sum(dur) >= {cover} * {f}"""


def _sum_sql(f: int, cover: float = 0.75) -> str:
    return f"""WITH {_segments(_PREP)}, spans AS (
  SELECT p.k, p.t, p.v, coalesce(least(p.t - q.t, q.med), o.med, 0) AS span
  FROM prep p LEFT JOIN meds q ON q.k = p.k AND q.t1 = p.t LEFT JOIN meds o ON o.k = p.k AND o.t = p.t AND o.t_1 IS NULL
) SELECT k AS series_key, make_timestamp({_FLOOR("(t - 1)", f)}) AS ts, round(sum(v), 9) AS value FROM spans GROUP BY ALL HAVING least(sum(span), {f}) >= {cover} * {f}"""


_SLOTS = f"""slots AS (
  SELECT event_type AS station_ref, {_FLOOR("epoch_us(ts)", HOUR)} AS us, CASE WHEN value <= 400 THEN value END AS value,
    CASE WHEN user_id % 3 > 0 THEN user_id::DOUBLE END AS code, event_id FROM events
)"""
_LAST = "QUALIFY row_number() OVER (PARTITION BY station_ref, us ORDER BY event_id DESC) = 1"
_QC = """qc AS (
  SELECT station_ref, pos, delivery_id, epoch_us(ts) AS us, CASE WHEN NOT isnan(value) THEN value END AS v0, CASE WHEN NOT isnan(quality_code) THEN quality_code END AS c0,
    coalesce(NOT isnan(value) AND NOT (value BETWEEN 0 AND 100), FALSE) AS qc_rejected, coalesce(NOT isnan(quality_code) AND NOT (quality_code BETWEEN 0 AND 500), FALSE)::INT AS anc_rejected FROM series
)"""


_HALF = "(SELECT (min(epoch_us(arrived_at)) + max(epoch_us(arrived_at))) // 2 FROM deliveries)"
_WHICH = {"early": f"epoch_us(d.arrived_at) <= {_HALF}", "late": f"epoch_us(d.arrived_at) > {_HALF}", "all": "TRUE"}


def _given_sql(which: str) -> str:
    return f"""SELECT station_ref, {_FLOOR("us", HOUR)} AS us, us AS pos, value, code FROM (
  SELECT s.station_ref, epoch_us(s.ts) AS us, CASE WHEN NOT isnan(s.value) THEN s.value END AS value, CASE WHEN NOT isnan(s.quality_code) THEN s.quality_code END AS code
  FROM series s JOIN deliveries d USING (delivery_id) WHERE {_WHICH[which]} AND ((s.value IS NOT NULL AND NOT isnan(s.value)) OR (s.quality_code IS NOT NULL AND NOT isnan(s.quality_code)))
  QUALIFY row_number() OVER (PARTITION BY s.station_ref, s.ts ORDER BY d.arrived_at DESC, s.delivery_id DESC, s.pos DESC) = 1
)"""


def _stored_sql(given: str) -> str:
    return f"""SELECT * FROM (
  SELECT station_ref, us, CASE WHEN value BETWEEN 0 AND 100 THEN round(value, 6) END AS value, CASE WHEN (value IS NULL OR value BETWEEN 0 AND 100) AND code BETWEEN 0 AND 500 THEN round(code, 0) END AS code
  FROM {given} QUALIFY row_number() OVER (PARTITION BY station_ref, us ORDER BY pos DESC) = 1
) WHERE coalesce(value, code) IS NOT NULL"""


def _merged_sql(stored: str, incoming: str) -> str:
    return f"""WITH a AS ({_given_sql(stored)}), b AS (SELECT * FROM ({_given_sql(incoming)}) WHERE us >= (SELECT min(us) FROM a)), stored AS ({_stored_sql("a")}), incoming AS ({_stored_sql("b")})
SELECT * FROM stored s ANTI JOIN incoming i ON i.station_ref = s.station_ref AND i.us = s.us UNION ALL SELECT * FROM incoming"""


def _report_sql(name: str, stored: str, incoming: str) -> str:
    return f"""SELECT '{name}' AS merge, * FROM (WITH a AS ({stored}), b AS ({incoming}), e AS (SELECT min(us) AS lo, max(us) AS hi FROM a), f AS (SELECT min(us) AS lo, max(us) AS hi FROM b)
  SELECT (SELECT count(DISTINCT station_ref) FROM b WHERE station_ref NOT IN (SELECT station_ref FROM a)) AS new_stations, greatest((f.hi - e.hi) // {HOUR}, 0) AS new_steps, (f.hi - greatest(f.lo, e.lo)) // {HOUR} + 1 AS written_block,
    greatest((f.lo - e.hi) // {HOUR} - 1, 0) AS gap_steps, (SELECT count(*) FROM b WHERE NOT (value BETWEEN 0 AND 100)) AS qc_rejected, (SELECT count(*) FROM b WHERE NOT (code BETWEEN 0 AND 500)) AS anc_qc_rejected,
    (SELECT count(*) FROM b WHERE us < e.lo) AS dropped_before_axis FROM e, f)"""


_RANKED = "SELECT s.*, row_number() OVER (PARTITION BY station_ref ORDER BY arrived_at DESC NULLS LAST, loaded_at DESC) AS rn FROM stations s LEFT JOIN deliveries USING (delivery_id)"

SQL: dict[str, str] = {
    "drop_missing": "SELECT station_ref, pos, delivery_id, epoch_us(ts) AS us, value FROM series WHERE ts IS NOT NULL AND value IS NOT NULL AND isfinite(value)",
    "series_from_arrays": "SELECT l_orderkey AS station_ref, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_quantity, l_tax) - 1)::INT AS pos, epoch_us(l_shipdate::TIMESTAMP) AS us, l_quantity AS value, l_tax AS tax FROM lineitem",
    "dup_collapse": "SELECT l_suppkey::VARCHAR AS series_key, epoch_us(l_shipdate::TIMESTAMP) AS us, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL",
    "round_to_1min": f"SELECT event_type AS series_key, {_FLOOR('(epoch_us(ts) + 30000000)', 60_000_000)} AS us, round(avg(value), 6) AS value FROM events GROUP BY ALL",
    "local_median": f"WITH {_segments(_PREP)} SELECT k AS series_key, t AS us, d, med FROM meds",
    "hole_flags": f"WITH {_segments(_PREP)} SELECT k AS series_key, t AS us, d > med * 3 AS is_hole FROM meds",
    "resample_mean_1h": _mean_sql(HOUR),
    "resample_mean_6h": _mean_sql(6 * HOUR),
    "resample_mean_1d": _mean_sql(DAY),
    "resample_mean_1h_cov0": _mean_sql(HOUR, cover=0),
    "resample_mean_1h_max_gap": _mean_sql(HOUR, hole="1800000000", cover=0.5),
    "resample_mean_1h_multiplier": _mean_sql(HOUR, hole="med * 6.0"),
    "resample_mean_1h_round": _mean_sql(HOUR, prep=f"SELECT event_type AS k, {_FLOOR('(epoch_us(ts) + 30000000)', 60_000_000)} AS t, avg(value) AS v FROM events GROUP BY ALL"),
    "resample_sum_1h": _sum_sql(HOUR),
    "resample_sum_6h": _sum_sql(6 * HOUR),
    "resample_sum_1d": _sum_sql(DAY),
    "resample_sum_6h_cov0": _sum_sql(6 * HOUR, 0),
    "resample_stations_1h": _mean_sql(
        HOUR,
        prep="""SELECT station_ref AS k, us AS t, value AS v FROM (
  SELECT s.station_ref, epoch_us(s.ts) AS us, s.value, row_number() OVER (PARTITION BY s.station_ref, s.ts ORDER BY d.arrived_at DESC NULLS LAST, s.delivery_id DESC, s.pos DESC) AS rn
  FROM series s LEFT JOIN deliveries d USING (delivery_id) WHERE (s.value IS NOT NULL AND NOT isnan(s.value)) OR (s.quality_code IS NOT NULL AND NOT isnan(s.quality_code))
) WHERE rn = 1 AND value BETWEEN -1000 AND 100000""",
    ),
    "qc_filter": f"WITH {_QC} SELECT station_ref, pos, delivery_id, us, CASE WHEN NOT qc_rejected THEN v0 END AS value, CASE WHEN NOT qc_rejected AND anc_rejected = 0 THEN c0 END AS code, qc_rejected, anc_rejected FROM qc",
    "qc_counts": f"WITH {_QC} SELECT station_ref, count(*) AS n, sum(qc_rejected::INT)::BIGINT AS qc_rejected, sum(anc_rejected)::BIGINT AS anc_rejected FROM qc GROUP BY 1",
    "axis_bounds": f"WITH {_SLOTS} SELECT min(us) AS t0_us, max(us) AS tn_us, (max(us) - min(us)) // {HOUR} + 1 AS n_steps FROM slots",
    "dense_grid": f"""WITH {_SLOTS}, last AS (SELECT * FROM slots {_LAST}), steps AS (SELECT unnest(range(min(us), max(us) + 1, {HOUR})) AS us FROM slots)
SELECT s.station_ref, t.us, l.value, l.code FROM (SELECT DISTINCT station_ref FROM slots) s CROSS JOIN steps t LEFT JOIN last l ON l.station_ref = s.station_ref AND l.us = t.us""",
    "gap_steps": f"""WITH {_SLOTS} SELECT * FROM (
  SELECT station_ref, us, (lead(us) OVER (PARTITION BY station_ref ORDER BY us) - us) // {HOUR} - 1 AS gap_steps FROM (SELECT DISTINCT station_ref, us FROM slots)
) WHERE gap_steps > 0""",
    "alignment_violations": "SELECT * FROM (SELECT station_ref, pos, delivery_id, epoch_us(ts) AS us, ((epoch_us(ts) % 900000000) + 900000000) % 900000000 AS residue_us FROM series) WHERE residue_us <> 0",
    "unknown_refs": "SELECT DISTINCT station_ref FROM series WHERE station_ref NOT IN (SELECT station_ref FROM stations WHERE altitude IS NOT NULL AND NOT isnan(altitude))",
    "active_stations": f"SELECT station_ref, name, variable FROM ({_RANKED}) WHERE rn = 1 AND station_ref IN (SELECT station_ref FROM series)",
    "new_stations": "SELECT DISTINCT station_ref FROM stations WHERE delivery_id % 2 = 1 AND station_ref NOT IN (SELECT station_ref FROM stations WHERE delivery_id % 2 = 0)",
    "merge_overlay": f"""WITH {_SLOTS}, stored AS (SELECT station_ref, us, value, code FROM slots WHERE us < {STORED_TO} {_LAST}), incoming AS (
  SELECT station_ref, us, CASE WHEN us % {5 * HOUR} > 0 THEN value + 1 END AS value, CASE WHEN us % {3 * HOUR} > 0 THEN code END AS code FROM (SELECT * FROM slots WHERE us >= {INCOMING_FROM} {_LAST})
), given AS (SELECT * FROM incoming WHERE coalesce(value, code) IS NOT NULL)
SELECT * FROM stored s ANTI JOIN given g ON g.station_ref = s.station_ref AND g.us = s.us UNION ALL SELECT * FROM given""",
    "altitude_qc": "SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN -500 AND 9000 THEN s_acctbal::FLOAT::DOUBLE END AS altitude, NOT (s_acctbal BETWEEN -500 AND 9000) AS altitude_rejected FROM supplier",
    "dataset_build": f"WITH given AS ({_given_sql('all')}) {_stored_sql('given')}",
    "dataset_stations": f"""SELECT station_ref, name AS station_name, lon, lat, CASE WHEN altitude BETWEEN -500 AND 9000 THEN altitude::FLOAT::DOUBLE END AS altitude FROM ({_RANKED}) WHERE rn = 1
AND station_ref IN (SELECT station_ref FROM ({_given_sql('all')}))""",
    "dataset_merge": _merged_sql("early", "late"),
    "dataset_merge_twice": _merged_sql("early", "late"),
    "dataset_merge_back": _merged_sql("late", "early"),
    "stream_merge": _merged_sql("early", "late"),
    "publish_entry": f"""WITH a AS ({_given_sql("all")}), merged AS ({_merged_sql("early", "late")})
SELECT unnest([0, 1, 2])::INT AS step, 'valid' AS state, unnest([1, 2, 2])::BIGINT AS version, '1h' AS frequency_interval, unnest([TRUE, TRUE, FALSE]) AS copied_any,
  ((SELECT max(us) FROM a) - (SELECT min(us) FROM ({_given_sql("early")}))) // {HOUR} + 1 AS n_steps, (SELECT count(DISTINCT strftime(make_timestamp(us), '%Y-%m')) FROM merged) AS months, (SELECT count(*) FROM merged) AS facts""",
    "merge_report": " UNION ALL ".join((
        _report_sql("forward", _given_sql("early"), _given_sql("late")),
        _report_sql("back", _given_sql("late"), _given_sql("early")),
        _report_sql("gap", f"SELECT * FROM ({_given_sql('all')}) WHERE us < {GAP_FROM}", f"SELECT * FROM ({_given_sql('all')}) WHERE us >= {GAP_FROM + 90 * DAY}"),
        "SELECT 'nothing', 0, 0, 0, 0, 0, 0, 0",
    )),
}
