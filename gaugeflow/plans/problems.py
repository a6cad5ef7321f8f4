"""Queries p1 to p5 over the tables of a directory, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.columns import DAY_US, us_of
from gaugeflow.operators.current import current_series, current_stations, deployment_periods, station_rows, supplied_readings, usable_readings
from gaugeflow.operators.implausible import implausible_altitudes, implausible_readings
from gaugeflow.operators.incremental import IntervalLedger, changed, delivery_intervals, intervals_of, pending_intervals, touched_by, with_pending, within
from gaugeflow.operators.regular_grid import regular_grid
from gaugeflow.operators.rolling import station_rolling_totals
from gaugeflow.operators.timestamps import delivered_times, instant_classes, same_instants
from gaugeflow.session import shared_dir
from gaugeflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _day(c: str):
    return F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")


def _digits(c: str):
    """Twelve significant digits: sums in another order, of readings as large as 1e36, come out alike."""
    return F.format_string("%.11e", F.col(c)).cast("double")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    readings = usable_readings(table(spark, d, "series"), table(spark, d, "deliveries"))
    return station_rolling_totals(readings, deployment_periods(table(spark, d, "deployments")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Days of a deployment without usable reading whose trailing 7 or 30 days hold one."""
    quiet = _rolling(spark, d).filter("n_day = 0")
    both = F.filter(F.array(*[F.when(F.col(f"n_{w}") > 0, F.lit(w)) for w in (7, 30)]), lambda x: x.isNotNull())
    return quiet.select("station_ref", _day("day").alias("day"), F.explode(both).alias("trailing_days"))


def p1_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sum and mean of the trailing 7 and 30 days, for every station and day of its deployments."""
    out = _rolling(spark, d).select("station_ref", _day("day").alias("day"), "n_day", "n_7", _digits("total_7").alias("total_7"), "n_30", _digits("total_30").alias("total_30"))
    means = {f"mean_{w}": F.when(F.col(f"n_{w}") > 0, F.col(f"total_{w}") / F.col(f"n_{w}")) for w in (7, 30)}
    return out.withColumns(means)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    readings = usable_readings(table(spark, d, "series"), table(spark, d, "deliveries"))
    return regular_grid(readings, deployment_periods(table(spark, d, "deployments")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Empty slots of all deployments."""
    return _grid(spark, d).filter("state <> 'observed'").select("station_ref", "slot_us").distinct()


def p2_regular_grid(spark: SparkSession, d: str) -> DataFrame:
    """A row per slot, filled or marked."""
    return _grid(spark, d).withColumn("value", F.round("value", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Times and stations that are new or changed against what was processed."""
    deliveries = table(spark, d, "deliveries")
    intervals = delivery_intervals(deliveries, table(spark, d, "run_log"))
    readings = supplied_readings(table(spark, d, "series"), deliveries)
    s = changed(with_pending(touched_by(readings, intervals, "station_ref", "us"), intervals), ["station_ref", "us"], ["arrived_us", "delivery_id", "pos"], ["value", "code"])
    t = changed(with_pending(station_rows(table(spark, d, "stations"), deliveries), intervals), ["station_ref"], ["arrived_us", "loaded_us"], ["lon", "lat", "name", "altitude"])
    return s.select(F.lit("series").alias("table_name"), "station_ref", F.col("us").alias("at_us")).unionByName(t.select(F.lit("stations").alias("table_name"), "station_ref", F.lit(-1).cast("bigint").alias("at_us")))


def p3_pending_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that are still to be processed, as disjoint intervals."""
    return pending_intervals(table(spark, d, "deliveries"), table(spark, d, "run_log")).select("lo", "hi")


def p3_ledger_runs(spark: SparkSession, d: str) -> DataFrame:
    """What a ledger processes in runs over the deliveries: (run, lo, hi, n_rows), n_rows being the rows of `series` of
    the deliveries lo to hi; run 0 is what it holds at the end.

    Run 1 finds the deliveries of the first half of the time, whose ids are full of gaps. Run 2 finds all and fails. Run 3
    finds the same and gets exactly those that came late or new; run 4 finds nothing to do.
    """
    deliveries, series = table(spark, d, "deliveries"), table(spark, d, "series")
    arrived = deliveries.select("delivery_id", us_of("arrived_at").alias("us"))
    r = arrived.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    early = intervals_of(arrived.filter(F.col("us") <= (r["lo"] + r["hi"]) // 2), "delivery_id")
    everything = intervals_of(arrived, "delivery_id")
    ledger = IntervalLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    rows_of = lambda p: within(series.select("station_ref", "ts", "delivery_id"), p, "delivery_id")

    def fails(pending: DataFrame) -> DataFrame:
        raise RuntimeError("lost")

    done = {1: ledger.run(early, rows_of)}
    try:
        ledger.run(everything, fails)
    except RuntimeError:
        pass
    done[3], done[4] = ledger.run(everything, rows_of), ledger.run(everything, rows_of)
    out = ledger.processed().withColumn("run", F.lit(0))
    for run, version in done.items():
        out = out if version is None else out.unionByName(ledger.pending(version).withColumn("run", F.lit(run)))
    n = within(ledger.outputs().groupBy("delivery_id").agg(F.count("*").alias("n")), ledger.processed(), "delivery_id")
    held = [within(n, out.filter(F.col("run") == r), "delivery_id", ("lo", "hi", "run")) for r in (0, 1, 3)]
    counted = held[0].unionByName(held[1]).unionByName(held[2]).groupBy("run", "lo", "hi").agg(F.sum("n").alias("n_rows"))
    return out.join(counted, ["run", "lo", "hi"], "left").select("run", "lo", "hi", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return delivered_times(table(spark, d, "raw_series"), table(spark, d, "feeds"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of one station whose texts name the same instant."""
    return same_instants(_times(spark, d).filter("time_state = 'ok'"))


def p4_normalised_times(spark: SparkSession, d: str) -> DataFrame:
    """The instant of each record, or why it has none."""
    return _times(spark, d).select("raw_id", "instant_us", "time_state")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Records that share their instant: the smallest id among them and the number of links, a row each."""
    return instant_classes(_times(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Faulty values and altitudes."""
    deliveries, stations = table(spark, d, "deliveries"), table(spark, d, "stations")
    current = current_series(table(spark, d, "series"), deliveries)
    v = implausible_readings(current, current_stations(stations, deliveries), table(spark, d, "encodings"))
    a = implausible_altitudes(station_rows(stations, deliveries))
    return (
        v.select(F.lit("value").alias("field_name"), "station_ref", F.col("us").alias("at_us"))
        .unionByName(a.select(F.lit("altitude").alias("field_name"), "station_ref", F.col("loaded_us").alias("at_us")))
        .distinct()
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_rolling_totals, p2_found, p2_regular_grid, p3_found, p3_pending_intervals, p3_ledger_runs, p4_found, p4_normalised_times, p4_classes, p5_found)}

_SUPPLIED = """supplied AS (
  SELECT s.station_ref, epoch_us(s.ts) AS us, CASE WHEN NOT isnan(s.value) THEN s.value END AS value,
    CASE WHEN NOT isnan(s.quality_code) THEN s.quality_code END AS code, s.delivery_id, s.pos, epoch_us(d.arrived_at) AS arrived
  FROM series s LEFT JOIN deliveries d USING (delivery_id)
  WHERE (s.value IS NOT NULL AND NOT isnan(s.value)) OR (s.quality_code IS NOT NULL AND NOT isnan(s.quality_code))
)"""
_CURRENT = f"""{_SUPPLIED}, current AS (
  SELECT station_ref, us, value, code FROM supplied
  QUALIFY row_number() OVER (PARTITION BY station_ref, us ORDER BY arrived DESC NULLS LAST, delivery_id DESC, pos DESC) = 1
), usable AS (SELECT station_ref, us, value FROM current WHERE value IS NOT NULL AND NOT isinf(value))"""
_FLOOR = lambda x, f: f"({x} - ((({x}) % {f}) + {f}) % {f})"
_ROLLING = f"""WITH {_CURRENT}, daily AS (
  SELECT station_ref, ({_FLOOR("us", DAY_US)} // {DAY_US})::INT AS day, count(*) AS n, sum(value) AS total FROM usable GROUP BY ALL
), days AS (
  SELECT DISTINCT station_ref, unnest(range(({_FLOOR("epoch_us(starts_at)", DAY_US)} // {DAY_US})::BIGINT, ({_FLOOR("(epoch_us(ends_at) - 1)", DAY_US)} // {DAY_US})::BIGINT + 1))::INT AS day FROM deployments
), rolling AS (
  SELECT g.station_ref, strftime(DATE '1970-01-01' + g.day, '%Y-%m-%d') AS day, coalesce(sum(n) FILTER (d.day = g.day), 0)::BIGINT AS n_day,
    coalesce(sum(n) FILTER (d.day > g.day - 7), 0)::BIGINT AS n_7, printf('%.11e', coalesce(sum(total) FILTER (d.day > g.day - 7), 0))::DOUBLE AS total_7,
    coalesce(sum(n), 0)::BIGINT AS n_30, printf('%.11e', coalesce(sum(total), 0))::DOUBLE AS total_30
  FROM days g LEFT JOIN daily d ON d.station_ref = g.station_ref AND d.day BETWEEN g.day - 29 AND g.day GROUP BY g.station_ref, g.day
)"""
_STEP = "CASE frequency_interval WHEN '1min' THEN 60000000 WHEN '15min' THEN 900000000 WHEN '30min' THEN 1800000000 WHEN '1h' THEN 3600000000 WHEN 'day' THEN 86400000000 END"
_SLOTS = f"""periods AS (SELECT DISTINCT deployment_id, station_ref, {_STEP} AS step, epoch_us(starts_at) AS a, epoch_us(ends_at) AS b FROM deployments),
slots AS (SELECT deployment_id, station_ref, step, a, unnest(range(a, b, step)) AS slot_us FROM periods),
held AS (
  SELECT p.deployment_id, p.station_ref, p.a + {_FLOOR("(u.us - p.a)", "p.step")} AS slot_us, count(*) AS n, min_by(value, us) AS first_v
  FROM periods p JOIN usable u ON u.station_ref = p.station_ref AND u.us >= p.a AND u.us < p.b GROUP BY ALL
)"""
_DIFF = """, done AS (SELECT DISTINCT delivery_id FROM run_log WHERE run_status = 'succeeded')"""

SQL: dict[str, str] = {
    "p1_found": f"""{_ROLLING} SELECT station_ref, day, 7::INT AS trailing_days FROM rolling WHERE n_day = 0 AND n_7 > 0
UNION ALL SELECT station_ref, day, 30::INT FROM rolling WHERE n_day = 0 AND n_30 > 0""",
    "p1_rolling_totals": f"""{_ROLLING} SELECT station_ref, day, n_day, n_7, total_7, n_30, total_30, CASE WHEN n_7 > 0 THEN total_7 / n_7 END AS mean_7, CASE WHEN n_30 > 0 THEN total_30 / n_30 END AS mean_30 FROM rolling""",
    "p2_found": f"""WITH {_CURRENT}, {_SLOTS} SELECT DISTINCT s.station_ref, s.slot_us FROM slots s LEFT JOIN held h USING (deployment_id, station_ref, slot_us) WHERE h.n IS NULL""",
    "p2_regular_grid": f"""WITH {_CURRENT}, {_SLOTS}, sided AS (
  SELECT s.*, p.us AS t0, p.value AS v0 FROM slots s ASOF LEFT JOIN usable p ON p.station_ref = s.station_ref AND p.us <= s.slot_us
), both_sides AS (
  SELECT s.*, q.us AS t1, q.value AS v1 FROM sided s ASOF LEFT JOIN usable q ON q.station_ref = s.station_ref AND q.us >= s.slot_us
), valued AS (
  SELECT *, CASE WHEN t0 = slot_us THEN v0 WHEN t1 - t0 <= 3 * step
    THEN v0 * (1 - (slot_us - t0)::DOUBLE / (t1 - t0)) + v1 * ((slot_us - t0)::DOUBLE / (t1 - t0)) END AS x FROM both_sides
) SELECT v.deployment_id, v.station_ref, v.slot_us, coalesce(h.n, 0) AS n_readings, round(coalesce(x, h.first_v), 6) AS value,
  CASE WHEN h.n IS NOT NULL THEN 'observed' WHEN x IS NULL THEN 'missing' ELSE 'filled' END AS state
FROM valued v LEFT JOIN held h USING (deployment_id, station_ref, slot_us)""",
    "p3_found": f"""WITH {_SUPPLIED}{_DIFF}, old AS (
  SELECT * FROM supplied SEMI JOIN done USING (delivery_id) QUALIFY row_number() OVER (PARTITION BY station_ref, us ORDER BY arrived DESC NULLS LAST, delivery_id DESC, pos DESC) = 1
), now AS (
  SELECT * FROM supplied QUALIFY row_number() OVER (PARTITION BY station_ref, us ORDER BY arrived DESC NULLS LAST, delivery_id DESC, pos DESC) = 1
), st AS (
  SELECT station_ref, CASE WHEN NOT isnan(lon) THEN lon END AS lon, CASE WHEN NOT isnan(lat) THEN lat END AS lat, name,
    CASE WHEN NOT isnan(altitude) THEN altitude END AS altitude, delivery_id, loaded_at, arrived_at FROM stations LEFT JOIN deliveries USING (delivery_id)
), st_old AS (
  SELECT * FROM st SEMI JOIN done USING (delivery_id) QUALIFY row_number() OVER (PARTITION BY station_ref ORDER BY arrived_at DESC, loaded_at DESC) = 1
), st_now AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY station_ref ORDER BY arrived_at DESC, loaded_at DESC) = 1)
SELECT 'series' AS table_name, n.station_ref, n.us AS at_us FROM now n LEFT JOIN old o USING (station_ref, us)
WHERE o.us IS NULL OR o.value IS DISTINCT FROM n.value OR o.code IS DISTINCT FROM n.code
UNION ALL SELECT 'stations', n.station_ref, -1 FROM st_now n LEFT JOIN st_old o USING (station_ref)
WHERE o.delivery_id IS NULL OR o.lon IS DISTINCT FROM n.lon OR o.lat IS DISTINCT FROM n.lat OR o.name IS DISTINCT FROM n.name OR o.altitude IS DISTINCT FROM n.altitude""",
    "p3_pending_intervals": """WITH pending AS (
  SELECT delivery_id AS id FROM deliveries WHERE delivery_id NOT IN (SELECT delivery_id FROM run_log WHERE run_status = 'succeeded')
) SELECT min(id) AS lo, max(id) AS hi FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM pending) GROUP BY g""",
    "p3_ledger_runs": """WITH middle AS (SELECT (min(epoch_us(arrived_at)) + max(epoch_us(arrived_at))) // 2 AS us FROM deliveries),
first AS (SELECT DISTINCT delivery_id AS id FROM deliveries, middle WHERE epoch_us(arrived_at) <= us),
found AS (
  SELECT 0 AS run, delivery_id AS id FROM (SELECT DISTINCT delivery_id FROM deliveries)
  UNION ALL SELECT 1, id FROM first UNION ALL SELECT 3, delivery_id FROM (SELECT DISTINCT delivery_id FROM deliveries) WHERE delivery_id NOT IN (SELECT id FROM first)
), counted AS (SELECT delivery_id AS id, count(*) AS n FROM series GROUP BY 1
), islands AS (SELECT run, id, id - row_number() OVER (PARTITION BY run ORDER BY id) AS g, coalesce(n, 0) AS n FROM found LEFT JOIN counted USING (id))
SELECT run, min(id) AS lo, max(id) AS hi, sum(n)::BIGINT AS n_rows FROM islands GROUP BY run, g""",
}
SQL["p5_found"] = f"""WITH {_CURRENT}, kinds AS (
  SELECT station_ref, variable, min_value, max_value FROM (
    SELECT s.station_ref, s.variable, row_number() OVER (PARTITION BY s.station_ref ORDER BY d.arrived_at DESC NULLS LAST, s.loaded_at DESC) AS rn FROM stations s LEFT JOIN deliveries d USING (delivery_id)
  ) JOIN encodings USING (variable) WHERE rn = 1
), judged AS (
  SELECT c.station_ref, us, value, variable, value BETWEEN min_value AND max_value AS inside FROM current c JOIN kinds USING (station_ref) WHERE value IS NOT NULL
), sound AS (
  SELECT station_ref, us, value, variable, row_number() OVER w AS i, lag(value) OVER w AS prev FROM judged WHERE inside WINDOW w AS (PARTITION BY station_ref ORDER BY us)
), usual AS (SELECT station_ref, median(round(abs(value - prev), 9)) AS step FROM sound WHERE round(abs(value - prev), 9) > 0 GROUP BY 1
), islands AS (SELECT *, sum((prev IS NULL OR value <> prev)::INT) OVER (PARTITION BY station_ref ORDER BY us) AS run FROM sound
), runs AS (
  SELECT station_ref, run, count(*) AS n FROM islands WHERE NOT (value = 0 AND variable IN ('precipitation', 'streamflow')) GROUP BY ALL
), tallied AS (
  SELECT station_ref, count(*) AS n_all, count(*) FILTER (n >= 12) AS longs, count(*) FILTER (n < 12) AS shorts, sum(n) FILTER (n < 12) AS readings, max(n) FILTER (n < 12) AS short, quantile_cont(n, 0.95) AS q95 FROM runs GROUP BY 1
), limits AS (
  SELECT station_ref, greatest(12, 2 * CASE WHEN longs >= 5 AND longs * 20 > n_all THEN greatest(q95, coalesce(short, 0))
    WHEN readings > shorts THEN greatest(short, 1 + ln(shorts / 0.2) / -ln(1 - shorts / readings)) ELSE coalesce(short, 1) END) AS stuck_from FROM tallied
), stuck AS (SELECT i.station_ref, i.us FROM islands i JOIN runs r USING (station_ref, run) JOIN limits l USING (station_ref) WHERE r.n >= l.stuck_from
), near AS (
  SELECT s.*, u.step, abs(value - median(value) OVER (PARTITION BY station_ref ORDER BY us ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)) AS off
  FROM sound s JOIN usual u USING (station_ref) WHERE variable <> 'precipitation'
), parts AS (
  SELECT station_ref, i, step, prev, unnest([1, 2, 3]) AS m,
    unnest([lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w]) AS next,
    unnest([value, min(value) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), min(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)]) AS lo,
    unnest([value, max(value) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), max(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)]) AS hi,
    unnest([off, min(off) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), min(off) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)]) AS weight
  FROM near WINDOW w AS (PARTITION BY station_ref ORDER BY us)
), groups AS (
  SELECT station_ref, i AS a, i + m AS b, weight FROM parts
  WHERE prev IS NOT NULL AND next IS NOT NULL AND greatest(lo - greatest(prev, next), least(prev, next) - hi) > 12 * step
), spikes AS (
  SELECT station_ref, unnest(range(a, b)) AS i FROM groups g WHERE NOT EXISTS (
    SELECT 1 FROM groups o WHERE o.station_ref = g.station_ref AND o.weight > g.weight AND NOT (o.a < g.b AND g.a < o.b)
      AND ((g.a - 1 >= o.a AND g.a - 1 < o.b) OR (g.b >= o.a AND g.b < o.b)))
), heights AS (
  SELECT DISTINCT station_ref, altitude, epoch_us(loaded_at) AS at_us FROM stations WHERE altitude IS NOT NULL AND NOT isnan(altitude)
), middles AS (SELECT station_ref, median(altitude) AS middle, count(*) AS n FROM heights GROUP BY 1
), agreed AS (
  SELECT h.*, middle, n, count(*) FILTER (abs(altitude - middle) <= 50) OVER (PARTITION BY h.station_ref) AS agreeing FROM heights h JOIN middles USING (station_ref)
)
SELECT 'value' AS field_name, station_ref, us AS at_us FROM judged WHERE NOT inside
UNION SELECT 'value', station_ref, us FROM stuck
UNION SELECT 'value', s.station_ref, n.us FROM spikes s JOIN near n ON n.station_ref = s.station_ref AND n.i = s.i
UNION SELECT 'altitude', station_ref, at_us FROM agreed WHERE NOT (altitude BETWEEN -500 AND 9000) OR (n >= 3 AND agreeing * 2 > n AND abs(altitude - middle) > 50)"""
_TIMES = r"""WITH cleaned AS (
  SELECT raw_id, station_ref, zone_name AS zone, date_order AS ord, trim(regexp_replace(translate(time_text, '−' || chr(160) || chr(9), '-  '), ' +', ' ', 'g')) AS t
  FROM raw_series LEFT JOIN feeds USING (feed_id)
), dated AS (
  SELECT *, regexp_extract(t, '^(\d{4})-(\d{1,2})-(\d{1,2})[ Tt](.+)$', ['y', 'm', 'd', 'r']) AS iso,
    regexp_extract(t, '^(\d{4})-(\d{3})[ Tt](.+)$', ['y', 'j', 'r']) AS ordinal,
    regexp_extract(t, '^(\d{4})(\d\d)(\d\d)[ Tt]?(\d\d)(\d\d)(\d\d)(.*)$', ['y', 'm', 'd', 'h', 'i', 's', 'r']) AS basic,
    regexp_extract(t, '^(\d{1,4})[/.](\d{1,2})[/.](\d{1,4}),? (.+)$', ['a', 'b', 'c', 'r']) AS num,
    regexp_extract(t, '^(?:([A-Z][a-z]{2}), )?(\d{1,2})[- ]([A-Z][a-z]{2})[- ](\d{4}) (.+)$', ['w', 'd', 'm', 'y', 'r']) AS named FROM cleaned
), placed AS (
  SELECT *, CASE WHEN iso.y <> '' THEN iso.y WHEN ordinal.y <> '' THEN ordinal.y WHEN basic.y <> '' THEN basic.y WHEN named.y <> '' THEN named.y
      WHEN num.a <> '' THEN CASE WHEN length(num.a) = 4 THEN num.a WHEN ord = 'ymd' THEN '20' || num.a WHEN length(num.c) = 4 THEN num.c ELSE '20' || num.c END END AS y,
    CASE WHEN iso.y <> '' THEN iso.m WHEN basic.y <> '' THEN basic.m WHEN named.y <> '' THEN ((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', named.m) + 2) // 3)::VARCHAR
      WHEN num.a <> '' THEN CASE WHEN length(num.a) = 4 OR ord = 'ymd' OR ord = 'dmy' THEN num.b ELSE num.a END END AS m,
    CASE WHEN iso.y <> '' THEN iso.d WHEN basic.y <> '' THEN basic.d WHEN named.y <> '' THEN named.d
      WHEN num.a <> '' THEN CASE WHEN length(num.a) = 4 OR ord = 'ymd' THEN num.c WHEN ord = 'dmy' THEN num.a ELSE num.b END END AS d,
    CASE WHEN iso.y <> '' THEN iso.r WHEN ordinal.y <> '' THEN ordinal.r WHEN basic.y <> '' THEN basic.h || ':' || basic.i || ':' || basic.s || basic.r
      WHEN named.y <> '' THEN named.r WHEN num.a <> '' THEN num.r END AS r FROM dated
), clocked AS (
  SELECT *, regexp_extract(r, '^(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,6}))?)?(?: ?([AP]M))? ?([A-Za-z]*)(?:([+-])(\d\d):?(\d\d))?$', ['h', 'i', 's', 'f', 'ap', 'z', 'sign', 'oh', 'om']) AS k,
    CASE WHEN ordinal.y <> '' THEN TRY(make_date(TRY_CAST(ordinal.y AS BIGINT), 1, 1) + (TRY_CAST(ordinal.j AS INT) - 1)) ELSE TRY(make_date(TRY_CAST(y AS BIGINT), TRY_CAST(m AS BIGINT), TRY_CAST(d AS BIGINT))) END AS day FROM placed
), timed AS (
  SELECT *, regexp_full_match(t, '\d{10}|\d{13}|\d{16}') AS is_count, upper(k.z) AS zn,
    CASE WHEN k.ap = '' THEN TRY_CAST(k.h AS BIGINT) WHEN k.ap = 'AM' THEN TRY_CAST(k.h AS BIGINT) % 12 ELSE TRY_CAST(k.h AS BIGINT) % 12 + 12 END AS h,
    epoch_us(day::TIMESTAMP) + (CASE WHEN k.ap = '' THEN TRY_CAST(k.h AS BIGINT) WHEN k.ap = 'AM' THEN TRY_CAST(k.h AS BIGINT) % 12 ELSE TRY_CAST(k.h AS BIGINT) % 12 + 12 END * 3600 + TRY_CAST(k.i AS BIGINT) * 60
      + coalesce(TRY_CAST(k.s AS BIGINT), 0)) * 1000000 + rpad(CASE WHEN k.f = '' THEN '0' ELSE k.f END, 6, '0')::BIGINT AS local FROM (SELECT * FROM clocked WHERE day IS NOT NULL AND k.h <> '' OR regexp_full_match(t, '\d{10}|\d{13}|\d{16}'))
), sane AS (
  SELECT * FROM timed WHERE is_count OR (h <= 23 OR (h = 24 AND local % 86400000000 = 0)) AND TRY_CAST(k.i AS BIGINT) <= 59 AND coalesce(TRY_CAST(k.s AS BIGINT), 0) <= 59
    AND (named.w = '' OR named.w = ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(day)])
), shifts AS (SELECT unnest(['CET', 'CEST', 'EST', 'EDT', 'NZST', 'NZDT', 'NST', 'NDT']) AS zn, unnest([60, 120, -300, -240, 720, 780, -210, -150]) AS minutes
), fixed AS (
  SELECT raw_id, station_ref, CASE WHEN is_count THEN TRY_CAST(t AS BIGINT) * CASE length(t) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END
    WHEN k.sign <> '' THEN local - (TRY_CAST(k.oh AS BIGINT) * 60 + TRY_CAST(k.om AS BIGINT)) * CASE k.sign WHEN '-' THEN -60000000 ELSE 60000000 END
    WHEN zn IN ('Z', 'UTC', 'GMT') THEN local
    WHEN zn = '' AND regexp_full_match(zone, '[+-]\d\d:\d\d') THEN local - (TRY_CAST(zone[2:3] AS BIGINT) * 60 + TRY_CAST(zone[5:6] AS BIGINT)) * CASE zone[1] WHEN '-' THEN -60000000 ELSE 60000000 END END AS us FROM sane
), offsets AS (SELECT unnest(range(-840, 841, 15))::BIGINT AS minutes
), zoned AS (
  SELECT s.raw_id, s.station_ref, s.local - o.minutes * 60000000 AS us FROM sane s JOIN offsets o ON TRUE LEFT JOIN shifts z ON z.zn = s.zn
  WHERE NOT s.is_count AND s.k.sign = '' AND zone IS NOT NULL AND NOT regexp_full_match(zone, '[+-]\d\d:\d\d') AND (s.zn = '' OR z.minutes = o.minutes)
    AND timezone(zone, make_timestamptz(s.local - o.minutes * 60000000)) = make_timestamp(s.local)
), instants AS (
  SELECT raw_id, station_ref, us FROM fixed WHERE us IS NOT NULL
  UNION ALL SELECT raw_id, station_ref, min(us) FROM zoned GROUP BY ALL HAVING count(*) = 1
)"""
SQL["p4_found"] = f"""{_TIMES} SELECT a.raw_id AS raw_id_a, b.raw_id AS raw_id_b FROM instants a JOIN instants b ON a.station_ref = b.station_ref AND a.us = b.us AND a.raw_id < b.raw_id"""
_STATES = f"""{_TIMES}, fitting AS (SELECT raw_id, count(*) AS n FROM zoned GROUP BY 1)
SELECT c.raw_id, i.us AS instant_us, CASE WHEN c.t IS NULL OR c.t = '' THEN 'no text' WHEN i.us IS NOT NULL THEN 'ok' WHEN s.raw_id IS NULL THEN 'unreadable' WHEN s.zone IS NULL THEN 'no zone'
  WHEN f.n IS NULL THEN 'no such time' ELSE 'ambiguous' END AS time_state
FROM cleaned c LEFT JOIN instants i USING (raw_id) LEFT JOIN sane s USING (raw_id) LEFT JOIN fitting f USING (raw_id)"""
SQL["p4_normalised_times"] = _STATES
SQL["p4_classes"] = f"""{_TIMES} SELECT raw_id, min(raw_id) OVER w AS class_id, count(*) OVER w - 1 AS n_links FROM instants WINDOW w AS (PARTITION BY station_ref, us) QUALIFY count(*) OVER w > 1"""
