"""Versioned station datasets: facts by month, stations, and a manifest, in a directory of any Hadoop file system.

    <path>/manifests/<version>.json    axis, cadence, encoding, attributes, and where each month of facts is
    <path>/facts/<version>/month=YYYY-MM/...
    <path>/stations/<version>/...

Facts are sparse: an absent row is a slot with nothing in it. A merge writes the months it touches and a new manifest;
the manifest is made last and once only, so a reader sees all planes of one version or none of them. Within a month facts
are sorted by station and time and cut into files of like size, so that one station's are in one or two of them.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.columns import known, month_of, us_of
from gaugeflow.functions.durations import cadence_us, check_phase, natural_unit
from gaugeflow.operators.axis import dense_grid, last_of_slot, overlay, supplied
from gaugeflow.operators.joins import lookup_join
from gaugeflow.operators.quality import NAMED, altitude_qc, check_refs, check_roster, misaligned, qc_filter, warn_rejected_altitudes
from gaugeflow.session import check_strict, hadoop_path, materialize, scratch
from gaugeflow.sources.files import create_once, names_in, read_text

log = logging.getLogger(__name__)

REPORT = ("new_stations", "new_steps", "written_block", "gap_steps", "qc_rejected", "anc_qc_rejected", "dropped_before_axis")
#: Attributes of the station columns.
STATION_ATTRS = {
    "station_id": {"cf_role": "timeseries_id", "long_name": "identity of the station, by its place"},
    "station_name": {"long_name": "name of the station"},
    "station_ref": {"long_name": "reference of the station at its source"},
    "station_altitude": {"standard_name": "altitude", "units": "m", "axis": "Z", "positive": "up"},
}


def station_id(lon: str = "lon", lat: str = "lat"):
    """Identity of a station: a hash of its place; changes with the coordinates. -0.0 is 0.0."""
    text = [F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).cast("double").cast("string") for c in (lon, lat)]
    return F.sha2(F.concat_ws("|", *text), 256)


class BeforeAxis(ValueError):
    """All of a window lies before the stored axis."""


class Dataset:
    """A dataset at its last version (or a given one)."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = self.last_version() if version is None else version
        if not self.version:
            raise FileNotFoundError(f"no dataset at {path}")
        self.manifest = json.loads(read_text(spark, f"{self.path}/manifests/{self.version:012d}.json"))

    def last_version(self) -> int:
        return max([int(n[:12]) for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json")], default=0)

    @property
    def step_us(self) -> int:
        return cadence_us(self.manifest["attributes"]["meta_frequency_interval"])

    @property
    def planes(self) -> list[str]:
        return ["value", *self.manifest["ancillary"]]

    @property
    def schema(self) -> str:
        return "station_id string, us bigint" + "".join(f", {p} double" for p in self.planes)

    def facts(self, lo_us: int | None = None, hi_us: int | None = None, station_ids: list[str] | None = None) -> DataFrame:
        """(station_id, us, planes), of the months and times from lo_us to hi_us only, and of some stations only: files are
        sorted by station, so their statistics spare reading the others."""
        months = [m for m in sorted(self.manifest["months"]) if (lo_us is None or m >= _month(lo_us)) and (hi_us is None or m <= _month(hi_us))]
        paths = [f"{self.path}/{self.manifest['months'][m]}/month={m}" for m in months]
        df = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if station_ids is not None:
            df = df.filter(F.col("station_id").isin(station_ids))
        if lo_us is not None:
            df = df.filter(F.col("us") >= lo_us)
        return df if hi_us is None else df.filter(F.col("us") <= hi_us)

    def stations(self) -> DataFrame:
        """(station_id, station_ref, station_name, lon, lat, station_altitude FLOAT)."""
        return self.spark.read.parquet(f"{self.path}/{self.manifest['stations']}")

    def axis(self) -> tuple[int, int, int]:
        """(first µs, step µs, number of steps)."""
        a = self.manifest["axis"]
        return a["t0_us"], a["step_us"], a["n_steps"]

    def dense(self) -> DataFrame:
        """(station_id, us, planes) with a row for every station and step."""
        t0, step, n = self.axis()
        bounds = self.spark.createDataFrame([(t0, t0 + (n - 1) * step, n)], "t0_us bigint, tn_us bigint, n_steps bigint")
        return dense_grid(self.stations(), self.facts(), bounds, step, self.planes, key="station_id")

    def expire(self, keep: int = 1) -> int:
        """Delete all but the last `keep` versions: their manifests first, then folders no manifest left names. How many
        folders went. A reader of a deleted version fails; run it where no merge is under way."""
        names = sorted(n for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json"))
        for n in names[:-keep]:
            fs, p = hadoop_path(self.spark, f"{self.path}/manifests/{n}")
            fs.delete(p, False)
        held = set()
        for n in names[-keep:]:
            m = json.loads(read_text(self.spark, f"{self.path}/manifests/{n}"))
            held |= {f"{w}/month={k}" for k, w in m["months"].items()} | {m["stations"]}
        there = [f"stations/{v}" for v in names_in(self.spark, f"{self.path}/stations")]
        there += [f"facts/{v}/{m}" for v in names_in(self.spark, f"{self.path}/facts") for m in names_in(self.spark, f"{self.path}/facts/{v}") if m.startswith("month=")]
        for what in set(there) - held:
            fs, p = hadoop_path(self.spark, f"{self.path}/{what}")
            fs.delete(p, True)
        return len(set(there) - held)


def _month(us: int) -> str:
    import numpy as np

    return str(np.datetime64(us, "us").astype("datetime64[M]"))


def _incoming(series: DataFrame, ancillary: list[str]) -> DataFrame:
    """(station_ref, us, planes, pos): series as given, missing numbers null, rows without time or station left out."""
    check_roster(series, ancillary)
    pos = F.col("pos") if "pos" in series.columns else F.lit(0)
    planes = [known(F.col("value").cast("double")).alias("value")] + [(known(F.col(a).cast("double")) if a in series.columns else F.lit(None).cast("double")).alias(a) for a in ancillary]
    rows = series.select("station_ref", us_of("ts").alias("us"), *planes, pos.cast("bigint").alias("pos"))
    return rows.filter("station_ref IS NOT NULL AND us IS NOT NULL")


def encodable_range(precision: int, min_value: float, max_value: float) -> tuple[float, float]:
    """Least and greatest value that fit the smallest unsigned integer which holds min_value to max_value in steps of the
    precision; code 0 is the missing one, code 1 is min_value."""
    codes = round((max_value - min_value) * 10**precision) + 1
    bits = next(b for b in (8, 16, 32, 64) if codes < 1 << b)
    return min_value, min_value + ((1 << bits) - 2) / 10**precision


def _bounds(manifest: dict) -> tuple[tuple, dict]:
    """Of the value and of each ancillary: declared limits, else the encodable range, else none."""
    out = {}
    for plane, name in ({"value": manifest["variable"]} | {a: a for a in manifest["ancillary"]}).items():
        attrs, range_ = manifest["variables"].get(name, {}), manifest["encodable"].get(plane)
        lo, hi = attrs.get("valid_min"), attrs.get("valid_max")
        out[plane] = (lo, hi) if lo is not None or hi is not None or range_ is None else tuple(range_)
    return out.pop("value"), out


def _rounded(df: DataFrame, manifest: dict) -> DataFrame:
    return df.withColumns({p: F.round(p, manifest["precision"][p]) for p in ["value", *manifest["ancillary"]] if manifest["precision"][p] is not None})


def write_facts(facts: DataFrame, path: str, version: str, chunk_shape: list[int] | None = None, groups: int | None = None) -> dict[str, str]:
    """Write facts by month, station and time; month to folder.

    Sorted by range partitions that adaptive execution makes of like size (or `groups` of them), whatever a station's or a
    month's share is. chunk_shape (stations, steps): most rows of a file, by their product.
    """
    spark = facts.sparkSession
    where = f"facts/{version}"
    order = ["month", "station_id", "us"]
    rows = facts.withColumn("month", month_of(F.col("us")))
    rows = rows.repartitionByRange(groups, *order) if groups else rows.repartitionByRange(*order)
    out = rows.sortWithinPartitions(*order).write.partitionBy("month")
    if chunk_shape:
        out = out.option("maxRecordsPerFile", chunk_shape[0] * chunk_shape[1])
    out.parquet(f"{path}/{where}")
    return {n.removeprefix("month="): where for n in names_in(spark, f"{path}/{where}") if n.startswith("month=")}


def _station_table(stations: DataFrame) -> DataFrame:
    checked = altitude_qc(stations if "altitude" in stations.columns else stations.withColumn("altitude", F.lit(None).cast("double")))
    return checked.select(station_id().alias("station_id"), F.col("station_ref").cast("string").alias("station_ref"), F.col("name").cast("string").alias("station_name"), "lon", "lat", F.col("altitude").alias("station_altitude"), "altitude_rejected")


def _check_places(table: DataFrame) -> None:
    twice = [r[0] for r in table.groupBy("station_id").agg(F.count("*").alias("n"), F.min("station_ref").alias("ref")).filter("n > 1").select("ref").limit(NAMED).collect()]
    if twice:
        raise ValueError(f"stations at one place: {', '.join(map(str, twice))}")


def _checked(qc: DataFrame, step: int, t0: int) -> dict:
    """Bounds of the times, how many are before t0, and what QC made missing, in one pass; times off the step raise."""
    off, first = misaligned(step)
    us = F.col("us")
    r = qc.agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.sum((us < t0).cast("bigint")).alias("early"), F.sum(F.col("qc_rejected").cast("bigint")).alias("rejected"), F.sum("anc_rejected").alias("anc_rejected"), off.alias("n"), first.alias("first")).first()
    if r["n"]:
        raise ValueError(f"{r['n']} times aren't multiples of the step of {step} us; first: {r['first']['us']} us, off by {r['first']['residue_us']} us")
    out = {k: r[k] or 0 for k in ("early", "rejected", "anc_rejected")} | {"lo": r["lo"], "hi": r["hi"]}
    if out["rejected"] or out["anc_rejected"]:
        log.warning("out of bounds and made missing: %s values, %s ancillaries", out["rejected"], out["anc_rejected"])
    return out


def build_local(path: str, meta: dict, stations: DataFrame, series: DataFrame, *, variable: str, units: str, precision: int, min_value: float, max_value: float, chunk_shape: tuple[int, int] | None = None, standard_name: str | None = None, extra_var_attrs: dict | None = None, ancillary: dict[str, dict] | None = None) -> Dataset:
    """Make a dataset from stations (station_ref, lon, lat, name[, altitude]) and series (station_ref, ts, value[, pos,
    ancillaries]); a path that has one raises.

    meta holds frequency_interval (a fixed cadence), utc_offset (which must not shift its intervals) and what else is to
    be kept. ancillary: name to {units, precision, min, max, attrs}. Times must be multiples of the cadence, stations known,
    columns declared, and there must be data; all this is checked before anything is written. Of rows of one station and
    time the last (highest pos) counts. Values out of bounds become missing, their times still extend the axis. All
    stations are kept, also without data. Two stations at one place raise. chunk_shape: see write_facts.
    """
    spark = series.sparkSession
    check_strict(spark)
    ancillary = ancillary or {}
    step = cadence_us(meta.get("frequency_interval"))
    check_phase(meta.get("utc_offset"), step)
    manifest = {
        "variable": variable,
        "ancillary": list(ancillary),
        "precision": {"value": precision} | {a: x.get("precision") for a, x in ancillary.items()},
        "encodable": {a: encodable_range(p, lo, hi) if None not in (p, lo, hi) else None for a, p, lo, hi in [("value", precision, min_value, max_value), *((a, x.get("precision"), x.get("min"), x.get("max")) for a, x in ancillary.items())]},
        "variables": {variable: {"units": units, "standard_name": standard_name, "ancillary_variables": " ".join(ancillary)} | (extra_var_attrs or {}) | {"valid_min": min_value, "valid_max": max_value}}
        | {a: {"units": x.get("units")} | x.get("attrs", {}) | {"valid_min": x.get("min"), "valid_max": x.get("max")} for a, x in ancillary.items()},
        "attributes": {f"meta_{k}": v for k, v in meta.items()},
        "chunk_shape": list(chunk_shape) if chunk_shape else None,
    }
    with scratch():
        rows = materialize(_incoming(series, list(ancillary)), "incoming")
        table = materialize(_station_table(stations), "places")
        bounds, anc = _bounds(manifest)
        qc = qc_filter(rows, bounds, anc)
        r = _checked(qc, step, 0)
        if r["lo"] is None:
            raise ValueError("no series has data")
        check_refs(rows, table)
        _check_places(table)
        warn_rejected_altitudes(table)
        unit, in_unit = natural_unit(step)
        manifest["axis"] = {"t0_us": r["lo"], "step_us": step, "n_steps": (r["hi"] - r["lo"]) // step + 1, "time_unit": unit, "time_step": in_unit}
        planes = ["value", *ancillary]
        slots = lookup_join(supplied(last_of_slot(qc, planes), planes), table.select("station_ref", "station_id"), ["station_ref"]).drop("station_ref")
        version = uuid.uuid4().hex
        has_altitude = not table.filter("station_altitude IS NOT NULL").isEmpty()
        table.drop("altitude_rejected").write.parquet(f"{path}/stations/{version}")
        manifest |= {"stations": f"stations/{version}", "has_altitude": has_altitude, "months": write_facts(_rounded(slots, manifest), path, version, manifest["chunk_shape"])}
    manifest["variables"] |= {k: v for k, v in STATION_ATTRS.items() if has_altitude or k != "station_altitude"}
    create_once(spark, f"{path}/manifests/{1:012d}.json", json.dumps(manifest, sort_keys=True))
    return Dataset(spark, path)


def _check_axis(ds: Dataset, step: int, stored: DataFrame) -> None:
    """Raise ValueError if the axis of the manifest isn't that of the cadence, or stored facts aren't on it."""
    t0, stored_step, n = ds.axis()
    if n < 1 or t0 % step or stored_step != step:
        raise ValueError("the stored axis is empty, off the step, or of another step than the cadence")
    off, first = misaligned(step)
    r = stored.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), off.alias("n"), first.alias("first")).first()
    if r["n"]:
        raise ValueError(f"{r['n']} stored times aren't on the axis; first: {r['first']['us']} us")
    if r["lo"] is not None and (r["lo"] < t0 or r["hi"] > t0 + (n - 1) * step):
        raise ValueError("stored times are outside the stored axis")


def merge_dataset(ds: Dataset, stations: DataFrame, series: DataFrame, *, variable: str | None = None) -> tuple[Dataset, dict[str, int]]:
    """Overlay incoming series on the dataset; the new version and a report with the keys REPORT.

    An incoming slot that has a value or an ancillary replaces the stored slot as a whole; one with neither changes
    nothing, so an offline station keeps its history. The last row (highest pos) of a station and time counts, also if it
    is missing. Stations with data that aren't stored are added; stored ones keep their attributes. The axis grows to
    the last incoming time; rows before its start are dropped and counted, and a window wholly before it raises BeforeAxis,
    before anything is written. Merging the same window again changes no value. Without data nothing is written, unless
    attributes of the station columns have to be healed. Reads and writes only the months that the window touches, and
    checks that what is stored there lies on the axis. variable, if given, must be the dataset's.
    """
    spark, m = ds.spark, ds.manifest
    check_strict(spark)
    if variable is not None and variable != m["variable"]:
        raise ValueError(f"the dataset holds {m['variable']!r}, not {variable!r}")
    step = ds.step_us
    check_phase(m["attributes"].get("meta_utc_offset"), step)
    zero = dict.fromkeys(REPORT, 0)
    wanted = {k: v for k, v in STATION_ATTRS.items() if m["has_altitude"] or k != "station_altitude"}
    new = m | {"variables": m["variables"] | wanted}
    with scratch():
        rows = materialize(_incoming(series, m["ancillary"]), "incoming")
        bounds, anc = _bounds(m)
        qc = qc_filter(rows, bounds, anc)
        t0, _, n = ds.axis()
        r = _checked(qc, step, t0)
        if r["lo"] is None:
            return (_commit(ds, new) if new != m else ds), zero
        refs = rows.select("station_ref").distinct()
        active = materialize(_station_table(stations).join(refs, "station_ref", "left_semi"), "active")
        check_refs(refs, active)
        _check_axis(ds, step, ds.facts(r["lo"], r["hi"]))
        if r["hi"] < t0:
            raise BeforeAxis("the window ends before the stored axis begins")
        _check_places(active)
        warn_rejected_altitudes(active)
        stored = ds.stations()
        added = active.join(stored.select("station_id"), "station_id", "left_anti").drop("altitude_rejected")
        if not m["has_altitude"]:
            if not added.filter("station_altitude IS NOT NULL").isEmpty():
                log.warning("the dataset has no altitudes: those of new stations are left out")
            added = added.withColumn("station_altitude", F.lit(None).cast("float"))
        added = materialize(added, "stations")
        new_stations = added.count()
        end = t0 + (n - 1) * step
        new_steps = max((r["hi"] - end) // step, 0)
        lo = max(r["lo"], t0)
        slots = last_of_slot(qc.filter(F.col("us") >= t0), ds.planes)
        slots = lookup_join(slots, active.select("station_ref", "station_id"), ["station_ref"]).drop("station_ref")
        incoming = materialize(_rounded(supplied(slots, ds.planes), m), "slots")
        version = uuid.uuid4().hex
        touched = {x[0] for x in incoming.select(month_of(F.col("us")).alias("m")).distinct().collect()}  # as many as the window has months
        if touched:
            before = Dataset(spark, ds.path, ds.version)
            before.manifest = m | {"months": {k: v for k, v in m["months"].items() if k in touched}}
            new["months"] = m["months"] | write_facts(overlay(before.facts(), incoming, ["station_id", "us"], ds.planes), ds.path, version, m.get("chunk_shape"))
        if new_stations:
            stored.unionByName(added).write.parquet(f"{ds.path}/stations/{version}")
            new["stations"] = f"stations/{version}"
    new["axis"] = m["axis"] | {"n_steps": n + new_steps}
    report = {
        "new_stations": new_stations,
        "new_steps": new_steps,
        "written_block": (r["hi"] - lo) // step + 1,
        "gap_steps": max((r["lo"] - end) // step - 1, 0),
        "qc_rejected": r["rejected"],
        "anc_qc_rejected": r["anc_rejected"],
        "dropped_before_axis": r["early"],
    }
    return (_commit(ds, new) if new != m else ds), report


def _commit(ds: Dataset, manifest: dict) -> Dataset:
    create_once(ds.spark, f"{ds.path}/manifests/{ds.version + 1:012d}.json", json.dumps(manifest, sort_keys=True))
    return Dataset(ds.spark, ds.path)
