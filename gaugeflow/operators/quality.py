"""Plausibility bounds, and guards that stop a write before it begins."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import known
from gaugeflow.operators.implausible import ALTITUDE_RANGE

log = logging.getLogger(__name__)

Bounds = tuple[float | None, float | None]
#: Keys that a message names at most.
NAMED = 10


def _within(c: str, bounds: Bounds):
    lo, hi = bounds
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col(c) >= float(lo))
    if hi is not None:
        ok = ok & (F.col(c) <= float(hi))
    return ok


def qc_filter(series: DataFrame, bounds: Bounds, ancillary: dict[str, Bounds] | None = None, value: str = "value") -> DataFrame:
    """series with values outside the bounds (which are allowed; infinities are outside) made null, and qc_rejected,
    anc_rejected.

    NaN and null are missing, not rejected. A rejected value takes its ancillaries with it; a rejected ancillary leaves
    the value. anc_rejected counts ancillaries beyond their own bounds. Rows stay.
    """
    ancillary = ancillary or {}
    rows = series.withColumns({c: known(c) for c in (value, *ancillary)})
    bad = F.col(value).isNotNull() & ~_within(value, bounds)
    own = {a: F.col(a).isNotNull() & ~_within(a, b) for a, b in ancillary.items()}
    marks = rows.withColumns({"qc_rejected": bad, "anc_rejected": sum((F.when(x, 1).otherwise(0) for x in own.values()), F.lit(0)).cast("int")} | {f"_bad_{a}": x for a, x in own.items()})
    clean = {value: F.when(~F.col("qc_rejected"), F.col(value))} | {a: F.when(~F.col("qc_rejected") & ~F.col(f"_bad_{a}"), F.col(a)) for a in ancillary}
    return marks.withColumns(clean).drop(*[f"_bad_{a}" for a in own])


def altitude_qc(stations: DataFrame, altitude: str = "altitude") -> DataFrame:
    """stations with altitude FLOAT, null where missing or outside ALTITUDE_RANGE, and altitude_rejected.

    A text that is no number raises, naming the station (station_ref, if there is one). The band is tested before the cast
    to FLOAT, which overflows.
    """
    wide = F.col(altitude).cast("double")
    if dict(stations.dtypes)[altitude] == "string":
        who = F.col("station_ref").cast("string") if "station_ref" in stations.columns else F.lit("?")
        told = F.concat(F.lit("altitude of station "), F.coalesce(who, F.lit("?")), F.lit(" is no number: "), F.substring(altitude, 1, 100))
        wide = F.when(F.col(altitude).isNotNull() & F.col(altitude).try_cast("double").isNull(), F.raise_error(told).cast("double")).otherwise(F.col(altitude).try_cast("double"))
    wide = known(wide)
    ok = wide.between(*ALTITUDE_RANGE)
    return stations.withColumns({altitude: F.when(ok, wide).cast("float"), "altitude_rejected": F.coalesce(~ok, F.lit(False))})


def warn_rejected_altitudes(checked: DataFrame) -> list[str]:
    """Up to NAMED references of rejected altitudes, logged once."""
    refs = [r[0] for r in checked.filter("altitude_rejected").select("station_ref").distinct().orderBy("station_ref").limit(NAMED + 1).collect()]
    if refs:
        log.warning("altitudes outside %s are left out: %s%s", ALTITUDE_RANGE, ", ".join(map(str, refs[:NAMED])), " and more" if len(refs) > NAMED else "")
    return refs[:NAMED]


def alignment_violations(series: DataFrame, step_us: int, us: str = "us") -> DataFrame:
    """Rows whose time isn't a multiple of the step since 1970, with residue_us."""
    return series.withColumn("residue_us", F.pmod(F.col(us), F.lit(step_us))).filter("residue_us <> 0")


def misaligned(step_us: int, us: str = "us"):
    """Aggregates: how many times aren't multiples of the step, and the first of them as (us, residue_us)."""
    residue = F.pmod(F.col(us), F.lit(step_us))
    return F.count_if(residue != 0), F.min(F.when(residue != 0, F.struct(F.col(us).alias("us"), residue.alias("residue_us"))))


def check_aligned(series: DataFrame, step_us: int, us: str = "us") -> None:
    """Raise ValueError with the number, the first offender and its residue if any time is off the step."""
    n, first = misaligned(step_us, us)
    bad = series.agg(n.alias("n"), first.alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} times aren't multiples of the step of {step_us} us; first: {bad['first']['us']} us, off by {bad['first']['residue_us']} us")


def unknown_refs(series: DataFrame, stations: DataFrame) -> DataFrame:
    """(station_ref) of series that stations lack."""
    return series.select("station_ref").distinct().join(stations.select("station_ref").distinct(), "station_ref", "left_anti")


def check_refs(series: DataFrame, stations: DataFrame) -> None:
    """Raise ValueError naming references with data that stations lack: the first NAMED in order, and how many there are."""
    unknown = unknown_refs(series, stations)
    refs = [str(r[0]) for r in unknown.orderBy("station_ref").limit(NAMED + 1).collect()]
    if refs:
        raise ValueError(f"series of unknown stations: {', '.join(refs[:NAMED])}{f' and more, {unknown.count()} in all' if len(refs) > NAMED else ''}")


def check_roster(series: DataFrame, declared: list[str], fixed: tuple[str, ...] = ("station_ref", "pos", "ts", "value")) -> None:
    """Raise ValueError if series has columns that are neither fixed nor declared ancillaries: nothing is dropped unseen."""
    extra = sorted(set(series.columns) - set(declared) - set(fixed))
    if extra:
        raise ValueError(f"undeclared ancillaries: {', '.join(extra)}")
