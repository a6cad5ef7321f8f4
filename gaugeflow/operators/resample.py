"""Irregular, gappy readings of many series to a fixed cadence.

'mean' is the exact time-weighted mean of the piecewise linear signal over the covered part of each interval; 'sum' is
a right-closed sum of per-slot totals. Two rules judge missing data: no interpolation across a hole in the source's own
rhythm, and no interval that is covered too thinly. Everything is built-in expressions; series are cut into tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import finite, floor_us, need, round_us, us_of
from gaugeflow.functions.durations import parse_duration_us
from gaugeflow.operators.neighbours import with_neighbours
from gaugeflow.session import check_strict

#: The local median looks at this many segments, centred; shorter series use the median of all.
MEDIAN_SEGMENTS = 15


def prepare(readings: DataFrame, key: str = "series_key", ts: str = "ts", value: str = "value", round_to=None) -> DataFrame:
    """(series_key, us, value): readings without missing times and values, one a time, a repeated time's values averaged.

    NaN, null and infinite values, null times and null keys are left out. A text value must be numeric (a bad one
    raises; needs ANSI mode, which is checked). round_to rounds times to its nearest multiple, halves up, before repeats are joined.
    """
    check_strict(readings.sparkSession)
    rows = need(readings, key, ts, value).select(F.col(key).alias("series_key"), us_of(ts).alias("us"), finite(F.col(value).cast("double")).alias("value"))
    rows = rows.filter("series_key IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL")
    if round_to is not None:
        rows = rows.withColumn("us", round_us(F.col("us"), parse_duration_us(round_to)))
    return rows.groupBy("series_key", "us").agg(F.avg("value").alias("value"))


def segments(prepared: DataFrame) -> DataFrame:
    """prepared with tile, is_core, and of the segment to the next reading: next_us, next_value, d (its length) and med
    (the local median length); of the segment before: prev_us, prev_med. Null where there is no such reading.

    med is the median of the MEDIAN_SEGMENTS lengths centred on the segment, fewer at the series' ends; of all lengths in
    a series with fewer segments.
    """
    near = with_neighbours(prepared, "series_key", "us", ["value"], MEDIAN_SEGMENTS)
    part = Window.partitionBy("tile", "series_key")
    w = part.orderBy("us")
    half = MEDIAN_SEGMENTS // 2
    s = near.withColumns({"next_us": F.lead("us").over(w), "next_value": F.lead("value").over(w), "prev_us": F.lag("us").over(w)})
    s = s.withColumn("d", F.col("next_us") - F.col("us"))
    # the lengths around, sorted, nulls first; built-in array functions on them are compiled, a percentile of each frame isn't
    around = [F.col("d") if k == 0 else F.lead("d", k).over(w) if k > 0 else F.lag("d", -k).over(w) for k in range(-half, half + 1)]
    s = s.withColumns({"_around": F.sort_array(F.array(*around)), "_known": sum((x.isNotNull().cast("int") for x in around), F.lit(0)), "_all": F.count("d").over(part)})
    nulls = MEDIAN_SEGMENTS - F.col("_known")
    at = lambda k: F.get("_around", nulls + F.floor(k / 2).cast("int"))
    local = (at(F.col("_known") - 1) + at(F.col("_known"))) / 2
    short = F.col("_all") < MEDIAN_SEGMENTS
    whole = F.percentile(F.when(short, F.col("d")), F.lit(0.5)).over(part)  # of nulls only, unless the series is short
    s = s.withColumn("med", F.when(F.col("d").isNotNull(), F.when(short, whole).otherwise(local)))
    return s.withColumn("prev_med", F.lag("med").over(w)).filter("is_core").drop("is_core", "_around", "_known", "_all")


def gap_threshold(max_gap=None, gap_multiplier: float = 3.0) -> Column:
    """Length above which a segment is a hole: max_gap, or a multiple of the local median."""
    return F.lit(parse_duration_us(max_gap)) if max_gap is not None else F.col("med") * F.lit(float(gap_multiplier))


def _mean(seg: DataFrame, f: int, hole: Column, min_coverage: float) -> DataFrame:
    kept = seg.filter(F.col("d").isNotNull() & (F.col("d") <= hole))
    bins = kept.withColumn("bin", F.explode(F.sequence(floor_us(F.col("us"), f), floor_us(F.col("next_us") - 1, f), F.lit(f).cast("bigint"))))
    a, e = F.greatest("us", "bin"), F.least("next_us", F.col("bin") + f)
    at = lambda x: F.col("value") + (F.col("next_value") - F.col("value")) * ((x - F.col("us")) / F.col("d"))
    piece = bins.select("series_key", "bin", (e - a).alias("dur"), ((at(a) + at(e)) / 2 * (e - a)).alias("area"))
    out = piece.groupBy("series_key", "bin").agg(F.sum("area").alias("area"), F.sum("dur").alias("dur"))
    return out.filter(F.col("dur") >= F.lit(float(min_coverage)) * f).select("series_key", "bin", (F.col("area") / F.col("dur")).alias("value"))


def _sum(seg: DataFrame, f: int, min_coverage: float) -> DataFrame:
    back = F.when(F.col("prev_us").isNotNull(), F.least(F.col("us") - F.col("prev_us"), F.col("prev_med"))).otherwise(F.coalesce("med", F.lit(0.0)))
    rows = seg.select("series_key", floor_us(F.col("us") - 1, f).alias("bin"), "value", back.alias("span"))
    out = rows.groupBy("series_key", "bin").agg(F.sum("value").alias("value"), F.sum("span").alias("span"))
    return out.filter(F.least("span", F.lit(float(f))) >= F.lit(float(min_coverage)) * f).select("series_key", "bin", "value")


def _arrays(times, values, **args):
    import numpy as np

    from gaugeflow.sources.series import readings_of

    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("there is no Spark session")
    rows = resample(readings_of(spark, times, values), **args).select(F.unix_micros("ts").alias("us"), "value").orderBy("us").collect()
    return np.array([r["us"] for r in rows], "int64").astype("datetime64[us]"), np.array([r["value"] for r in rows], float)


def resample(readings, values=None, statistic: str = "mean", freq="1h", max_gap=None, gap_multiplier: float = 3.0, min_coverage: float = 0.75, round_to=None, key: str = "series_key", ts: str = "ts", value: str = "value"):
    """(series_key, ts, value): one row per series and interval that is covered well enough, labelled by its start.

    Intervals are multiples of freq since 1970 (UTC). 'mean' interpolates between consecutive readings unless they are
    further apart than max_gap (by default gap_multiplier times the local median), and needs min_coverage of the interval
    covered; a series with one reading gives nothing. 'sum' counts a reading in the interval that ends at or holds it;
    each covers the time back to the one before, at most the local median, and max_gap has no effect. No zero is
    made up for an interval without reading. Missing readings: see prepare(). Rows come in no order.

    Given times and values of one series in Python (see series.readings_of) instead of a DataFrame, it returns two numpy
    arrays, labels as datetime64[us] in order and values.
    """
    f = parse_duration_us(freq)
    if statistic not in ("mean", "sum"):
        raise ValueError(f"unsupported statistic {statistic!r}: 'mean' or 'sum'")
    if values is not None:
        return _arrays(readings, values, statistic=statistic, freq=freq, max_gap=max_gap, gap_multiplier=gap_multiplier, min_coverage=min_coverage, round_to=round_to)
    seg = segments(prepare(readings, key, ts, value, round_to))
    hole = gap_threshold(max_gap, gap_multiplier)
    out = _mean(seg, f, hole, min_coverage) if statistic == "mean" else _sum(seg, f, min_coverage)
    return out.select("series_key", F.timestamp_micros("bin").alias("ts"), "value")
