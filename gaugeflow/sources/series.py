"""Series that come as arrays, one row a series, or as arrays of Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions.columns import need


def series_from_arrays(rows: DataFrame, key: str = "station_ref", times: str = "times", values: str = "values", extras: tuple[str, ...] = ()) -> DataFrame:
    """(station_ref, pos, ts, value, extras): one row per element of the arrays, pos its place from 0.

    A null times array skips the series, an empty one gives nothing. values and every extra must be as long as times, also
    in an empty series, else the query fails (arrays_zip would fill up with nulls); a null extra is null throughout.
    """
    r = need(rows, key, times, values, *extras).filter(F.col(times).isNotNull())
    bad = F.lit(False)
    for c in (values, *extras):
        unequal = F.size(c) != F.size(times)
        bad = bad | (F.coalesce(unequal, F.lit(True)) if c == values else F.coalesce(F.col(c).isNotNull() & unequal, F.lit(False)))
    guard = F.when(bad, F.raise_error(F.concat(F.lit("arrays of unlike length in series "), F.col(key).cast("string")))).otherwise(F.col(times))
    r = r.withColumn("_times", guard)
    out = r.select(F.col(key).alias("station_ref"), *[F.col(c).alias(f"_{c}") for c in (values, *extras)], F.posexplode("_times").alias("pos", "ts"))
    at = lambda c: F.get(F.col(f"_{c}"), F.col("pos"))
    return out.select("station_ref", "pos", "ts", at(values).alias("value"), *[at(c).alias(c) for c in extras])


def micros_of(times) -> list[int | None]:
    """Microseconds since 1970 of times in Python: numpy datetime64 of any unit, datetimes (with a zone: its instant; without:
    UTC), ISO texts, pandas series and indexes. None and NaT are missing; a number, also NaN, raises TypeError."""
    from datetime import UTC, datetime, timedelta

    import numpy as np
    import pandas as pd

    if isinstance(times, (pd.Series, pd.Index)) and isinstance(times.dtype, pd.DatetimeTZDtype):
        times = (times.dt if isinstance(times, pd.Series) else times).tz_convert(None)
    a = np.asarray(times)
    if a.dtype.kind == "M":
        us = a.astype("datetime64[us]").astype("int64")
        return [None if gone else int(x) for x, gone in zip(us, np.isnat(a))]
    epoch, one = datetime(1970, 1, 1, tzinfo=UTC), timedelta(microseconds=1)

    def us(t) -> int | None:
        if t is None or t is pd.NaT:
            return None
        if isinstance(t, np.datetime64):
            return None if np.isnat(t) else int(t.astype("datetime64[us]").astype("int64"))
        if isinstance(t, str):
            t = datetime.fromisoformat(t)
        if not isinstance(t, datetime):
            raise TypeError(f"not a time: {t!r}")
        return ((t if t.tzinfo else t.replace(tzinfo=UTC)) - epoch) // one

    return [us(t) for t in a.tolist()]


def readings_of(spark: SparkSession, times, values, key: str = "series") -> DataFrame:
    """(series_key, ts, value) of two parallel arrays of Python, see micros_of; values are numbers, numeric texts or missing
    (None, NaN). Arrays of unlike length raise ValueError."""
    us = micros_of(times)
    numbers = [None if v is None else float(v) for v in values]
    if len(us) != len(numbers):
        raise ValueError("times and values of unlike length")
    return spark.createDataFrame([(key, t, v) for t, v in zip(us, numbers)], "series_key string, us bigint, value double").select("series_key", F.timestamp_micros("us").alias("ts"), "value")
