"""The current state of tables that are delivered again and again: one standing row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import finite, known, need, us_of
from gaugeflow.operators.joins import lookup_join


def latest(df: DataFrame, keys: list[str], order: list[str], payload: list[str], where: Column | None = None) -> DataFrame:
    """Of each key, the payload of the row that is highest in order (nulls lowest; ties: highest payload).

    An aggregate, so that rows of one key are reduced before the shuffle; a key may hold any share of the rows.
    """
    row = F.struct(*order, *payload)
    best = F.max(row if where is None else F.when(where, row)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def arrivals(deliveries: DataFrame) -> DataFrame:
    """(delivery_id, arrived_us), one row a delivery: the latest arrival if a row is repeated."""
    d = need(deliveries, "delivery_id", "arrived_at").filter("delivery_id IS NOT NULL")
    return d.groupBy("delivery_id").agg(F.max(us_of("arrived_at")).alias("arrived_us"))


def supplied_readings(series: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(station_ref, us, value, code, delivery_id, arrived_us, pos): rows that supply a value or a code.

    NaN is missing. Rows without station or time supply nothing. A delivery that isn't listed ranks below all others.
    """
    rows = need(series, "station_ref", "pos", "ts", "value", "quality_code", "delivery_id").select(
        "station_ref", us_of("ts").alias("us"), known("value").alias("value"), known("quality_code").alias("code"), "delivery_id", "pos"
    )
    rows = rows.filter("station_ref IS NOT NULL AND us IS NOT NULL AND (value IS NOT NULL OR code IS NOT NULL)")
    return lookup_join(rows, arrivals(deliveries), ["delivery_id"], "left")


def current_series(series: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(station_ref, us, value, code): the standing row of each station and time.

    That is the row of the delivery that arrived last (ties: higher id), within it the highest pos. value may be null
    (a code stands alone) or infinite.
    """
    return latest(supplied_readings(series, deliveries), ["station_ref", "us"], ["arrived_us", "delivery_id", "pos"], ["value", "code"])


def usable_readings(series: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(station_ref, us, value): current rows with a finite value."""
    return current_series(series, deliveries).select("station_ref", "us", finite("value").alias("value")).filter("value IS NOT NULL")


def station_rows(stations: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Registry rows with missing numbers as null, and arrived_us, loaded_us; rows without station_ref are left out."""
    rows = need(stations, "station_ref", "lon", "lat", "name", "altitude", "variable", "delivery_id", "loaded_at").select(
        "station_ref", *[known(c).alias(c) for c in ("lon", "lat")], "name", known("altitude").alias("altitude"), "variable", "delivery_id", us_of("loaded_at").alias("loaded_us")
    )
    return lookup_join(rows.filter("station_ref IS NOT NULL"), arrivals(deliveries), ["delivery_id"], "left")


def current_stations(stations: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(station_ref, lon, lat, name, altitude, variable): the row of the last delivery, then the last loaded."""
    return latest(station_rows(stations, deliveries), ["station_ref"], ["arrived_us", "loaded_us"], ["lon", "lat", "name", "altitude", "variable"])


def deployment_periods(deployments: DataFrame) -> DataFrame:
    """(deployment_id, station_ref, frequency_interval, starts_us, ends_us) without repeats; empty or incomplete periods are left out."""
    d = need(deployments, "deployment_id", "station_ref", "frequency_interval", "starts_at", "ends_at").select(
        "deployment_id", "station_ref", "frequency_interval", us_of("starts_at").alias("starts_us"), us_of("ends_at").alias("ends_us")
    )
    return d.filter("station_ref IS NOT NULL AND starts_us < ends_us").distinct()
