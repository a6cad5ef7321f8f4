"""The dense time axis of a dataset: bounds, index, gaps, dense view, and the overlay of incoming slots on stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import steps_of
from gaugeflow.operators.neighbours import with_neighbours

#: Steps that one row makes at a time.
CHUNK_STEPS = 10_000


def axis_bounds(slots: DataFrame, step_us: int, us: str = "us") -> DataFrame:
    """One row (t0_us, tn_us, n_steps) over all times, of missing values too; nulls and 0 if there is none."""
    b = slots.agg(F.min(us).alias("t0_us"), F.max(us).alias("tn_us"))
    return b.withColumn("n_steps", F.coalesce(steps_of(F.col("tn_us") - F.col("t0_us"), step_us) + 1, F.lit(0)).cast("bigint"))


def last_of_slot(slots: DataFrame, planes: list[str], key: str = "station_ref", us: str = "us", pos: str = "pos") -> DataFrame:
    """(key, us, planes): of each key and time the row of the highest pos, missing values included."""
    row = F.struct(pos, *planes)
    return slots.groupBy(key, us).agg(F.max(row).alias("_row")).select(key, us, *[F.col(f"_row.{p}").alias(p) for p in planes])


def dense_grid(stations: DataFrame, facts: DataFrame, axis: DataFrame, step_us: int, planes: list[str], key: str = "station_ref", us: str = "us") -> DataFrame:
    """(key, us, planes): every station at every step of the axis (one row of axis_bounds), null where nothing is stored.

    Stations without facts are there too; null keys are not. Steps are made where the stations are, CHUNK_STEPS at a
    time, so that the axis is in no row as a whole.
    """
    a = axis.first()
    n = a["n_steps"] if a else 0
    grid = stations.select(key).filter(F.col(key).isNotNull()).distinct()
    if not n:
        return grid.select(key, F.lit(None).cast("bigint").alias(us), *[F.lit(None).cast(t).alias(c) for c, t in facts.select(*planes).dtypes]).limit(0)
    whole, first = F.lit(a["tn_us"]), F.explode(F.sequence(F.lit(a["t0_us"]), F.lit(a["tn_us"]), F.lit(CHUNK_STEPS * step_us).cast("bigint"))).alias("_from")
    grid = grid.select(key, first).select(key, F.explode(F.sequence("_from", F.least(F.col("_from") + (CHUNK_STEPS - 1) * step_us, whole), F.lit(step_us).cast("bigint"))).alias(us))
    return grid.join(facts.select(key, us, *planes), [key, us], "left")


def gap_steps(slots: DataFrame, step_us: int, key: str = "station_ref", us: str = "us") -> DataFrame:
    """(key, us, gap_steps): stored steps after which steps are missing up to the next stored one, and how many.

    Repeated slots count once; null keys and times are left out.
    """
    near = with_neighbours(slots.select(key, us).dropna().distinct(), key, us, [], 1)
    w = Window.partitionBy("tile", key).orderBy(us)
    d = near.withColumn("gap_steps", steps_of(F.lead(us).over(w) - F.col(us), step_us) - 1)
    return d.filter("is_core AND gap_steps > 0").select(key, us, "gap_steps")


def supplied(incoming: DataFrame, planes: list[str]) -> DataFrame:
    """Incoming slots that have anything: a value or any ancillary."""
    return incoming.filter(F.coalesce(*planes).isNotNull())


def overlay(stored: DataFrame, incoming: DataFrame, keys: list[str], planes: list[str]) -> DataFrame:
    """(keys, planes): stored slots, each replaced as a whole where incoming supplies anything for it.

    An incoming slot with nothing in it changes nothing; one with an ancillary but no value erases the stored value.
    incoming must have one row a slot. One aggregation over both sides rather than a join: no side is sent about twice.
    """
    both = stored.select(*keys, *planes, F.lit(0).alias("_side")).unionByName(supplied(incoming, planes).select(*keys, *planes, F.lit(1).alias("_side")))
    best = both.groupBy(*keys).agg(F.max(F.struct("_side", *planes)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{p}").alias(p) for p in planes])
