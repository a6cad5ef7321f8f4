"""Irregular readings onto the regular slots of each source's deployment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import finite, need, steps_of
from gaugeflow.functions.durations import FIXED_CODES
from gaugeflow.operators.joins import lookup_join

#: Slots of one chunk: the most that one group of the merge has, besides the halo.
CHUNK_SLOTS = 4096


def _as_of(grid: np.ndarray, first_us: np.ndarray, first_v: np.ndarray, last_us: np.ndarray, last_v: np.ndarray, limit: int) -> np.ndarray:
    """Value at each grid time by linear interpolation, weighted by the times to the readings on either side.

    Readings are given as the first and last of consecutive stretches, all stretches cut at grid times. NaN where a
    side has no reading or the two are more than limit apart.
    """
    before = np.searchsorted(first_us, grid, side="right") - 1  # an exact reading is the first of its stretch
    after = np.searchsorted(first_us, grid, side="left")
    out = np.full(len(grid), np.nan)
    if not len(first_us):
        return out
    exact = (after < len(first_us)) & (first_us[np.minimum(after, len(first_us) - 1)] == grid)
    out[exact] = first_v[after[exact]]
    both = ~exact & (before >= 0) & (after < len(first_us))
    b, a, g = before[both], after[both], grid[both]
    t0, t1, v0, v1 = last_us[b], first_us[a], last_v[b], first_v[a]
    w = (g - t0) / np.maximum(t1 - t0, 1)
    out[both] = np.where(t1 - t0 <= limit, v0 * (1 - w) + v1 * w, np.nan)
    return out


def regular_grid(readings: DataFrame, periods: DataFrame, gap_slots: int = 3, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """(deployment_id, station_ref, slot_us, n_readings, value, state): one row per slot of each deployment.

    readings: usable (station_ref, us, value), one a time. periods: (deployment_id, station_ref, frequency_interval,
    starts_us, ends_us). Slots start at starts_us and every interval after it, before ends_us; a slot holds its start
    and not its end. state is 'observed' if a reading lies in the slot; else 'filled' if value could be interpolated,
    else 'missing'. value is the signal at slot_us: the reading there, or the time-weighted linear interpolation
    between the last reading before and the first after it, when these are at most gap_slots intervals apart; failing
    that, an observed slot takes its first reading and a missing one null. Readings outside the deployment serve as
    neighbours too. Null or non-finite readings, and periods with an unknown interval, are left out.

    Readings are first reduced to the first and last of each slot, before the shuffle, so that the as-of merge meets
    at most chunk_slots + 2 x gap_slots slots in a group however dense the readings are; chunks of one source are
    separate groups, with a halo as long as the gap limit.
    """
    if gap_slots < 1 or chunk_slots <= gap_slots + 1:
        raise ValueError("gap_slots must be at least 1 and a chunk longer than it")
    step = F.create_map(*[F.lit(x) for kv in FIXED_CODES.items() for x in kv])
    p = need(periods, "deployment_id", "station_ref", "frequency_interval", "starts_us", "ends_us").withColumn("step_us", F.try_element_at(step, F.col("frequency_interval")))
    p = p.filter("step_us IS NOT NULL AND station_ref IS NOT NULL AND starts_us < ends_us").drop("frequency_interval").distinct()
    p = p.withColumn("n_slots", F.call_function("div", F.col("ends_us") - F.col("starts_us") - 1, F.col("step_us")) + 1).drop("ends_us")
    key = ["deployment_id", "station_ref", "starts_us", "step_us", "n_slots"]
    r = need(readings, "station_ref", "us", "value").select("station_ref", "us", finite("value").alias("value")).filter("value IS NOT NULL AND us IS NOT NULL")
    halo = gap_slots + 1
    k = steps_of(F.col("us") - F.col("starts_us"), F.col("step_us"))
    near = lookup_join(r, p, ["station_ref"]).withColumn("k", k).filter(F.col("k").between(-halo, F.col("n_slots") - 1 + halo))
    one = F.struct("us", "value")
    slots = near.groupBy(*key, "k").agg(F.count("*").alias("n"), F.min(one).alias("first"), F.max(one).alias("last"))
    slots = slots.select(*key, "k", "n", F.col("first.us").alias("first_us"), F.col("first.value").alias("first_v"), F.col("last.us").alias("last_us"), F.col("last.value").alias("last_v"))
    top = steps_of(F.col("n_slots") - 1, chunk_slots)
    inside = lambda c: F.least(F.greatest(c, F.lit(0).cast("bigint")), top)
    chunks = F.sequence(inside(steps_of(F.col("k") - halo, chunk_slots)), inside(steps_of(F.col("k") + halo, chunk_slots)))
    facts = slots.withColumn("chunk", F.explode(chunks))
    zero = F.lit(0).cast("bigint")
    marks = p.withColumn("chunk", F.explode(F.sequence(zero, top))).withColumns({c: zero for c in ("k", "n", "first_us", "last_us")} | {c: F.lit(0.0) for c in ("first_v", "last_v")})
    rows = facts.unionByName(marks)
    id_type = dict(periods.dtypes)["deployment_id"]
    schema = f"deployment_id {id_type}, station_ref string, slot_us bigint, n_readings bigint, value double, state string"

    def merge(group: pa.Table) -> pa.Table:
        start, step_us, n_slots, chunk = (group[c][0].as_py() for c in ("starts_us", "step_us", "n_slots", "chunk"))
        ks = np.arange(chunk * chunk_slots, min((chunk + 1) * chunk_slots, n_slots))
        grid = start + ks * step_us
        n, k, first_us, first_v, last_us, last_v = (group[c].to_numpy() for c in ("n", "k", "first_us", "first_v", "last_us", "last_v"))
        own = np.flatnonzero(n > 0)
        own = own[np.argsort(first_us[own])]
        value = _as_of(grid, first_us[own], first_v[own], last_us[own], last_v[own], gap_slots * step_us)
        count, first = np.zeros(len(ks), "int64"), np.full(len(ks), np.nan)
        at = k[own] - ks[0]
        here = (at >= 0) & (at < len(ks))
        count[at[here]], first[at[here]] = n[own][here], first_v[own][here]
        state = np.where(count > 0, 0, np.where(np.isnan(value), 2, 1))
        value = np.where(np.isnan(value), first, value)
        names = pa.DictionaryArray.from_arrays(pa.array(state, pa.int8()), pa.array(["observed", "filled", "missing"])).cast(pa.string())
        whole = lambda c: pa.repeat(group[c][0], len(ks))
        return pa.table({"deployment_id": whole("deployment_id"), "station_ref": whole("station_ref"), "slot_us": grid, "n_readings": count, "value": value, "state": names})

    out = rows.groupBy("deployment_id", "station_ref", "starts_us", "step_us", "n_slots", "chunk").applyInArrow(merge, schema)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
