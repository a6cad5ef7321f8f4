"""Spikes, stuck values and impossible readings, against each source's ordinary behaviour.

Every reading is held against the exact rule for spikes, in the source's usual steps; ranges and constant runs are tested
apart from it.

Readings are cut into tiles of (source, TILE_DAYS), each packed into one row with its arrays and a summary: its ends, a
histogram of its steps and of its runs. From the summaries come the source's usual step and ordinary runs, the neighbours
of each tile and the runs that cross tiles; a second pass, a row a tile and without a shuffle of readings, finds the
faults. No group is larger than a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import DAY_US, known, need, steps_of
from gaugeflow.operators.joins import lookup_join
from gaugeflow.session import materialize

TILE_DAYS = 96
#: Readings beyond a tile's ends that the exact rule may look at: a spike of 3, its neighbour, and LOCAL of these.
HALO = 12
LOCAL = 6
#: Rule: a spike is more than SPIKE_STEPS usual steps off its neighbours.
SPIKE_STEPS = 12.0
MAX_SPIKE = 3
#: profile_suspects: the sparse part counts from SPARSE_STEPS on, a jump of the low-rank part from LOW_STEPS on. Of two
#: readings more than SPIKE_STEPS apart, one has such a sparse part or there is such a jump between them (triangle
#: inequality), so its marks can't change what the rule finds; implausible_readings does without them.
SPARSE_STEPS = 2.0
LOW_STEPS = SPIKE_STEPS - 2 * SPARSE_STEPS
#: Rule: a stuck run has at least STUCK_LEAST readings, and STUCK_TIMES the length of ordinary runs.
STUCK_LEAST = 12
STUCK_TIMES = 2
#: Ordinary runs are not above the length that the longest of so many runs has by chance in one series of five.
RUN_CHANCE = 0.2
#: Buckets of steps to a doubling: steps of one bucket differ by less than 0.1 %.
STEP_BUCKETS = 1024
#: Rule: altitudes in metres, and how far one may be off its station's.
ALTITUDE_RANGE = (-500.0, 9000.0)
ALTITUDE_OFF = 50.0
#: No spikes are looked for in, and zeros are ordinary in.
NO_SPIKES = ("precipitation",)
ZEROS_ORDINARY = ("precipitation", "streamflow")


def _shrunk(x: np.ndarray, by: float) -> np.ndarray:
    """x with its singular values made smaller by `by`, through the eigenvectors of the smaller Gram matrix."""
    wide = x.shape[1] > x.shape[0]
    a = x.T if wide else x
    w, v = np.linalg.eigh(a.T @ a)
    s = np.sqrt(np.maximum(w, 0))
    keep = s > by
    v = v[:, keep]
    out = ((a @ v) * (1 - by / s[keep])) @ v.T
    return out.T if wide else out


def robust_components(x: np.ndarray, rounds: int = 40, tol: float = 1e-3) -> np.ndarray:
    """Low-rank part of x (NaN: no reading) by principal component pursuit with an augmented Lagrangian.

    x - result is the sparse part. Cells without reading take what the low-rank part has there. It stops after so many
    rounds if it hasn't converged by then: any split serves, see LOW_STEPS.
    """
    gone = np.isnan(x)
    data = np.where(gone, 0.0, x)
    norm = np.linalg.norm(data)
    if norm == 0:
        return data
    lam = 1 / np.sqrt(max(x.shape))
    top = np.sqrt(np.linalg.eigvalsh(data.T @ data if data.shape[1] <= data.shape[0] else data @ data.T)[-1])
    mu = 1.25 / top
    dual = data / max(top, np.abs(data).max() / lam)
    sparse = np.zeros_like(data)
    for _ in range(rounds):
        low = _shrunk(data - sparse + dual / mu, 1 / mu)
        data[gone] = low[gone]
        rest = data - low + dual / mu
        sparse = np.sign(rest) * np.maximum(np.abs(rest) - lam / mu, 0)
        left = data - low - sparse
        dual = dual + mu * left
        mu *= 1.5
        if np.linalg.norm(left) < tol * norm:
            break
    return low


def profile_suspects(us: np.ndarray, v: np.ndarray, step: float) -> np.ndarray:
    """Readings, in time order, that don't follow the source's daily profiles: a large sparse part, or a jump of the
    low-rank part to the reading before or after; and readings that share a cell of the matrix with an earlier one.

    A row is a UTC day. A source with under 8 readings a day has rows of 16 readings in a row instead. Not a step of
    implausible_readings, see LOW_STEPS.
    """
    cadence = np.median(np.diff(us)) if len(us) > 1 else DAY_US
    width = int(np.clip(round(DAY_US / max(cadence, 1)), 1, 1440))
    if width >= 8:
        row, col = np.divmod(us, DAY_US)
        row, col = row - row.min(), col * width // DAY_US
    else:
        width = 16
        row, col = np.divmod(np.arange(len(us)), width)
    _, row = np.unique(row, return_inverse=True)
    cell = row * width + col
    single = np.zeros(len(us), bool)
    single[np.unique(cell, return_index=True)[1]] = True
    x = np.full((row.max() + 1, width), np.nan)
    x[row[single], col[single]] = v[single]
    with np.errstate(all="ignore"):
        middle = np.median(v)
        level = np.full(width, middle)
        if x.shape[0] >= 5:
            ranked, n = np.sort(x, axis=0), (~np.isnan(x)).sum(axis=0)  # NaN last
            lo, hi = (np.take_along_axis(ranked, np.maximum(k, 0)[None], axis=0)[0] for k in ((n - 1) // 2, np.where(n % 2, (n - 1) // 2, n // 2)))
            level = np.where(n > 0, (lo + hi) / 2, middle)
    x = (x - level) / step
    low = robust_components(x)
    out = ~single
    out[single] = np.abs(x - low)[row[single], col[single]] >= SPARSE_STEPS
    normal = (level / step + low)[row, col]
    jump = np.abs(np.diff(normal)) >= LOW_STEPS
    out[1:] |= jump
    out[:-1] |= jump
    return out


def spikes(v: np.ndarray, step: float, suspect: np.ndarray | None = None) -> np.ndarray:
    """Which readings, in time order, are spikes; if suspect is given, only groups with such a reading are looked at.

    A spike is 1 to MAX_SPIKE readings off to the same side of the readings right before and right after them by more
    than SPIKE_STEPS steps. Where a neighbour may itself be (part of) a spike, the one further off the median of the
    LOCAL readings on both sides is the spike.
    """
    n = len(v)
    out = np.zeros(n, bool)
    if n < 3 or not step > 0:
        return out
    suspects_before = None if suspect is None else np.r_[0, np.cumsum(suspect)]
    begin, end = [], []
    for m in range(1, min(MAX_SPIKE, n - 2) + 1):
        parts = np.lib.stride_tricks.sliding_window_view(v, m)[1 : n - m]
        before, after = v[: n - m - 1], v[m + 1 :]
        far = np.maximum(parts.min(axis=1) - np.maximum(before, after), np.minimum(before, after) - parts.max(axis=1))
        at = np.flatnonzero(far > SPIKE_STEPS * step) + 1
        if suspects_before is not None:
            at = at[suspects_before[at + m] > suspects_before[at]]
        begin.append(at)
        end.append(at + m)
    a, b = np.concatenate(begin), np.concatenate(end)
    if not len(a):
        return out
    places = np.unique(np.concatenate([np.minimum(a + k, b - 1) for k in range(MAX_SPIKE)]))
    off = np.empty(len(places))
    inner = (places >= LOCAL) & (places < n - LOCAL)
    if inner.any():
        around = np.lib.stride_tricks.sliding_window_view(v, 2 * LOCAL + 1)[places[inner] - LOCAL]
        off[inner] = np.abs(v[places[inner]] - np.median(around, axis=1))
    for k in np.flatnonzero(~inner):  # 2 x LOCAL at most
        i = places[k]
        off[k] = abs(v[i] - np.median(v[max(0, i - LOCAL) : i + LOCAL + 1]))
    distance = np.zeros(n)
    distance[places] = off
    weight = np.minimum.reduce([distance[np.minimum(a + k, b - 1)] for k in range(MAX_SPIKE)])
    # a rival holds a neighbour and nothing of the group: it ends where the group begins, or begins where it ends
    ending, beginning = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    np.maximum.at(ending, b, weight)
    np.maximum.at(beginning, a, weight)
    wins = (ending[a] <= weight) & (beginning[b] <= weight)
    for k in range(MAX_SPIKE):
        out[np.minimum(a + k, b - 1)[wins]] = True
    return out


def _pieces(v: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1]


_TILE = (
    "station_ref string, tile bigint, n bigint, us array<bigint>, value array<double>, out_us array<bigint>, out_value array<double>, zero_ok boolean, no_spikes boolean, "
    "head array<double>, tail array<double>, steps array<double>, step_n array<bigint>, runs array<bigint>, run_n array<bigint>, ends array<struct<value:double,n:bigint>>"
)


def _packed(group: pa.Table) -> pa.Table:
    """One row of _TILE of the readings of a tile."""
    us, v, inside = (group[c].to_numpy() for c in ("us", "value", "inside"))
    out_us, out_v = us[~inside], v[~inside]
    us, v = us[inside], v[inside]
    order = np.argsort(us)
    us, v = us[order], v[order]
    zero_ok = group["zero_ok"][0].as_py()
    d = np.abs(np.diff(v)).round(9)
    steps, step_n = np.unique(d[d > 0], return_counts=True)
    starts = _pieces(v) if len(v) else np.array([], int)
    length = np.diff(np.r_[starts, len(v)])
    inner = slice(1, -1)
    counted = length[inner][~(zero_ok & (v[starts][inner] == 0))]
    runs, run_n = np.unique(counted, return_counts=True)
    ends = [0, -1][: len(starts)]
    one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
    two = lambda **c: pa.ListArray.from_arrays([0, len(next(iter(c.values())))], pa.StructArray.from_arrays([pa.array(x) for x in c.values()], list(c)))
    columns = {
        "station_ref": group["station_ref"][:1].combine_chunks(), "tile": group["tile"][:1].combine_chunks(), "n": pa.array([len(v)]), "us": one(us, pa.int64()), "value": one(v, pa.float64()),
        "out_us": one(out_us, pa.int64()), "out_value": one(out_v, pa.float64()), "zero_ok": pa.array([zero_ok]), "no_spikes": group["no_spikes"][:1].combine_chunks(),
        "head": one(v[:HALO], pa.float64()), "tail": one(v[-HALO:], pa.float64()), "steps": one(steps, pa.float64()), "step_n": one(step_n, pa.int64()), "runs": one(runs, pa.int64()), "run_n": one(run_n, pa.int64()),
        "ends": two(value=v[starts][ends], n=length[ends].astype("int64")),
    }
    return pa.table(columns)


def usual_steps(steps: DataFrame) -> DataFrame:
    """(station_ref, usual_step): exact median of steps (station_ref, step > 0, n).

    Counts by bucket (STEP_BUCKETS to a doubling) tell which bucket holds the middle; only the steps of that one, about a
    thousandth of a source's, are ranked.
    """
    s = steps.withColumn("bucket", F.floor(F.log2("step") * STEP_BUCKETS))
    w = Window.partitionBy("station_ref")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    b = s.groupBy("station_ref", "bucket").agg(F.sum("n").alias("n")).select("station_ref", "bucket", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(w).alias("all"))
    half = F.call_function("div", F.col("all"), F.lit(2))
    middle = b.select("station_ref", "bucket", "before", "upto", (F.col("all") - half).alias("k1"), (half + 1).alias("k2")).filter("upto >= k1 AND before < k2").drop("upto")
    near = lookup_join(s, middle, ["station_ref", "bucket"]).groupBy("station_ref", "bucket", "before", "k1", "k2", "step").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("station_ref", "bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    c = near.withColumn("upto", F.col("before") + F.sum("n").over(run))
    lower, upper = (F.min(F.when(F.col("upto") >= F.col(k), F.col("step"))) for k in ("k1", "k2"))
    return c.groupBy("station_ref").agg(((lower + upper) / 2).alias("usual_step"))


def stuck_limits(runs: DataFrame) -> DataFrame:
    """(station_ref, stuck_from): length from which a run is stuck, by runs (station_ref, length, n).

    Ordinary runs are the longest below STUCK_LEAST, or what the longest of so many runs may well have by chance
    (RUN_CHANCE), if that is more: runs of a source that stays the same from one reading to the next with probability p are
    k long with p^(k-1), and p follows from their mean. Where more than one run in twenty (and at least five) has
    STUCK_LEAST readings, it is the source's nature, and ordinary runs are the 95 % quantile of all.
    """
    counted = runs.groupBy("station_ref", "length").agg(F.sum("n").alias("n"))
    long = F.col("length") >= STUCK_LEAST
    s = counted.groupBy("station_ref").agg(
        F.max(F.when(~long, F.col("length"))).alias("short"), F.sum(F.when(long, F.col("n")).otherwise(0)).alias("longs"), F.sum("n").alias("all"), F.percentile("length", F.lit(0.95), F.col("n")).alias("q95"),
        F.sum(F.when(~long, F.col("n") * F.col("length"))).alias("readings"),
    )
    shorts = F.col("all") - F.col("longs")
    tail = F.when(F.col("readings") > shorts, 1 + F.log(shorts / F.lit(RUN_CHANCE)) / -F.log(1 - shorts / F.col("readings"))).otherwise(1.0)
    ordinary = F.when((F.col("longs") >= 5) & (F.col("longs") * 20 > F.col("all")), F.greatest("q95", F.col("short"))).otherwise(F.coalesce(F.greatest("short", tail), F.lit(1)))
    return s.select("station_ref", F.greatest(F.lit(float(STUCK_LEAST)), F.lit(float(STUCK_TIMES)) * ordinary).alias("stuck_from"))


_FAULTS = "station_ref string, us bigint, value double, reason string"


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults of packed tiles with their marks, a tile a row."""
    for batch in batches:
        refs, us_, values, reasons = [], [], [], []

        def add(ref: str, us: np.ndarray, v: np.ndarray, reason: str) -> None:
            refs.extend([ref] * len(us))  # noqa: B023
            reasons.extend([reason] * len(us))  # noqa: B023
            us_.append(us)  # noqa: B023
            values.append(v)  # noqa: B023

        array = lambda c, i: batch[c][i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
        small = batch.select(["station_ref", "n", "zero_ok", "no_spikes", "usual_step", "stuck_from", "first_run", "last_run"]).to_pylist()
        for i, tile in enumerate(small):
            ref = tile["station_ref"]
            add(ref, array("out_us", i), array("out_value", i), "range")
            if not tile["n"]:
                continue
            us, v = array("us", i), array("value", i)
            if not tile["no_spikes"]:
                before, after = array("before", i), array("after", i)
                spike = spikes(np.concatenate([before, v, after]), tile["usual_step"] or 0.0)[len(before) :][: len(v)]
                add(ref, us[spike], v[spike], "spike")
            starts = _pieces(v)
            length = np.diff(np.r_[starts, len(v)])
            total = length.copy()
            total[0], total[-1] = tile["first_run"], tile["last_run"]
            limit = np.inf if tile["stuck_from"] is None else tile["stuck_from"]
            stuck = np.repeat((total >= limit) & ~(tile["zero_ok"] & (v[starts] == 0)), length)
            add(ref, us[stuck], v[stuck], "stuck")
        if refs:
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(np.concatenate(us_), pa.int64()), pa.array(np.concatenate(values), pa.float64()), pa.array(reasons, pa.string())], ["station_ref", "us", "value", "reason"])


def implausible_readings(current: DataFrame, station_variables: DataFrame, encodings: DataFrame, tile_days: int = TILE_DAYS) -> DataFrame:
    """(station_ref, us, value, reason) of faulty current values; reason is 'range', 'spike' or 'stuck', a row for each.

    current: (station_ref, us, value), one row a time. station_variables: (station_ref, variable). encodings: (variable,
    min_value, max_value). A value outside the bounds (which are allowed), or infinite, is 'range'; the others, in time
    order, are tested for spikes (not in NO_SPIKES) and for runs of one value (zeros of ZEROS_ORDINARY are ordinary). A
    source of unknown variable has no bounds (of two variables or bounds the higher stands); a null bound isn't one. A source without any step has no spikes. Null and
    NaN values and null times are left out.
    """
    rows = need(current, "station_ref", "us", "value").select("station_ref", "us", known("value").alias("value")).filter("station_ref IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL")
    bounds = need(encodings, "variable", "min_value", "max_value").filter("variable IS NOT NULL").groupBy("variable").agg(F.max(F.struct("min_value", "max_value")).alias("_b")).select("variable", "_b.min_value", "_b.max_value")
    kinds = need(station_variables, "station_ref", "variable").filter("station_ref IS NOT NULL").groupBy("station_ref").agg(F.max("variable").alias("variable")).join(bounds, "variable", "left")
    rows = lookup_join(rows, materialize(kinds, "kinds"), ["station_ref"], "left")
    inf = float("inf")
    inside = (F.abs("value") < inf) & (F.col("value") >= F.coalesce(F.col("min_value"), F.lit(-inf))) & (F.col("value") <= F.coalesce(F.col("max_value"), F.lit(inf)))
    flag = lambda names: F.coalesce(F.col("variable").isin(*names), F.lit(False))
    rows = rows.select("station_ref", "us", "value", inside.alias("inside"), flag(ZEROS_ORDINARY).alias("zero_ok"), flag(NO_SPIKES).alias("no_spikes"), steps_of(F.col("us"), tile_days * DAY_US).alias("tile"))
    tiles = materialize(rows.groupBy("station_ref", "tile").applyInArrow(_packed, _TILE), "tiles")
    held = tiles.filter("n > 0")

    w = Window.partitionBy("station_ref").orderBy("tile")
    chain = held.select("station_ref", "tile", "zero_ok", F.posexplode("ends").alias("at", "end")).select("station_ref", "tile", "at", "zero_ok", "end.value", "end.n")
    order = Window.partitionBy("station_ref").orderBy("tile", "at")
    new = (F.col("at") == 1) | ~F.lag("value").over(order).eqNullSafe(F.col("value"))
    chain = chain.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = chain.withColumn("total", F.sum("n").over(Window.partitionBy("station_ref", "run")))
    crossing = chain.filter(~(F.col("zero_ok") & (F.col("value") == 0))).groupBy("station_ref", "run").agg(F.first("total").alias("length")).select("station_ref", "length", F.lit(1).cast("bigint").alias("n"))
    inner = held.select("station_ref", F.explode(F.arrays_zip("runs", "run_n")).alias("r")).select("station_ref", F.col("r.runs").alias("length"), F.col("r.run_n").alias("n"))
    limits = stuck_limits(inner.unionByName(crossing))

    steps = held.select("station_ref", F.explode(F.arrays_zip("steps", "step_n")).alias("s")).select("station_ref", F.col("s.steps").alias("step"), F.col("s.step_n").alias("n"))
    jump = F.round(F.abs(F.element_at("head", 1) - F.lag(F.element_at("tail", -1)).over(w)), 9)
    between = held.select("station_ref", jump.alias("step"), F.lit(1).cast("bigint").alias("n")).filter("step > 0")
    usual = usual_steps(steps.unionByName(between))

    edges = chain.groupBy("station_ref", "tile").agg(F.min_by("total", "at").alias("first_run"), F.max_by("total", "at").alias("last_run"))
    before = F.flatten(F.collect_list("tail").over(w.rowsBetween(-HALO, -1)))
    after = F.flatten(F.collect_list("head").over(w.rowsBetween(1, HALO)))
    marks = held.select("station_ref", "tile", F.slice(before, F.greatest(F.size(before) - HALO + 1, F.lit(1)), HALO).alias("before"), F.slice(after, 1, HALO).alias("after"))
    marks = marks.join(edges, ["station_ref", "tile"]).join(usual, "station_ref", "left").join(limits, "station_ref", "left")
    whole = tiles.select("station_ref", "tile", "n", "us", "value", "out_us", "out_value", "zero_ok", "no_spikes").join(marks, ["station_ref", "tile"], "left")
    return whole.drop("tile").mapInArrow(_faults, _FAULTS)


def implausible_altitudes(stations: DataFrame) -> DataFrame:
    """(station_ref, loaded_us, altitude, reason) of faulty registry rows; reason is 'range' or 'differs'.

    stations: (station_ref, altitude, loaded_us). 'range': outside ALTITUDE_RANGE or infinite. 'differs': more than
    ALTITUDE_OFF from the altitude the station's rows agree on, which is the median of those with an altitude, given at
    least three and if more than half of them are within ALTITUDE_OFF of it. Repeated rows count once; null and NaN
    altitudes are no altitude.
    """
    rows = need(stations, "station_ref", "altitude", "loaded_us").select("station_ref", known("altitude").alias("altitude"), "loaded_us").filter("station_ref IS NOT NULL AND altitude IS NOT NULL").distinct()
    middle = rows.groupBy("station_ref").agg(F.percentile("altitude", F.lit(0.5)).alias("middle"), F.count("*").alias("rows"))
    near = F.abs(F.col("altitude") - F.col("middle")) <= ALTITUDE_OFF
    joined = lookup_join(rows, middle, ["station_ref"])
    agree = joined.filter(near).groupBy("station_ref").agg(F.count("*").alias("agreeing"))
    out = lookup_join(joined, agree, ["station_ref"], "left")
    differs = (F.col("rows") >= 3) & (F.coalesce("agreeing", F.lit(0)) * 2 > F.col("rows")) & ~near
    beyond = ~F.col("altitude").between(*ALTITUDE_RANGE)
    return out.filter(beyond | differs).select("station_ref", "loaded_us", "altitude", F.when(beyond, "range").otherwise("differs").alias("reason"))
