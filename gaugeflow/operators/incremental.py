"""Processing only what is new or changed: processed sequence numbers as disjoint intervals, and what they leave open.

Intervals are (lo, hi), both ends included; those that come out of an operator here are disjoint and as long as can be:
touching ones are one. They are found by a sweep over the ends of all intervals. The ends are sorted by range
partitions, and counts are carried from each partition to the next, so no task holds more than a partition of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import DAY_US, need, steps_of
from gaugeflow.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes
from gaugeflow.session import materialize
from gaugeflow.sources.files import create_once, names_in, read_text

SCHEMA = "lo bigint, hi bigint"
#: Lengths of the stretches of time, in days, by which keys that pending rows touch are told to the scan: the first that is small enough.
TOUCHED_DAYS = (1, 8, 64)


def _single(ids: DataFrame, column: str) -> DataFrame:
    return need(ids, column).select(F.col(column).cast("bigint").alias("lo")).filter("lo IS NOT NULL").withColumn("hi", F.col("lo"))


def _swept(a: DataFrame, b: DataFrame | None, kind: Column) -> DataFrame:
    """(lo, hi, kind): the longest stretches of one kind, which is a column of a and b: by how many intervals of either
    side a number is covered. Stretches of null kind are left out; intervals of a side may repeat and overlap."""
    marks = None
    for df, da, db in ((a, 1, 0), (b, 0, 1)):
        if df is None:
            continue
        for at, sign in ((F.col("lo"), 1), (F.col("hi") + 1, -1)):
            m = need(df, "lo", "hi").select(at.alias("x"), F.lit(da * sign).alias("da"), F.lit(db * sign).alias("db"))
            marks = m if marks is None else marks.unionByName(m)
    marks = marks.groupBy("x").agg(F.sum("da").alias("da"), F.sum("db").alias("db")).filter("da <> 0 OR db <> 0")
    marks = materialize(marks.repartitionByRange("x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id()), "marks")
    parts = Window.partitionBy(F.lit(0)).orderBy("part")  # over one row a partition
    before = lambda c: F.coalesce(F.sum(c).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = marks.groupBy("part").agg(F.sum("da").alias("sa"), F.sum("db").alias("sb")).select("part", before("sa").alias("a0"), before("sb").alias("b0"))
    w = Window.partitionBy("part").orderBy("x")
    upto = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = marks.withColumns({"ua": upto("da"), "ub": upto("db")}).join(F.broadcast(carried), "part")  # a row a partition
    counted = counted.withColumns({"a": F.col("a0") + F.col("ua"), "b": F.col("b0") + F.col("ub")}).withColumn("kind", kind)
    counted = counted.withColumns({"a": F.col("a") - F.col("da"), "b": F.col("b") - F.col("db")}).withColumn("was", kind)
    change = counted.filter(~F.col("kind").eqNullSafe(F.col("was"))).select("part", "x", "kind")
    firsts = change.groupBy("part").agg(F.min("x").alias("first")).select("part", F.min("first").over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    ends = change.withColumn("next", F.lead("x").over(w)).join(F.broadcast(firsts), "part")  # a row a partition
    return ends.filter("kind IS NOT NULL").select(F.col("x").alias("lo"), (F.coalesce("next", "later") - 1).alias("hi"), "kind")


def _in_a() -> Column:
    return F.col("a") > 0


def _in_b() -> Column:
    return F.col("b") > 0


def intervals_of(ids: DataFrame, column: str) -> DataFrame:
    """The numbers in the column as disjoint intervals; nulls are left out, repeats count once."""
    return _swept(_single(ids, column), None, F.when(_in_a(), True)).select("lo", "hi")


def subtract(available: DataFrame, done: DataFrame) -> DataFrame:
    """What of the available intervals isn't done: gaps left by failures and late commits as well as the newest."""
    return _swept(available, done, F.when(_in_a() & ~_in_b(), True)).select("lo", "hi")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of both, touching and overlapping intervals made one."""
    return _swept(a, b, F.when(_in_a() | _in_b(), True)).select("lo", "hi")


def members(intervals: DataFrame, column: str) -> DataFrame:
    """The numbers of the intervals, one a row."""
    return intervals.select(F.explode(F.sequence("lo", "hi")).alias(column))


def within(rows: DataFrame, intervals: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows whose number lies in an interval, with the interval's columns keep; intervals are disjoint.

    The ends of all intervals together limit the scan. Intervals are cut at blocks of about their mean length (at most
    three pieces an interval on average) and met by block, then by lo and hi: a broadcast join of measured size, else a
    salted one. Rows with a null number are left out.
    """
    s = intervals.agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo") + 1).alias("covered")).first()
    if not s["n"]:
        return rows.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in intervals.dtypes if c in keep])
    block = 1 << max(0, (s["covered"] // s["n"]).bit_length() - 1)
    pieces = intervals.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *keep, F.explode(F.sequence(steps_of(F.col("lo"), block), steps_of(F.col("hi"), block))).alias("_block"))
    near = rows.filter(F.col(column).between(s["lo"], s["hi"])).withColumn("_block", steps_of(F.col(column).cast("bigint"), block))
    met = lookup_join(near, pieces, ["_block"])
    return met.filter(F.col(column).between(F.col("_lo"), F.col("_hi"))).drop("_block", "_lo", "_hi")


def succeeded(run_log: DataFrame) -> DataFrame:
    """(delivery_id) of attempts that succeeded; repeated rows and attempts still running or failed change nothing."""
    return need(run_log, "delivery_id", "run_status").filter("run_status = 'succeeded'").select("delivery_id")


def pending_intervals(deliveries: DataFrame, run_log: DataFrame) -> DataFrame:
    """Deliveries no attempt has succeeded with, as intervals of their ids."""
    return subtract(_single(deliveries, "delivery_id"), _single(succeeded(run_log), "delivery_id"))


def delivery_intervals(deliveries: DataFrame, run_log: DataFrame) -> DataFrame:
    """(lo, hi, is_pending): ids of all deliveries that are listed or processed, as intervals, written once."""
    swept = _swept(_single(deliveries, "delivery_id"), _single(succeeded(run_log), "delivery_id"), F.when(_in_b(), False).when(_in_a(), True))
    return materialize(swept.withColumnRenamed("kind", "is_pending"), "intervals")


def with_pending(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows of the deliveries in the intervals (delivery_intervals), with is_pending; rows of a delivery that isn't
    listed and not processed are left out."""
    return within(rows, intervals, "delivery_id", ("is_pending",))


def touched_by(rows: DataFrame, intervals: DataFrame, key: str, us: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows of which the key has a row of a pending delivery within the same stretch of time, and maybe others.

    What pending rows touch is found by a scan of these alone and told to the scan of the rest, if its measured size is
    within max_bytes for one of the lengths TOUCHED_DAYS; else all rows are returned. A saving only: no key with a
    pending row is lost.
    """
    fresh = within(rows, intervals.filter("is_pending"), "delivery_id")
    stretch = lambda days: steps_of(F.col(us), days * DAY_US)
    touched = materialize(fresh.select(key, stretch(1).alias("_day")).distinct(), "touched")
    for days in TOUCHED_DAYS:
        marks = touched.select(key, steps_of(F.col("_day"), days).alias("_stretch")).distinct()
        if measured_bytes(marks) <= max_bytes:
            return rows.withColumn("_stretch", stretch(days)).join(F.broadcast(marks), [key, "_stretch"], "left_semi").drop("_stretch")  # measured above
    return rows


def changed(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """(keys, payload, is_new): keys whose standing row over all rows is new, or differs in payload, against the rows
    that aren't is_pending. The standing row is the highest in order (ties: in payload); missing equals missing.

    One aggregation, reduced before its only shuffle; each key comes at most once.
    """
    row = F.struct(*order, *payload)
    both = rows.groupBy(*keys).agg(F.max(row).alias("now"), F.max(F.when(~F.col("is_pending"), row)).alias("old"), F.max("is_pending").alias("touched"))
    same = F.col("old").isNotNull()
    for c in payload:
        same = same & F.col(f"now.{c}").eqNullSafe(F.col(f"old.{c}"))
    return both.filter(F.col("touched") & ~same).select(*keys, *[F.col(f"now.{c}").alias(c) for c in payload], F.col("old").isNull().alias("is_new"))


class CommitConflict(RuntimeError):
    """Another run committed the same version first; nothing of this run counts."""


class IntervalLedger:
    """Processed sequence numbers, kept with the output of the runs that processed them.

    A run writes what is pending, its output and the merged intervals to folders of its own, then creates one commit file
    that names them. Only that file makes them count: a run that fails before leaves nothing behind but unread folders,
    its numbers stay pending, and a repeated run can't count twice. The commit file of a version can be made once only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[str]:
        return sorted(n for n in names_in(self.spark, f"{self.path}/commits") if n.endswith(".json"))

    def _read(self, name: str) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/commits/{name}"))

    @property
    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        names = self._commits()
        return int(names[-1].split(".")[0]) if names else 0

    def processed(self) -> DataFrame:
        """Intervals processed so far."""
        names = self._commits()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self._read(names[-1])['intervals']}") if names else self.spark.createDataFrame([], SCHEMA)

    def pending(self, version: int) -> DataFrame:
        """Intervals that the run of a version processed."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self._read(f'{version:012d}.json')['pending']}")

    def outputs(self) -> DataFrame | None:
        """Rows of all committed runs; None before the first."""
        paths = [f"{self.path}/{self._read(n)['output']}" for n in self._commits()]
        return self.spark.read.parquet(*paths) if paths else None

    def run(self, available: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int | None:
        """Process the pending ones of the available intervals; the new version, or None if nothing is pending.

        process gets the pending intervals and returns the rows to write. The pending ones are written before, read once
        from the source: what comes to the source while process runs isn't in them, isn't counted as processed, and is
        the next run's. What process raises, run raises, with nothing committed. CommitConflict: another run was faster.
        """
        base = self.version
        done = self.processed()
        tag = f"data/{uuid.uuid4().hex}"
        subtract(available, done).write.parquet(f"{self.path}/{tag}/pending")
        pending = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{tag}/pending")
        if pending.isEmpty():
            return None
        process(pending).write.parquet(f"{self.path}/{tag}/output")
        merge(done, pending).write.parquet(f"{self.path}/{tag}/intervals")
        try:
            create_once(self.spark, f"{self.path}/commits/{base + 1:012d}.json", json.dumps({k: f"{tag}/{k}" for k in ("pending", "output", "intervals")}))
        except FileExistsError as e:
            raise CommitConflict(f"version {base + 1} was committed by another run") from e
        return base + 1
