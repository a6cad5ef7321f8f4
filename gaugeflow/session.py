"""Session helpers: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: (file system, path) of every table materialize() wrote outside a scratch() and nothing has deleted yet.
_WRITTEN: list[tuple] = []
_SCOPES = threading.local()
#: Names of UTC that a session zone may have.
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00", "UTC+0", "Zulu")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: spark.checkpoint.dir.

    Only where that is unset and driver and executors are one process (master local, as in tests), an own temporary one;
    on a cluster an unset folder raises, for what executors write to disks of their own can't be read back.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if set_:
        return set_.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="gaugeflow-")
    return _OWN[app]


def utc_session(spark: SparkSession | None = None) -> bool:
    """Whether the session's zone is UTC, so that times without zone are UTC to Spark as well."""
    spark = spark or SparkSession.getActiveSession()
    return spark is not None and spark.conf.get("spark.sql.session.timeZone") in _UTC


def check_strict(spark: SparkSession) -> None:
    """Raise RuntimeError unless bad casts fail (ANSI mode): with it off, a bad text would silently become null."""
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise RuntimeError("spark.sql.ansi.enabled must be true: bad numbers have to fail, not to vanish")


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a URI, through Hadoop, so that local and object stores are alike."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts lineage like checkpoint(), but computes df once only, survives the loss of executors and lets the next
    steps prune columns. The table goes with the scratch() around the call, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaugeflow-{name}-{uuid.uuid4().hex}"
    (getattr(_SCOPES, "open", None) or [_WRITTEN])[-1].append(hadoop_path(spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(written: list[tuple]) -> None:
    for fs, p in written:
        try:
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; the others still get their turn
            pass


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that materialize() writes inside, in this thread, are deleted at the end: for operators whose result is
    written or counted by then."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield
    finally:
        _drop(_SCOPES.open.pop())


def drop_materialized() -> None:
    """Delete what materialize() wrote, also after the session was stopped."""
    own = _WRITTEN[:]
    _WRITTEN.clear()
    _drop(own)
    for path in _OWN.values():
        import shutil

        shutil.rmtree(path, ignore_errors=True)
    _OWN.clear()


atexit.register(drop_materialized)
