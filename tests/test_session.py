"""Shared folder, scratch tables, and times in sessions of another zone."""

import subprocess
import sys
import textwrap
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.columns import month_of, us_of
from gaugeflow.session import check_strict, materialize, scratch, shared_dir

REPO = Path(__file__).resolve().parents[1]


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def cluster(master, folder=None):
    conf = SimpleNamespace(get=lambda *_: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master, applicationId="x"))


def test_a_cluster_needs_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(cluster(master))
        assert shared_dir(cluster(master, "hdfs:///x/")) == "hdfs:///x"


def test_times_do_not_depend_on_the_session_zone(new_york):
    texts = ["2024-03-10 02:30:00", "2024-11-03 01:30:00.000001", "1969-12-31 23:59:59.5", "2024-01-05T12:30:00Z", "2024-01-05 12:30:00+05:00", "2024-01-05", " 2024-01-05 00:00:00"]
    want = [1_710_037_800_000_000, 1_730_597_400_000_001, -500_000, 1_704_457_800_000_000, 1_704_439_800_000_000, 1_704_412_800_000_000, 1_704_412_800_000_000]
    df = new_york.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.us for r in df.select("i", us_of("t").alias("us")).orderBy("i").collect()] == want
    ntz = df.filter("i in (0, 1, 2, 5)").select("i", F.col("t").cast("timestamp_ntz").alias("t"))
    assert {r.i: r.us for r in ntz.select("i", us_of("t").alias("us")).collect()} == {i: want[i] for i in (0, 1, 2, 5)}
    assert [r.us for r in df.filter("i = 5").select(us_of(F.col("t").cast("date")).alias("us")).collect()] == [want[5]]
    assert [r.us for r in new_york.range(1).select(us_of(F.timestamp_micros(F.lit(want[0]))).alias("us")).collect()] == [want[0]]
    edges = [(-1, "1969-12"), (0, "1970-01"), (1_706_745_599_999_999, "2024-01"), (1_706_745_600_000_000, "2024-02")]
    assert {tuple(r) for r in new_york.createDataFrame(edges, "us long, m string").select("us", month_of(F.col("us")).alias("m")).collect()} == set(edges)


def test_strict_casts_are_needed(spark):
    check_strict(spark)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(RuntimeError, match="ansi"):
            check_strict(spark)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def _tables(spark):
    return set(Path(shared_dir(spark)).glob("gaugeflow-scratchtest-*"))


def test_scratch_tables_go_with_their_scope(spark):
    keep = materialize(spark.range(3), "scratchtest")
    with scratch():
        assert materialize(spark.range(5), "scratchtest").count() == 5 and len(_tables(spark)) == 2
    assert len(_tables(spark)) == 1 and keep.count() == 3


def test_tables_go_after_the_session_was_stopped(tmp_path):
    code = f"""
    from pyspark.sql import SparkSession
    from gaugeflow.session import materialize
    s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
    for i in range(3):
        materialize(s.range(3), "x")
    s.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=REPO, check=True, capture_output=True)
    assert not list(tmp_path.glob("gaugeflow-*"))
