"""Every registered query against its SQL, and the entry point without the optional subpackage."""

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or hasattr(x, "isoformat"):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert got - want == Counter() == want - got


def test_without_the_text_operators():
    code = "import sys; sys.modules['gaugeflow.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith(('p6', 'p7', 'p8'))]"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_names():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["series_key", "ts", "value"] and df.count() > 0
