import datetime
import decimal
import glob
import importlib
import os
import sys

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    at = [x[0] for x in res.description]
    assert sorted(at) == cols
    assert got == sorted(repr(tuple(norm(r[at.index(c)]) for c in cols)) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql()))
def test_other_queries_run(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry_and_names(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("petalstream.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "petalstream.llm", None)
    fresh = importlib.reload(entry)
    assert "p5_found" in fresh.queries() and "p2_found" not in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)
