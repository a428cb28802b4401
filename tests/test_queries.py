"""Every query with SQL gives the rows of its SQL; every query gives columns of known types."""

import datetime as dt
import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(columns, cells):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in cells), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    r = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, r.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_runs_without_the_subpackage():
    import subprocess
    import sys

    code = """
import sys
sys.modules['folioscope.llm'] = None
import __spark_entry__ as entry
from folioscope.session import local_session
names = entry.queries()
assert 'p4_found' in names and 'p1_found' not in names and set(entry.oracle_sql()) <= set(names)
spark = local_session(2, 2)
assert names['cite_gaps'](spark, '/root/testdata/sf0.001').count() >= 0 and entry.entry(spark).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
