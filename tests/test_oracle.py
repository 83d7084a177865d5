"""Every query with SQL against DuckDB on the smallest test data."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sieveloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v) if math.isfinite(v) else str(v)
    if hasattr(v, "item"):
        return cell(v.item())
    return str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    mine = rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(plans.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    theirs = rows(cur.fetchall(), names)
    if mine != theirs:  # the smallest data may hold a last digit more or less
        close = lambda a, b: a == b or (a not in ("null",) and b not in ("null",) and _near(a, b))
        assert len(mine) == len(theirs) and all(close(x, y) for r, s in zip(mine, theirs) for x, y in zip(r, s))


def _near(a, b):
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
