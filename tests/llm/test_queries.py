"""The pN_ queries: against SQL where there is some, else that they run, on the smallest test data."""

import glob
import os

import duckdb
import pytest

from sieveloom.llm.oracle import ORACLE
from sieveloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    if name in ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        cols = [c[0] for c in con.execute(ORACLE[name]).description]
        mine = QUERIES[name](spark, SF).select(*cols).collect()
        assert sorted(map(str, map(tuple, mine))) == sorted(map(str, con.execute(ORACLE[name]).fetchall()))
    else:
        assert got or name in ("p5_found", "p5_clusters")
