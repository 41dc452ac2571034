"""The llm queries on the smallest data: they run, and equal their SQL where there is one."""

import glob
import os

import pytest

from inkstone.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, ROOT)
    rows = df.collect()
    if name not in ORACLES:
        return
    con = pytest.importorskip("duckdb").connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in df.columns)) for r in rows) == sorted(repr(tuple(r[columns.index(c)] for c in df.columns)) for r in cursor.fetchall())
