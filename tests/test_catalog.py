"""Every core query against its SQL on the smallest data."""

import glob
import os

import pytest

from inkstone.plans.catalog import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, ROOT)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect())
    assert got == want


def test_every_core_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_quantised_search_finds_nearly_all(spark):
    assert QUERIES["vec_sq8_recall"](spark, ROOT).first()["recall"] >= 0.9
