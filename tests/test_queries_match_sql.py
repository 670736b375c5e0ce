"""Every registered query against its SQL in DuckDB, on the whole tables of the smallest scale."""

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest

from siftline.plans import catalog
from siftline.sources.tables import SCHEMAS

DIRECTORY = os.environ.get("SIFTLINE_TEST_DIR", "/root/testdata/sf0.001")
_spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in SCHEMAS:
        connection.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DIRECTORY)
    got = [tuple(r) for r in df.collect()]
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert check.canonical(df.columns, got) == check.canonical(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"ml_tfidf_lr_train", "ml_predict", "ml_second_committee_member"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIRECTORY).collect() is not None
