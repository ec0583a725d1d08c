"""Every registered query with an oracle against DuckDB on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        view = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    result = compare(spark, db, name, SF)
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0
