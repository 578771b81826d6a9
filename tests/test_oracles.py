"""Every query against its SQL twin in a second engine, on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "WOBA" in df.columns


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    found = table(df.columns, df.collect())
    result = duck.execute(entry.oracle_sql()[key])
    expected = table([c[0] for c in result.description], result.fetchall())
    assert found == expected
    kinds = {c[0]: str(c[1]).lower() for c in result.description}
    twins = {"int": "integer", "string": "varchar"}
    assert {n: twins.get(t, t) for n, t in df.dtypes} == kinds
