"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import normal

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_consistent():
    assert set(ORACLES) <= set(entry.queries())
