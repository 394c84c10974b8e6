"""Every registered query with SQL against that SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from waymark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if value is None or pd.isna(value):
        return "-"
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6)).removesuffix(".0")
    return str(value).replace("+00:00", "")


def table(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["origin_id", "id", "distance_m", "rank"]
    assert set(registry.QUERIES) == set(registry.ORACLE) and set(entry.oracle_sql()) <= set(entry.queries())
