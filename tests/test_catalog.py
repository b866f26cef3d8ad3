"""Every catalogue query against its SQL in DuckDB, and the driver contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog, clip_oracles, oracles

SQL = oracles.SQL | clip_oracles.SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["video", "start_us", "end_us", "n"]
