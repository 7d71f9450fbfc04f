"""Every registered query of the time-series operators against its SQL, on a slice of the smallest tables."""

import math

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from polytrace.queries import ORACLE_SQL, QUERIES

from .conftest import DATA

TABLES = {"embeddings": 24, "events": 400, "lineitem": 500, "orders": 200, "conversations": 120, "documents": 40, "labels": 60}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    con = duckdb.connect()
    for name, n in TABLES.items():
        t = pq.read_table(f"{DATA}/{name}.parquet").slice(0, n)
        pq.write_table(t, folder / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, name):
    folder, con = small
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small[0]).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["condition", "channel", "point", "value", "t", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
