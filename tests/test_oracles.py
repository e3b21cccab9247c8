"""Every registered query against its SQL statement at the smallest scale."""

import math

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def key(row):
    return tuple(f"{v:.12g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    rows = QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    expected = db.sql(ORACLES[name])
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    assert sorted(map(key, rows.select(*columns).collect())) == sorted(key([r[i] for i in order]) for r in expected.fetchall())


def test_all_but_runtime_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"orchestrated_run"}
