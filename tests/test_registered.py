"""Every registered query runs, and agrees with its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def database(tiny):
    connection = duckdb.connect()
    for name in os.listdir(tiny):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{tiny}/{name}'")
    return connection


def _comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, database, tiny, name):
    frame = QUERIES[name](spark, tiny)
    result = database.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(names)
    expected = _comparable(names, result.fetchall())
    assert expected, "the comparison must not be empty"
    assert _comparable(frame.columns, [tuple(r) for r in frame.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "tokens"]
