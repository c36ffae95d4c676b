"""Every registered query against its SQL on the smallest tables, value by value."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import SMALL
from workload import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return sorted((tuple(plain(row[n]) for n in order) for row in rows), key=repr)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SMALL)
    relation = duck.execute(entry_points.oracle_sql()[name])
    names = [column[0] for column in relation.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.collect(), got.columns) == canonical(relation.fetchall(), names)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
