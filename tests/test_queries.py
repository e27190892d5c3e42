"""Every named query runs on the small tables and agrees with its SQL."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as entry
from basketwise.plans.catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = entry.SMALL
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert normal(frame.columns, frame.collect()) == normal(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
