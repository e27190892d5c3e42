"""The queries with SQL agree with it on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from basketwise.llm.queries import ORACLES, QUERIES

from .conftest import TABLES


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{entry.SMALL}/{t}.parquet'")
    frame = QUERIES[name](spark, entry.SMALL)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert normal(frame.columns, frame.collect()) == normal(names, cursor.fetchall())


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
