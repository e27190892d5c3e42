import duckdb
import pytest

from __spark_entry__ import SMALL

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def tables():
    """Rows of the small tables, as lists of dicts."""
    db = duckdb.connect()
    out = {}
    for t in TABLES:
        cursor = db.execute(f"SELECT * FROM '{SMALL}/{t}.parquet'")
        names = [d[0] for d in cursor.description]
        out[t] = [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
    return out
