"""Dimension tables: insert new keys, update known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; where a key is in both, every column comes from the new row."""
    columns = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*columns).alias("_old"))
    fresh = new.select(key, F.struct(*columns).alias("_new"))
    merged = old.join(fresh, key, "full").withColumn("_row", F.coalesce("_new", "_old"))
    return merged.select(key, "_row.*")


def upsert_report(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many keys an upsert inserts, updates and keeps."""
    flags = current.select(key, F.lit(True).alias("_in_old")).join(
        new.select(key, F.lit(True).alias("_in_new")), key, "full"
    )
    old, fresh = F.col("_in_old").isNotNull(), F.col("_in_new").isNotNull()
    return flags.agg(
        F.count_if(fresh & ~old).alias("n_inserted"),
        F.count_if(fresh & old).alias("n_updated"),
        F.count_if(old & ~fresh).alias("n_kept"),
    )
