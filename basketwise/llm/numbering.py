"""Places of rows within ordered groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketwise.session import materialise


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds `index`, the place of a row in its group from 0, and `total`, the rows of the group.

    Rows are dealt by ranges of (group, order), so that a group that holds most rows spreads over
    many tasks, equal rows included; what a task holds of a group is a run of it. The places follow
    from the counts of the runs. The groups must not be null; nulls of the order come first.
    """
    key = [group, *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    stamped = materialise(dealt.drop("tie").withColumn("stamp", F.monotonically_increasing_id()), "stamped")
    # A stamp is the number of the task, then that of the row within it.
    run = F.shiftright("stamp", 33)
    runs = stamped.groupBy(group, run.alias("run")).agg(F.min("stamp").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    ahead = F.sum("rows").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(
        group, "run", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("total")
    )
    placed = stamped.withColumn("run", run).join(materialise(starts, "starts"), [group, "run"])
    return placed.withColumn("index", F.col("stamp") + F.col("shift")).drop("run", "stamp", "shift")
