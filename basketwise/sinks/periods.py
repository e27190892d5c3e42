"""A table kept by half month on disk, of which the newest period is read alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from basketwise.fixed import SURVEY_WINDOW_HALVES
from basketwise.sources.survey import latest_period

PERIOD = "period"


def publish_periods(rows: DataFrame, path: str, period: str = PERIOD) -> None:
    """Writes rows into the folders of their periods.

    A period that is published again replaces the one that is there; others stay as they are,
    and no rows leave the table as it is. Rows without a period are kept in a folder of their
    own, which no window reads. Rebalancing brings a period into few files and splits one that
    holds a large part of the rows.
    """
    placed = rows.hint("rebalance", period)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def newest_period(
    spark: SparkSession, path: str, schema: str, as_of: Column, period: str = PERIOD, halves: int = SURVEY_WINDOW_HALVES
) -> DataFrame:
    """Rows of the newest period of the window up to a date; of the other folders at most footers are read.

    The window is a constant, so it prunes folders while planning; which of them is the newest
    is found by a subquery over the period alone, whose result prunes the scan to one folder.
    ``schema`` names all columns, the period included as an int.
    """
    return latest_period(spark.read.schema(schema).parquet(path), period, as_of, halves)
