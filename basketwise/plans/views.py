"""History and current prices for SQL users."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from basketwise.operators.consolidation import latest_prices

PRICE_HISTORY = """
CREATE OR REPLACE TEMPORARY FUNCTION price_history(p_ean STRING, p_days INT DEFAULT 90)
RETURNS TABLE (store_id STRING, price DOUBLE, captured_at TIMESTAMP_NTZ)
RETURN SELECT store_id, price, captured_at FROM price_observations
WHERE ean = p_ean AND captured_at >= TIMESTAMP_NTZ '{as_of}' - make_dt_interval(greatest(p_days, 1))
"""


def register_views(spark: SparkSession, history: DataFrame, as_of: datetime) -> None:
    """Views price_observations and current_prices, and the table function price_history(ean, days).

    The history function looks back from ``as_of``; its callers order the rows.
    """
    history.createOrReplaceTempView("price_observations")
    latest_prices(history).createOrReplaceTempView("current_prices")
    spark.sql(PRICE_HISTORY.format(as_of=as_of.isoformat(sep=" ")))
