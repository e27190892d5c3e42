"""One price per product and store out of many observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.functions.numbers import round2

# Settles equal capture times; callers with an arrival order pass their own.
TIES = ("branch_id", "price", "source")


def _capture_order(ties: tuple[str | Column, ...]) -> Column:
    """Order in which observations count as later; a missing date counts as the epoch.

    Taking the max over it combines on the map side, so one hot product leaves each
    task as a single row.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.struct(F.coalesce(F.col("captured_at"), epoch).alias("at"), *ties)


def price_cells(observations: DataFrame, ties: tuple[str | Column, ...] = TIES) -> DataFrame:
    """Count and latest row of every distinct price of a product in a store.

    Validated prices have two decimals and an upper limit, so however many rows a hot
    product has, its cells are bounded by the prices that exist.
    """
    payload = [c for c in observations.columns if c not in ("ean", "store_id")]
    return (
        observations.withColumn("_payload", F.struct(*payload))
        .withColumn("_order", _capture_order(ties))
        .groupBy("ean", "store_id", "price")
        .agg(
            F.count("*").alias("n"),
            F.max("_order").alias("_order"),
            F.max_by("_payload", "_order").alias("_payload"),
        )
    )


def price_counts(observations: DataFrame) -> DataFrame:
    """Observations counted per product, store and price."""
    return observations.groupBy("ean", "store_id", "price").agg(F.count("*").alias("n"))


def _placed(counts: DataFrame) -> DataFrame:
    """Adds up to how many observations a price goes in its product and store, and how many there are; nulls do not count.

    The prices are sorted, which spills; a percentile would hold and move them as one value per product and store.
    """
    prices = Window.partitionBy("ean", "store_id").orderBy("price")
    known = F.sum(F.when(F.col("price").isNotNull(), F.col("n")).otherwise(F.lit(0)))
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    return counts.withColumns(
        {"_upto": known.over(prices.rowsBetween(start, Window.currentRow)), "_of": known.over(prices.rowsBetween(start, end))}
    )


def _spread() -> list[Column]:
    lower, upper = (F.min(F.when(half, F.col("price"))) for half in (F.expr("2 * _upto >= _of"), F.expr("2 * _upto > _of")))
    return [
        round2(lower * 0.5 + upper * 0.5).alias("median"),
        F.sum("n").alias("n_obs"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
    ]


def median_prices(observations: DataFrame) -> DataFrame:
    """Exact median, count and spread per product and store."""
    return medians_of_counts(price_counts(observations))


def medians_of_counts(counts: DataFrame) -> DataFrame:
    """Median prices out of counted prices."""
    return _placed(counts).groupBy("ean", "store_id").agg(*_spread()).withColumnRenamed("median", "price")


def _merged(observations: DataFrame, ties: tuple[str | Column, ...]) -> DataFrame:
    """Spread of the prices and the row captured last, per product and store."""
    return (
        _placed(price_cells(observations, ties))
        .groupBy("ean", "store_id")
        .agg(*_spread(), F.max_by("_payload", "_order").alias("rep"))
    )


def consolidate(observations: DataFrame, ties: tuple[str | Column, ...] = TIES) -> DataFrame:
    """Median price carried by the row captured last."""
    merged = _merged(observations, ties)
    kept = [f"rep.{c}" for c in observations.columns if c not in ("ean", "store_id", "price")]
    return merged.select(
        "ean", "store_id", F.col("median").alias("price"), *kept, "n_obs", "price_min", "price_max"
    )


def with_spread(consolidated: DataFrame) -> DataFrame:
    """Products whose branches disagree on the price."""
    return consolidated.where(F.col("price_max") > F.col("price_min"))


def latest_prices(observations: DataFrame, ties: tuple[str | Column, ...] = TIES) -> DataFrame:
    """The row captured last per product and store."""
    payload = [c for c in observations.columns if c not in ("ean", "store_id")]
    return (
        observations.groupBy("ean", "store_id")
        .agg(F.max_by(F.struct(*payload), _capture_order(ties)).alias("row"))
        .select("ean", "store_id", "row.*")
    )


def median_against_latest(observations: DataFrame) -> DataFrame:
    """Both notions of the current price side by side."""
    return _merged(observations, TIES).select(
        "ean",
        "store_id",
        F.col("median").alias("median_price"),
        F.col("rep.price").alias("latest_price"),
        round2(F.col("rep.price") - F.col("median")).alias("difference"),
    )


def price_history(
    observations: DataFrame, as_of: Column, days: int = 90, products: DataFrame | None = None
) -> DataFrame:
    """Observations of the last days, at least one day; in no order, as they may be many.

    ``products`` (column ean) restricts the history to a list of products.
    """
    since = as_of - F.make_dt_interval(F.lit(max(days, 1)))
    recent = observations.where(F.col("captured_at") >= since)
    if products is not None:
        recent = recent.join(products.select("ean").distinct(), "ean", "left_semi")
    return recent.select("ean", "store_id", "price", "captured_at")


def product_history(observations: DataFrame, ean: str, as_of: Column, days: int = 90) -> DataFrame:
    """History of one product, oldest first."""
    return price_history(observations.where(F.col("ean") == ean), as_of, days).drop("ean").orderBy("captured_at")
