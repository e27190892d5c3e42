"""Coverage, freshness and contract reports over a price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.fixed import STALE_DAYS, SURVEY_OLD_DAYS
from basketwise.functions.dates import age_days, age_seconds, freshness_label, is_stale
from basketwise.functions.numbers import percent


def unpriced_products(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Catalog products without a price in any store."""
    return products.join(prices.select("ean"), "ean", "left_anti")


def coverage_by_store(stores: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced products per store; stores without any price show zero."""
    counted = prices.groupBy("store_id").agg(F.count("*").alias("n_prices"))
    return stores.join(counted, "store_id", "left").withColumn("n_prices", F.coalesce("n_prices", F.lit(0)))


def catalog_coverage(products: DataFrame, prices: DataFrame) -> DataFrame:
    """How much of the catalog has a price, in one row."""
    total = products.agg(F.count("*").alias("n_products"))
    # One row per product first, so the distinct count does not expand the data.
    per_product = prices.groupBy("ean").agg(F.count("*").alias("n"))
    priced = per_product.agg(F.count("*").alias("n_priced"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_prices"))
    return (
        priced.withColumn("n_products", total.scalar())
        .withColumn("pct_priced", percent(F.col("n_priced"), F.col("n_products")))
        .select("n_products", "n_priced", "pct_priced", "n_prices")
    )


def freshness(observations: DataFrame, by: list[str], as_of: Column) -> DataFrame:
    """Newest capture per group, its age and how it reads."""
    newest = observations.groupBy(*by).agg(F.max("captured_at").alias("newest"))
    moment = F.col("newest")
    return newest.select(
        *by,
        "newest",
        age_days(moment, as_of).alias("age_days"),
        freshness_label(moment, as_of).alias("label"),
        is_stale(moment, as_of).alias("is_stale"),
        (age_days(moment, as_of) > SURVEY_OLD_DAYS).alias("is_old"),
    )


def contract_metrics(
    header: DataFrame, products: DataFrame, stores: DataFrame, classified: DataFrame, as_of: Column
) -> DataFrame:
    """Everything the contract rules look at, in one row.

    ``header`` is the one-row head of a price document, ``classified`` its cells with
    the issue of each.
    """
    usable = classified.where(F.col("issue").isNull())
    issues = classified.where(F.col("issue").isNotNull())
    # An unknown product is reported once, a bad cell by itself.
    reported = issues.select(
        "ean", F.when(F.col("issue") != "unknown_ean", F.col("store_id")).alias("store_id")
    ).distinct()
    empty_stores = stores.join(usable.select("store_id"), "store_id", "left_anti")
    generated = F.col("generatedAt").try_cast("timestamp_ntz")
    age = age_seconds(generated, as_of) / 86400
    return header.select(
        (F.coalesce("generatedAt", F.lit("")) == "").alias("no_date"),
        (generated.isNull() & (F.coalesce("generatedAt", F.lit("")) != "")).alias("bad_date"),
        age.alias("age"),
        (F.coalesce("currency", F.lit("")) == "").alias("no_currency"),
        (F.coalesce("sourceLabel", F.lit("")) == "").alias("no_label"),
        reported.agg(F.count("*")).scalar().alias("n_issues"),
        usable.agg(F.count("*")).scalar().alias("n_usable"),
        empty_stores.agg(F.count("*")).scalar().alias("n_empty_stores"),
        unpriced_products(products, usable).agg(F.count("*")).scalar().alias("n_unpriced"),
    )


def contract_report(metrics: DataFrame) -> DataFrame:
    """Rules that fired, with their level, and the verdict of the whole document."""
    one = F.lit(1).cast("bigint")
    rules: list[tuple[str, str, Column, Column]] = [
        ("error", "missing_date", F.col("no_date"), one),
        ("error", "invalid_date", F.col("bad_date"), one),
        ("warning", "stale", F.col("age") > STALE_DAYS, F.floor("age").cast("bigint")),
        ("error", "future_date", F.col("age") < -1, one),
        ("warning", "missing_currency", F.col("no_currency"), one),
        ("warning", "missing_label", F.col("no_label"), one),
        ("error", "invalid_cells", F.col("n_issues") > 0, F.col("n_issues")),
        ("error", "no_usable_price", F.col("n_usable") == 0, one),
        ("warning", "empty_stores", F.col("n_empty_stores") > 0, F.col("n_empty_stores")),
        ("warning", "unpriced_products", F.col("n_unpriced") > 0, F.col("n_unpriced")),
    ]
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    rule,
                    F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.alias("n")),
                )
                for level, code, rule, n in rules
            ]
        )
    )
    failed = F.exists("fired", lambda r: r["level"] == "error")
    verdict = F.struct(
        F.when(failed, F.lit("rejected")).otherwise(F.lit("accepted")).alias("level"),
        F.lit("verdict").alias("code"),
        F.size("fired").cast("bigint").alias("n"),
    )
    return metrics.withColumn("fired", fired).select(
        F.inline(F.array_append("fired", verdict)),
    )
