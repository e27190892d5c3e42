"""Basket lines: merging, shared links and rebuilding from the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.fixed import CUSTOM_CATEGORY, MAX_NAME, MAX_SHARED_ITEMS, MAX_SHARED_QUANTITY, MAX_UNIT
from basketwise.functions.links import decode_payload, encode_payload, payload_item, payload_quantity


def merge_lines(lines: DataFrame, keep: list[str], order: list[str | Column]) -> DataFrame:
    """One line per basket and catalog product: quantities summed, first line's columns kept.

    Lines without a catalog id stay apart; ``line`` identifies them within the basket.
    """
    custom = F.col("catalog_id").isNull()
    first = F.min_by(F.struct("line", *keep), F.struct(*order))
    return (
        lines.withColumn("_custom_line", F.when(custom, F.col("line")))
        .groupBy("basket_id", "catalog_id", "_custom_line")
        .agg(F.sum("quantity").alias("quantity"), first.alias("_first"))
        .select("basket_id", "catalog_id", "quantity", "_first.*")
    )


def numbered_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Adds the position of every line in its basket, whatever the number of lines."""
    return lines.withColumn("position", F.row_number().over(Window.partitionBy("basket_id").orderBy(*order)))


def first_items(lines: DataFrame, order: list[str], limit: int = MAX_SHARED_ITEMS) -> DataFrame:
    """The first items of every basket, as many as a shared link holds.

    The rank limit is applied before the shuffle, so an oversized basket leaves each
    task with no more rows than the link can hold.
    """
    return numbered_lines(lines, order).where(F.col("position") <= limit)


def share(lines: DataFrame, order: list[str]) -> DataFrame:
    """One link payload per basket."""
    item = payload_item(
        F.col("catalog_id"), F.col("ean"), F.col("name"), F.col("unit"), F.col("quantity"), F.col("is_custom")
    )
    kept = first_items(lines, order).select("basket_id", "position", item.alias("item"))
    ordered = F.sort_array(F.collect_list(F.struct("position", "item")))
    return kept.groupBy("basket_id").agg(
        encode_payload(F.transform(ordered, lambda i: i["item"])).alias("payload")
    )


def admitted_lines(shared: DataFrame) -> DataFrame:
    """Lines of a shared payload that can be trusted so far.

    A payload that is not a list of 1 to 60 items is refused as a whole; a line needs a
    sensible quantity.
    """
    # Exploded, as a condition on a plain column would be pushed below it and decode every payload again.
    decoded = shared.select("basket_id", F.explode(F.array(decode_payload(F.col("payload")))).alias("items"))
    within = decoded.where(F.size("items").between(1, MAX_SHARED_ITEMS))
    lines = within.select("basket_id", F.posexplode("items").alias("position", "item"))
    quantity = payload_quantity(F.col("item.q"))
    return lines.select(
        "basket_id",
        (F.col("position") + 1).alias("position"),
        F.nullif(F.col("item.c"), F.lit("")).alias("c"),
        F.nullif(F.col("item.e"), F.lit("")).alias("e"),
        F.nullif(F.col("item.n"), F.lit("")).alias("n"),
        F.nullif(F.col("item.u"), F.lit("")).alias("u"),
        quantity.alias("quantity"),
        F.coalesce("item.x", F.lit(False)).alias("x"),
    ).where((F.col("quantity") > 0) & (F.col("quantity") <= MAX_SHARED_QUANTITY))


def rehydrate(admitted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines of a shared basket with everything but quantity taken from the catalog.

    The catalog is looked up by id, or by key where the line carries no id. What is in
    neither survives only as a custom line with a shortened name, never with prices.
    ``catalog`` has slug, ean, name, category and unit.
    """
    product = F.struct("slug", "ean", "name", "category", "unit").alias("p")
    keys = F.array(F.concat(F.lit("id:"), "slug"), F.concat(F.lit("ean:"), "ean"))
    lookup = catalog.select(F.explode(keys).alias("key"), product)
    # Lines with neither get a key of their own, so they spread instead of sharing a null.
    own = F.concat_ws(":", F.lit("line"), "basket_id", "position")
    key = F.coalesce(F.concat(F.lit("id:"), "c"), F.concat(F.lit("ean:"), "e"), own)
    joined = admitted.withColumn("key", key).join(lookup, "key", "left")
    found = F.col("p").isNotNull()
    return joined.where(found | (F.col("x") & F.col("n").isNotNull())).select(
        "basket_id",
        "position",
        F.col("p.slug").alias("catalog_id"),
        F.col("p.ean").alias("ean"),
        F.coalesce("p.name", F.substring("n", 1, MAX_NAME)).alias("name"),
        F.coalesce("p.category", F.lit(CUSTOM_CATEGORY)).alias("category"),
        F.coalesce("p.unit", F.substring(F.coalesce("u", F.lit("pz")), 1, MAX_UNIT)).alias("unit"),
        "quantity",
        (~found).alias("is_custom"),
    )


def read_shared(shared: DataFrame, catalog: DataFrame) -> DataFrame:
    """Baskets of shared links; a basket with no trustworthy line has no rows."""
    return rehydrate(admitted_lines(shared), catalog)


def rehydrate_saved(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Saved lines hung on the current catalog by id; the rest become custom lines.

    A custom line keeps its own estimated prices, whatever name they were saved under.
    """
    current = catalog.select(
        F.concat(F.lit("id:"), "slug").alias("key"), F.struct("ean", "name", "category", "unit").alias("p")
    )
    found = F.col("p").isNotNull()
    saved_prices = F.coalesce("estimated_prices", "prices", F.create_map().cast("map<string,double>"))
    own = F.concat_ws(":", F.lit("line"), "basket_id", "line")
    key = F.coalesce(F.concat(F.lit("id:"), "catalog_id"), own)
    joined = lines.withColumn("key", key).join(current, "key", "left")
    return joined.select(
        "basket_id",
        "line",
        "catalog_id",
        F.col("p.ean").alias("ean"),
        F.coalesce("p.name", "name").alias("name"),
        F.coalesce("p.category", "category").alias("category"),
        F.coalesce("p.unit", "unit").alias("unit"),
        "quantity",
        (~found).alias("is_custom"),
        F.when(~found, saved_prices).alias("estimated_prices"),
    )
