"""Dimension tables: chains, branches, categories and products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.functions.text import branch_id, parser_normalise
from basketwise.model import BRANCH, CATEGORY, PRODUCT, STORE, Store


@dataclass(frozen=True)
class Dimensions:
    stores: DataFrame
    branches: DataFrame
    categories: DataFrame
    products: DataFrame


def load_dimensions(spark: SparkSession, root: str) -> Dimensions:
    """Dimension tables under one folder."""
    schemas = {"stores": STORE, "branches": BRANCH, "categories": CATEGORY, "products": PRODUCT}
    return Dimensions(**{name: spark.read.schema(s).parquet(f"{root}/{name}") for name, s in schemas.items()})


def store_list(stores: DataFrame, order: str) -> list[Store]:
    """Chains in the order that settles ties; ``stores`` has store_id and name.

    They become columns of the queries, so the table is one of chains, not of branches.
    """
    rows = stores.select("store_id", "name").orderBy(order).collect()
    return [Store(r["store_id"], r["name"]) for r in rows]


def branches_of(stores: DataFrame) -> DataFrame:
    """Branch rows out of chains that carry them nested."""
    nested = stores.select(F.col("id").alias("store_id"), F.posexplode("branches").alias("position", "b"))
    return nested.select(
        branch_id(F.col("store_id"), F.col("b.name")).alias("id"),
        "store_id",
        F.col("b.name").alias("name"),
        F.col("b.zone").alias("zone"),
        "position",
    )


def searchable(products: DataFrame, order: str) -> DataFrame:
    """Catalog as the alias match reads it: normalised name and aliases, with a position."""
    return products.select(
        "ean",
        F.col(order).cast("bigint").alias("catalog_pos"),
        parser_normalise(F.col("name")).alias("name"),
        F.transform("aliases", lambda a: parser_normalise(a)).alias("aliases"),
    )


def search_catalog(products: DataFrame, category: str | None = None, query: str | None = None) -> DataFrame:
    """Products of a category whose name or aliases contain a text.

    Case is ignored, accents are not. No category, or ``all``, means every one.
    """
    found = products
    if category and category != "all":
        found = found.where(F.col("category") == category)
    if query:
        wanted = F.lit(query.lower())
        in_name = F.contains(F.lower("name"), wanted)
        found = found.where(in_name | F.contains(F.lower(F.array_join("aliases", " ")), wanted))
    return found

