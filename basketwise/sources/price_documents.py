"""Price documents: a head and a map of products to store prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.fixed import DOCUMENT_DEFAULTS
from basketwise.functions.numbers import number
from basketwise.model import PRICE_DOCUMENT

HEADER = ["generatedAt", "source", "sourceLabel", "currency", "region", "postalCode"]


def read_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per document; prices stay text so that one bad value spoils nothing else.

    Documents are files of their own, or lines of larger files.
    """
    return spark.read.schema(PRICE_DOCUMENT).option("multiLine", one_per_file).json(path)


def document_header(documents: DataFrame) -> DataFrame:
    """Head of a document as written."""
    return documents.select(*HEADER)


def with_defaults(headers: DataFrame) -> DataFrame:
    """Head with the values assumed for what a document leaves out."""
    filled = [
        F.coalesce(F.nullif(c, F.lit("")), F.lit(DOCUMENT_DEFAULTS.get(c)).cast("string")).alias(c)
        for c in HEADER
    ]
    return headers.select(*filled, *[c for c in headers.columns if c not in HEADER])


def document_cells(documents: DataFrame) -> DataFrame:
    """One row per product and store, with the price as written and as a number."""
    carried = [c for c in documents.columns if c != "products"]
    per_product = documents.select(*carried, F.explode("products").alias("ean", "by_store"))
    return per_product.select(*carried, "ean", F.explode("by_store").alias("store_id", "price_text")).withColumn(
        "price", number(F.col("price_text"))
    )


def document_observations(cells: DataFrame) -> DataFrame:
    """Cells as history rows: captured when the document was made, source and currency defaulted."""
    return cells.select(
        "ean",
        "store_id",
        F.lit(None).cast("string").alias("branch_id"),
        "price",
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("MXN")).alias("currency"),
        F.col("generatedAt").try_cast("timestamp_ntz").alias("captured_at"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("captura-manual")).alias("source"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("raw"),
    )


def first_usable(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Cells of the first source, in order, that has any, tagged with its origin.

    Sources are sanitised cell tables. One row of each tells whether it is usable.
    """
    tagged = [
        cells.select("ean", "store_id", "price", F.lit(n).alias("priority"), F.lit(origin).alias("origin"))
        for n, (origin, cells) in enumerate(sources)
    ]
    usable = reduce(DataFrame.unionByName, [cells.select("priority").limit(1) for cells in tagged])
    chosen = usable.agg(F.min("priority")).scalar()
    return reduce(DataFrame.unionByName, tagged).where(F.col("priority") == chosen).drop("priority")


def origin_of(cells: DataFrame) -> DataFrame:
    """Origin of a chosen table and its size; ``none`` when no source was usable."""
    return cells.agg(
        F.coalesce(F.min("origin"), F.lit("none")).alias("origin"), F.count("*").alias("n_prices")
    )


def price_map(prices: DataFrame, price: Column | None = None) -> DataFrame:
    """Map of store to price per product, stores in order.

    A product has one price per store, so a map has no more entries than there are stores.
    """
    pairs = F.sort_array(F.collect_list(F.struct("store_id", price if price is not None else F.col("price"))))
    return prices.groupBy("ean").agg(F.map_from_entries(pairs).alias("prices"))
