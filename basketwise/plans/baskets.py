"""From written lists to priced baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.fixed import CUSTOM_CATEGORY
from basketwise.functions.text import strip
from basketwise.functions.units import (
    custom_quantity,
    custom_unit,
    filler_prices,
    pack_quantity,
    split_list,
    with_custom_name,
    with_quantity,
)
from basketwise.operators.baskets import merge_lines
from basketwise.operators.matching import match_aliases
from basketwise.session import materialise


def list_lines(lists: DataFrame, text: str = "text") -> DataFrame:
    """Written lines of every list, blank ones left out. ``lists`` has basket_id and the text."""
    lines = lists.select("basket_id", F.posexplode(split_list(F.col(text))).alias("line", "written"))
    return lines.withColumn("written", strip(F.col("written"))).where(F.col("written") != "")


def read_lines(lines: DataFrame) -> DataFrame:
    """Adds amount, dimension and search term of every written line."""
    return with_quantity(lines, "written")


def parse_lines(lines: DataFrame, catalog: DataFrame, searchable: DataFrame) -> DataFrame:
    """Basket item of every written line, from the catalog or custom.

    ``catalog`` has ean, slug, name, category, unit and pack; ``searchable`` is the
    same catalog as the alias match reads it. Lines are read once and written to the
    shared folder; their distinct terms are matched, then joined back to them.
    """
    read = materialise(read_lines(lines), "read-lines")
    matches = match_aliases(read.select("term"), searchable)
    products = matches.join(searchable.select("catalog_pos", "ean"), "catalog_pos").join(
        catalog.select("ean", "slug", "name", "category", "unit", "pack"), "ean"
    )
    found = materialise(
        products.select("term", F.struct("ean", "slug", "name", "category", "unit", "pack").alias("p")),
        "found-products",
    )
    custom = F.col("p").isNull()
    joined = with_custom_name(read.join(found, "term", "left"), "written", custom)
    packs, note = pack_quantity(
        F.col("amount"), F.col("dimension"), F.col("p.pack.amount"), F.col("p.pack.unit")
    )

    def either(from_catalog: str | Column, own: Column) -> Column:
        return F.when(custom, own).otherwise(F.col(from_catalog) if isinstance(from_catalog, str) else from_catalog)

    return joined.select(
        "basket_id",
        "line",
        F.col("p.slug").alias("catalog_id"),
        F.col("p.ean").alias("ean"),
        either("p.name", F.col("custom_name")).alias("name"),
        either("p.category", F.lit(CUSTOM_CATEGORY)).alias("category"),
        either("p.unit", custom_unit(F.col("dimension"))).alias("unit"),
        either(packs, custom_quantity(F.col("amount"), F.col("dimension"))).alias("quantity"),
        F.col("written").alias("raw_input"),
        F.when(~custom, note).alias("measure_note"),
        F.when(custom, filler_prices()).alias("estimated_prices"),
        custom.alias("is_custom"),
    )


def parse_lists(lists: DataFrame, catalog: DataFrame, searchable: DataFrame, text: str = "text") -> DataFrame:
    """Baskets of written lists: one line per product, quantities of repeats added up."""
    parsed = parse_lines(list_lines(lists, text), catalog, searchable)
    keep = ["ean", "name", "category", "unit", "raw_input", "measure_note", "estimated_prices", "is_custom"]
    return merge_lines(parsed, keep, ["line"])
