"""What sources deliver besides the price, kept as text and read as a value of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def raw_field(raw: Column, path: str, kind: str = "string") -> Column:
    """The field of a JSON text at a path such as ``$.offers[0].price``; null where it is missing or cannot be cast."""
    return F.try_variant_get(F.try_parse_json(raw), path, kind)


def kind_of(value: Column) -> Column:
    """object, array, text, number, boolean or null."""
    shape = F.schema_of_variant(value)
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
    return kind.when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")


def raw_fields(rows: DataFrame, by: str = "source", raw: str = "raw") -> DataFrame:
    """(by, field, kind, n): the fields that raw texts of a source have, and how often each kind of value.

    Texts that are no object have no field; their kind is that of the value, ``invalid`` or ``missing``.
    """
    parsed = rows.select(F.col(by).alias("_by"), F.col(raw).alias("_raw"), F.try_parse_json(F.col(raw)).alias("_value"))
    kind = F.when(F.col("_raw").isNull(), "missing").when(F.col("_value").isNull(), "invalid").otherwise(kind_of(F.col("_value")))
    known = parsed.withColumn("_kind", kind)
    exploded = known.where("_kind = 'object'").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_value").outer()))
    fields = exploded.select("_by", F.col("key").alias("field"), kind_of(F.col("value")).alias("kind"))
    others = known.where("_kind <> 'object'").select("_by", F.lit(None).cast("string").alias("field"), F.col("_kind").alias("kind"))
    return fields.union(others).groupBy(F.col("_by").alias(by), "field", "kind").agg(F.count("*").alias("n"))
