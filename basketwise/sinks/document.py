"""The price document as one nested JSON value that many tasks write and read.

Every task writes a fragment: the lines of a range of products, in order. The first fragment opens
with the head, the last one closes the value, so that the files one after the other are the document.
A manifest names them with their places in the value. A version counts once its manifest is
written, so a run that dies half way leaves the previous one in place.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketwise.session import materialise

MANIFEST = "version string, fragment bigint, file string, begins bigint, length bigint"
#: What stands between the members of the head and the products, and behind these.
OPENS, CLOSES = ',"products":{', "}}"


def document_lines(header: DataFrame, products: DataFrame) -> DataFrame:
    """(section, ean, value): the lines of the document, which read in (section, ean) order.

    ``header`` is one row of members, ``products`` has ean and prices, as ``prices_snapshot`` gives
    them. JSON has no null keys, so products without a key stay out.
    """
    # Looked at twice, and sampled for its ranges when it is written.
    kept = materialise(products.where("ean IS NOT NULL").select("ean", "prices"), "document-products")
    first = kept.agg(F.min("ean")).scalar()
    whole = F.to_json(F.create_map("ean", "prices"))
    entry = F.substring(whole, F.lit(2), F.length(whole) - 2)
    comma = F.when(F.col("ean") == first, "").otherwise(",")
    head = F.to_json(F.struct("*"))
    outside = F.lit(None).cast("string").alias("ean")
    opening = header.select(
        F.lit(0).alias("section"), outside, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(OPENS)).alias("value")
    )
    closing = products.sparkSession.range(1).select(F.lit(2), outside, F.lit(CLOSES))
    return opening.union(kept.select(F.lit(1), "ean", F.concat(comma, entry))).union(closing)


def publish_document(header: DataFrame, products: DataFrame, root: str, written_at: datetime) -> str:
    """Writes a new version of the document below a folder and returns its name."""
    spark = products.sparkSession
    version = f"{written_at:%Y%m%dT%H%M%S%f}-{datetime.now():%Y%m%dT%H%M%S%f}"
    folder = f"{root}/fragments/{version}"
    lines = document_lines(header, products).repartitionByRange("section", "ean").sortWithinPartitions("section", "ean")
    lines.select("value").write.option("lineSep", "\n").option("compression", "none").text(folder)
    # Names and sizes come from the listing; no content is read.
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select(
        F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("bigint").alias("task"),
        F.regexp_extract("path", r"-c(\d+)\.[^/]*$", 1).try_cast("bigint").alias("chunk"),
        F.regexp_extract("path", "[^/]+$", 0).alias("file"),
        "length",
    )
    # One row per file, however large the files are.
    order = Window.orderBy("task", "chunk")
    manifest = files.select(
        F.lit(version).alias("version"),
        (F.row_number().over(order) - 1).cast("bigint").alias("fragment"),
        "file",
        (F.sum("length").over(order) - F.col("length")).alias("begins"),
        "length",
    )
    manifest.coalesce(1).write.mode("append").json(f"{root}/manifests")
    return version


def read_manifest(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Fragments of a version, of the newest one where none is named; empty before the first is complete."""
    try:
        manifests = spark.read.schema(MANIFEST).json(f"{root}/manifests")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    wanted = F.lit(version) if version else manifests.agg(F.max("version")).scalar()
    return manifests.where(F.col("version") == wanted)


def _lines(spark: SparkSession, root: str, version: str | None) -> DataFrame:
    named = read_manifest(spark, root, version).select("version").first()
    if named is None:
        return spark.createDataFrame([], "value string")
    return spark.read.option("lineSep", "\n").text(f"{root}/fragments/{named['version']}")


def read_document_products(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(ean, store_id, price_text) of a published document; every task reads lines of its own."""
    entries = _lines(spark, root, version).where(F.ltrim("value", F.lit(",")).startswith('"'))
    value = F.concat(F.lit("{"), F.ltrim("value", F.lit(",")), F.lit("}"))
    by_product = entries.select(F.explode(F.from_json(value, "map<string, map<string, string>>")).alias("ean", "by_store"))
    return by_product.select("ean", F.explode("by_store").alias("store_id", "price_text"))


def read_document_head(spark: SparkSession, root: str, schema: str, version: str | None = None) -> DataFrame:
    """The members of the head of a published document, as one row of the given schema."""
    opening = _lines(spark, root, version).where(F.col("value").startswith("{"))
    return opening.select(F.from_json(F.concat("value", F.lit(CLOSES)), schema).alias("head")).select("head.*")
