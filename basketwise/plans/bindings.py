"""The given tables seen as products, chains, observations and baskets.

Each binding comes with the SQL that describes the same rows for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.functions.numbers import round2
from basketwise.functions.text import slug
from basketwise.model import Store
from basketwise.sources.dimensions import store_list

# All captures lie before this day; reports are made as of it.
AS_OF = "2002-01-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chains(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as chains."""
    return table(spark, folder, "region").select(
        F.lower("r_name").alias("store_id"),
        F.col("r_name").alias("name"),
        F.col("r_regionkey").alias("position"),
        F.concat(F.lit("https://"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")), F.lit(".example/s?q={query}")).alias(
            "search_url_template"
        ),
    )


def chain_list(spark: SparkSession, folder: str) -> list[Store]:
    return store_list(chains(spark, folder), "position")


def branches(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as branches of the chain of their nation's region."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name"), F.col("n_regionkey").alias("position")
    )
    region = chains(spark, folder).select("position", "store_id")
    return supplier.join(nation, "s_nationkey").join(region, "position").select(
        "s_suppkey", "s_name", "n_name", "store_id"
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as the product catalog."""
    part = table(spark, folder, "part")
    pack_unit = F.get(F.array(F.lit("g"), F.lit("ml"), F.lit("pz")), (F.col("p_size") % 3).cast("int"))
    return part.select(
        F.col("p_partkey").cast("string").alias("ean"),
        F.concat_ws("-", slug(F.col("p_name")), F.col("p_partkey")).alias("slug"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.lit("pz").alias("unit"),
        F.struct(F.col("p_size").cast("double").alias("amount"), pack_unit.alias("unit")).alias("pack"),
        F.array(F.concat_ws(" ", "p_name", "p_size"), F.lower("p_brand")).alias("aliases"),
        F.col("p_partkey").alias("position"),
    )


def lines_with_chain(spark: SparkSession, folder: str, items: DataFrame | None = None) -> DataFrame:
    """Line items, all or those given, with the chain and nation of their supplier."""
    items = table(spark, folder, "lineitem") if items is None else items
    return items.join(branches(spark, folder).withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as observed prices."""
    return lines_with_chain(spark, folder).select(
        F.col("l_partkey").cast("string").alias("ean"),
        "store_id",
        F.col("l_suppkey").cast("string").alias("branch_id"),
        round2(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("captured_at"),
        F.col("l_returnflag").alias("source"),
    )


OBS = """
obs AS (
  SELECT CAST(l_partkey AS VARCHAR) AS ean, lower(r_name) AS store_id,
         CAST(l_suppkey AS VARCHAR) AS branch_id,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
         l_shipdate AS captured_at, l_returnflag AS source
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

# Median as the mean of the two middle prices, rounded like every price.
MEDIANS = """
medians AS (
  SELECT ean, store_id,
         floor((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 * 100 + 0.5) / 100 AS price,
         CAST(len(l) AS BIGINT) AS n_obs, l[1] AS price_min, l[len(l)] AS price_max
  FROM (SELECT ean, store_id, list_sort(list(price)) AS l FROM obs GROUP BY ean, store_id)
)"""

LATEST = """
latest AS (
  SELECT * FROM obs
  QUALIFY row_number() OVER (PARTITION BY ean, store_id
    ORDER BY captured_at DESC, branch_id DESC, price DESC, source DESC) = 1
)"""


def event_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as observed prices."""
    return events_as_observations(table(spark, folder, "events"))


def events_as_observations(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("ean"),
        F.col("event_type").alias("store_id"),
        F.lit("").alias("branch_id"),
        F.col("value").alias("price"),
        F.col("ts").alias("captured_at"),
        F.lit("events").alias("source"),
    )


EVENT_OBS = """
obs AS (
  SELECT CAST(user_id AS VARCHAR) AS ean, event_type AS store_id, '' AS branch_id,
         value AS price, ts AS captured_at, 'events' AS source
  FROM events
)"""


def raw_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as unchecked observations; some fields spoiled by rules over the row."""
    rows = lines_with_chain(spark, folder)
    price = round2(F.col("l_extendedprice") / F.col("l_quantity"))
    return rows.select(
        F.when(F.col("l_tax") == 0.08, F.concat(F.lit("X"), "l_partkey")).otherwise(F.col("l_partkey").cast("string")).alias("ean"),
        F.when(F.col("l_linenumber") == 7, F.lit("nowhere")).otherwise(F.col("store_id")).alias("store_id"),
        F.col("l_suppkey").cast("string").alias("branch_id"),
        F.when(F.col("l_discount") == 0.1, -price)
        .when(F.col("l_discount") == 0.09, price * 100)
        .when(F.col("l_discount") == 0.08, F.lit(None))
        .otherwise(price)
        .alias("price"),
        F.when(F.col("l_linenumber") == 5, F.lit("soon"))
        .when(F.col("l_linenumber") == 6, F.lit(""))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("captured_at"),
        F.when(F.col("l_quantity") == 50, F.lit("")).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("source"),
    )


RAW = """
raw AS (
  SELECT CASE WHEN l_tax = 0.08 THEN 'X' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS ean,
         CASE WHEN l_linenumber = 7 THEN 'nowhere' ELSE lower(r_name) END AS store_id,
         CAST(l_suppkey AS VARCHAR) AS branch_id,
         CASE WHEN l_discount = 0.1 THEN -p WHEN l_discount = 0.09 THEN p * 100
              WHEN l_discount = 0.08 THEN NULL ELSE p END AS price,
         CASE WHEN l_linenumber = 5 THEN 'soon' WHEN l_linenumber = 6 THEN ''
              ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS captured_at,
         CASE WHEN l_quantity = 50 THEN '' ELSE l_returnflag || l_linestatus END AS source
  FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p FROM lineitem)
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
problems AS (
  SELECT raw.*, list_filter([
      CASE WHEN ean NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) THEN 'unknown_ean' END,
      CASE WHEN store_id NOT IN (SELECT lower(r_name) FROM region) THEN 'unknown_store' END,
      CASE WHEN price IS NULL OR price <= 0 THEN 'invalid_price' END,
      CASE WHEN price > 100000 THEN 'price_too_high' END,
      CASE WHEN captured_at <> '' AND TRY_CAST(captured_at AS TIMESTAMP) IS NULL THEN 'invalid_date' END,
      CASE WHEN source = '' THEN 'missing_source' END], lambda x: x IS NOT NULL) AS problems
  FROM raw
)"""


def basket_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as baskets, one line per product with the quantities added up."""
    items = table(spark, folder, "lineitem")
    # Grouped by numbers, which take less of a task's memory than texts.
    ean = F.col("l_partkey").cast("string")
    return items.groupBy(F.col("l_orderkey").alias("basket_id"), "l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.min("l_linenumber").alias("first_line")
    ).select(
        "basket_id",
        # Order of first appearance as one number: line number, then product.
        (F.shiftleft(F.col("first_line").cast("bigint"), 40) + F.col("l_partkey").cast("bigint")).alias("line"),
        ean.alias("item_id"),
        ean.alias("ean"),
        "quantity",
    )


ITEMS = """
items AS (
  SELECT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS ean,
         sum(l_quantity) AS quantity, min(l_linenumber) AS first_line
  FROM lineitem GROUP BY ALL
),
stores AS (SELECT lower(r_name) AS store_id, r_regionkey AS pos FROM region),
offers AS (
  SELECT basket_id, ean, quantity, first_line, store_id, pos, price
  FROM items JOIN medians USING (ean) JOIN stores USING (store_id)
),
priced AS (
  SELECT basket_id, ean, quantity, first_line, count(*) AS n_offers,
         arg_min(store_id, (price, pos)) AS best_store, min(price) AS best_price
  FROM offers GROUP BY ALL
),
basket_size AS (
  SELECT basket_id, count(*) AS n_priced,
         floor(sum(floor(best_price * 100 + 0.5) * quantity) + 0.5) / 100 AS split_total
  FROM priced GROUP BY basket_id
),
singles AS (
  SELECT b.basket_id, s.store_id, s.pos, any_value(b.n_priced) AS n_priced,
         count(o.ean) AS coverage,
         floor(coalesce(sum(floor(o.price * 100 + 0.5) * o.quantity), 0) + 0.5) / 100 AS total
  FROM basket_size b CROSS JOIN stores s
  LEFT JOIN offers o ON o.basket_id = b.basket_id AND o.store_id = s.store_id
  GROUP BY b.basket_id, s.store_id, s.pos
),
ranked AS (
  SELECT *, n_priced - coverage AS n_missing, coverage = n_priced AS is_complete,
         row_number() OVER (PARTITION BY basket_id
           ORDER BY coverage = n_priced DESC, coverage DESC, total, pos) AS rank
  FROM singles
),
ends AS (
  SELECT basket_id, arg_min({'store_id': store_id, 'total': total}, rank) AS b,
    arg_max({'store_id': store_id, 'total': total, 'is_complete': is_complete}, (is_complete, total, -rank)) AS w
  FROM ranked GROUP BY basket_id
)"""
