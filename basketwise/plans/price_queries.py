"""Queries over observed prices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.operators.consolidation import (
    consolidate,
    latest_prices,
    median_against_latest,
    median_prices,
    price_history,
    with_spread,
)
from basketwise.operators.coverage import (
    catalog_coverage,
    contract_metrics,
    contract_report,
    coverage_by_store,
    freshness,
    unpriced_products,
)
from basketwise.operators.validation import (
    classify_cells,
    known_rows,
    orphan_rows,
    reject_report,
    reject_samples,
    sanitise_issues,
    sanitised,
    with_problems,
)
from basketwise.plans.bindings import (
    AS_OF,
    EVENT_OBS,
    LATEST,
    MEDIANS,
    OBS,
    RAW,
    as_of,
    branches,
    chains,
    event_observations,
    observations,
    products,
    raw_observations,
    table,
)
from basketwise.plans.catalogue import query
from basketwise.plans.views import register_views


@query("median_price", f"WITH {OBS}, {MEDIANS} SELECT ean, store_id, price, n_obs, price_min, price_max FROM medians")
def median_price(spark: SparkSession, folder: str) -> DataFrame:
    return median_prices(observations(spark, folder)).select(
        "ean", "store_id", "price", "n_obs", "price_min", "price_max"
    )


@query(
    "price_spread",
    f"WITH {OBS}, {MEDIANS} SELECT ean, store_id, price, n_obs, price_min, price_max FROM medians WHERE price_max > price_min",
)
def price_spread(spark: SparkSession, folder: str) -> DataFrame:
    return with_spread(median_price(spark, folder))


@query(
    "representative_observation",
    f"""WITH {OBS}, {MEDIANS}, {LATEST}
    SELECT ean, store_id, medians.price, branch_id, captured_at, source, n_obs, price_min, price_max
    FROM medians JOIN latest USING (ean, store_id)""",
)
def representative_observation(spark: SparkSession, folder: str) -> DataFrame:
    return consolidate(observations(spark, folder))


@query("latest_price", f"WITH {OBS}, {LATEST} SELECT ean, store_id, branch_id, price, captured_at, source FROM latest")
def latest_price(spark: SparkSession, folder: str) -> DataFrame:
    return latest_prices(observations(spark, folder))


@query(
    "median_vs_latest",
    f"""WITH {OBS}, {MEDIANS}, {LATEST}
    SELECT ean, store_id, medians.price AS median_price, latest.price AS latest_price,
           floor((latest.price - medians.price) * 100 + 0.5) / 100 AS difference
    FROM medians JOIN latest USING (ean, store_id)""",
)
def median_vs_latest(spark: SparkSession, folder: str) -> DataFrame:
    return median_against_latest(observations(spark, folder))


@query(
    "price_history_90d",
    f"""WITH {OBS}
    SELECT ean, store_id, price, captured_at FROM obs
    WHERE captured_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY""",
)
def price_history_90d(spark: SparkSession, folder: str) -> DataFrame:
    newest = table(spark, folder, "lineitem").agg(F.max("l_shipdate")).scalar()
    return price_history(observations(spark, folder), newest, 90)


FRESHNESS_SQL = f"""WITH {OBS}, {{events}}
    n AS (SELECT ean, max(captured_at) AS newest FROM obs GROUP BY ean),
    a AS (SELECT *, date_diff('second', newest, TIMESTAMP '{AS_OF}') AS s FROM n),
    d AS (SELECT *, CAST(floor(s / 86400) AS BIGINT) AS age_days FROM a)
    SELECT ean, newest, age_days,
      CASE WHEN age_days <= 0 THEN 'hoy' WHEN age_days = 1 THEN 'ayer'
           WHEN age_days < 30 THEN 'hace ' || age_days || ' días'
           WHEN age_days // 30 = 1 THEN 'hace 1 mes'
           ELSE 'hace ' || (age_days // 30) || ' meses' END AS label,
      s > 14 * 86400 AS is_stale, age_days > 45 AS is_old
    FROM d"""


@query("data_freshness", FRESHNESS_SQL.replace("{events}", ""))
def data_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return freshness(observations(spark, folder), ["ean"], as_of())


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return with_problems(raw_observations(spark, folder), products(spark, folder), chains(spark, folder))


@query(
    "observation_problems",
    f"""WITH {RAW}
    SELECT ean, store_id, branch_id, price, captured_at, source, array_to_string(problems, ';') AS problems,
           len(problems) = 0 AS is_valid
    FROM problems""",
)
def observation_problems(spark: SparkSession, folder: str) -> DataFrame:
    checked = _checked(spark, folder)
    return checked.select(
        "ean",
        "store_id",
        "branch_id",
        "price",
        "captured_at",
        "source",
        F.array_join("problems", ";").alias("problems"),
        (F.size("problems") == 0).alias("is_valid"),
    )


@query(
    "reject_report",
    f"""WITH {RAW}
    SELECT source, problem, count(*) AS n
    FROM (SELECT source, unnest(problems) AS problem FROM problems) GROUP BY ALL""",
)
def rejects_by_problem(spark: SparkSession, folder: str) -> DataFrame:
    return reject_report(_checked(spark, folder))


@query(
    "reject_samples",
    f"""WITH {RAW}
    SELECT source, ean, store_id, captured_at, branch_id, price, array_to_string(problems, ';') AS problems
    FROM problems WHERE len(problems) > 0
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY ean, store_id, captured_at, branch_id, price NULLS FIRST) <= 5""",
)
def first_rejects(spark: SparkSession, folder: str) -> DataFrame:
    order = ["ean", "store_id", "captured_at", "branch_id", "price"]
    samples = reject_samples(_checked(spark, folder), order)
    return samples.select("source", *order, F.array_join("problems", ";").alias("problems"))


# A document has one price per product and store: the highest one written.
CELLS = """
cells AS (
  SELECT CASE WHEN captured_at = 'soon' THEN 'X' || ean ELSE ean END AS ean, store_id, max(price) AS price
  FROM raw GROUP BY ALL
),
classified AS (
  SELECT *, CASE WHEN ean NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) THEN 'unknown_ean'
                 WHEN store_id NOT IN (SELECT lower(r_name) FROM region) THEN 'unknown_store'
                 WHEN price IS NULL OR price <= 0 THEN 'invalid_price' END AS issue
  FROM cells
)"""


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_observations(spark, folder)
    ean = F.when(F.col("captured_at") == "soon", F.concat(F.lit("X"), "ean")).otherwise(F.col("ean"))
    cells = raw.groupBy(ean.alias("ean"), "store_id").agg(F.max("price").alias("price"))
    return classify_cells(
        cells.withColumn("price_text", F.col("price").cast("string")), products(spark, folder), chains(spark, folder)
    )


@query(
    "sanitised_prices",
    f"WITH {RAW}, {CELLS} SELECT ean, store_id, floor(price * 100 + 0.5) / 100 AS price FROM classified WHERE issue IS NULL",
)
def sanitised_prices(spark: SparkSession, folder: str) -> DataFrame:
    return sanitised(_classified(spark, folder)).select("ean", "store_id", "price")


@query(
    "sanitise_issues",
    f"""WITH {RAW}, {CELLS}
    SELECT DISTINCT issue, ean, CASE WHEN issue <> 'unknown_ean' THEN store_id END AS store_id
    FROM classified WHERE issue IS NOT NULL""",
)
def issues_of_document(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise_issues(_classified(spark, folder)).select("issue", "ean", "store_id")


@query(
    "valid_members",
    f"""WITH {RAW}
    SELECT ean, store_id, branch_id, captured_at FROM raw
    WHERE ean IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) AND store_id IN (SELECT lower(r_name) FROM region)""",
)
def valid_members(spark: SparkSession, folder: str) -> DataFrame:
    return known_rows(raw_observations(spark, folder), products(spark, folder), chains(spark, folder)).select(
        "ean", "store_id", "branch_id", "captured_at"
    )


@query(
    "orphan_observations",
    f"""WITH {RAW}
    SELECT ean, store_id, branch_id, captured_at FROM raw
    WHERE ean NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)""",
)
def orphan_observations(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_rows(raw_observations(spark, folder), products(spark, folder), "ean").select(
        "ean", "store_id", "branch_id", "captured_at"
    )


@query(
    "coverage_by_store",
    f"""WITH {OBS}, nations AS (
      SELECT n_name, CAST(l_partkey AS VARCHAR) AS ean FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT nation.n_name AS store_id, count(ean) AS n_prices
    FROM nation LEFT JOIN nations USING (n_name) GROUP BY ALL""",
)
def coverage_per_nation(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("store_id"))
    items = table(spark, folder, "lineitem").join(
        branches(spark, folder).withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey"
    )
    priced = items.select(F.col("l_partkey").alias("ean"), F.col("n_name").alias("store_id")).distinct()
    return coverage_by_store(nations, priced)


EVENT_CELLS = f"{EVENT_OBS}, {LATEST}"


@query(
    "catalog_coverage",
    f"""WITH {EVENT_CELLS}, known AS (SELECT * FROM latest WHERE ean IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)),
    c AS (SELECT (SELECT count(*) FROM part) AS n_products, count(DISTINCT ean) AS n_priced, count(*) AS n_prices FROM known)
    SELECT n_products, n_priced, CAST(floor(n_priced / n_products * 100 + 0.5) AS BIGINT) AS pct_priced, n_prices FROM c""",
)
def coverage_of_catalog(spark: SparkSession, folder: str) -> DataFrame:
    catalog = products(spark, folder)
    known = latest_prices(event_observations(spark, folder)).join(catalog.select("ean"), "ean", "left_semi")
    return catalog_coverage(catalog, known)


@query(
    "unpriced_products",
    """SELECT CAST(p_partkey AS VARCHAR) AS ean, p_name AS name FROM part
    WHERE p_partkey NOT IN (SELECT user_id FROM events)""",
)
def products_without_price(spark: SparkSession, folder: str) -> DataFrame:
    return unpriced_products(products(spark, folder), event_observations(spark, folder)).select("ean", "name")


@query(
    "contract_report",
    f"""WITH {RAW}, {CELLS},
    m AS (
      SELECT (SELECT max(l_shipdate) FROM lineitem) AS generated,
        (SELECT count(*) FROM (SELECT DISTINCT ean, CASE WHEN issue <> 'unknown_ean' THEN store_id END AS s
                               FROM classified WHERE issue IS NOT NULL)) AS n_issues,
        (SELECT count(*) FROM classified WHERE issue IS NULL) AS n_usable,
        (SELECT count(*) FROM region WHERE lower(r_name) NOT IN (SELECT store_id FROM classified WHERE issue IS NULL)) AS n_empty,
        (SELECT count(*) FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT ean FROM classified WHERE issue IS NULL)) AS n_unpriced),
    r AS (SELECT date_diff('second', generated, TIMESTAMP '{AS_OF}') / 86400 AS age, * FROM m),
    fired AS (
      SELECT 'warning' AS level, 'stale' AS code, CAST(floor(age) AS BIGINT) AS n FROM r WHERE age > 14
      UNION ALL SELECT 'warning', 'missing_label', 1 FROM r
      UNION ALL SELECT 'error', 'invalid_cells', n_issues FROM r WHERE n_issues > 0
      UNION ALL SELECT 'error', 'no_usable_price', 1 FROM r WHERE n_usable = 0
      UNION ALL SELECT 'warning', 'empty_stores', n_empty FROM r WHERE n_empty > 0
      UNION ALL SELECT 'warning', 'unpriced_products', n_unpriced FROM r WHERE n_unpriced > 0)
    SELECT * FROM fired UNION ALL
    SELECT CASE WHEN bool_or(level = 'error') THEN 'rejected' ELSE 'accepted' END, 'verdict', count(*) FROM fired""",
)
def contract(spark: SparkSession, folder: str) -> DataFrame:
    header = table(spark, folder, "lineitem").agg(
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("generatedAt"),
        F.lit("MXN").alias("currency"),
        F.lit(None).cast("string").alias("sourceLabel"),
    )
    metrics = contract_metrics(
        header, products(spark, folder), chains(spark, folder), _classified(spark, folder), as_of()
    )
    return contract_report(metrics)


@query(
    "current_prices_sql",
    f"""WITH {OBS}, {LATEST} SELECT store_id, count(*) AS n_products, sum(floor(price * 100 + 0.5)) / 100 AS total,
      max(captured_at) AS newest FROM latest GROUP BY store_id""",
)
def current_prices_sql(spark: SparkSession, folder: str) -> DataFrame:
    register_views(spark, observations(spark, folder), datetime.fromisoformat(AS_OF))
    return spark.sql(
        """SELECT store_id, count(*) AS n_products, sum(CAST(floor(price * 100 + 0.5D) AS DOUBLE)) / 100 AS total,
             max(captured_at) AS newest
           FROM current_prices GROUP BY store_id"""
    )
