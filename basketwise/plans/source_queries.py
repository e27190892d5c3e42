"""Queries that read prices from their sources."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.fixed import SUGGESTIONS_SHOWN, SURVEY_CHAINS
from basketwise.functions.dates import half_month_index, half_month_label, survey_date
from basketwise.functions.numbers import round2
from basketwise.operators.consolidation import median_prices
from basketwise.operators.validation import classify_cells, sanitised
from basketwise.plans.bindings import MEDIANS, OBS, as_of, chains, lines_with_chain, observations, products, table
from basketwise.plans.catalogue import query
from basketwise.plans.ingest import run_ingest
from basketwise.plans.matching_queries import TERMS, _term_case, term_table
from basketwise.session import discard, n_slices, shuffles_freed, sliced, work_dir
from basketwise.sinks.periods import newest_period, publish_periods
from basketwise.sinks.snapshot import merge_labels, merge_sources
from basketwise.sources.feeds import ManualSource, PageSource, SearchSource, SurveySource
from basketwise.sources.manual import manual_rows, read_manual
from basketwise.sources.price_documents import (
    document_cells,
    document_observations,
    first_usable,
    read_documents,
    with_defaults,
)
from basketwise.sources.product_pages import page_feed, page_offers
from basketwise.sources.registry import Feed, Registry, covered_stores, shown_suggestions, union_all
from basketwise.sources.search_results import first_offer, response_offers
from basketwise.sources.raw import raw_field, raw_fields
from basketwise.sources.survey import latest_period, read_survey, region_rows, survey_feed, survey_suggestions

# Names under which the chains appear in the survey, one of them not ours.
SURVEY_NAMES = {
    "africa": "Bodega  Aurrera",
    "america": "CHEDRAUI",
    "asia": "Wal-Mart",
    "europe": "Fresko ",
    "middle east": "Otra Tienda",
}
STATES = {"R": "Querétaro", "A": "QUERETARO ", "N": "Jalisco"}
# A gzipped file is read by one task, so it gets so many lines at most.
PACKED = {"compression": "gzip", "maxRecordsPerFile": 250_000}


def _choose(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def _slices_of_lines(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Line items in slices, to be written one after the other."""
    items = table(spark, folder, "lineitem")
    return sliced(items, n_slices(items.count()), "l_orderkey", "l_linenumber")


def _survey(spark: SparkSession, folder: str, items: DataFrame | None = None) -> DataFrame:
    """Line items, all or those given, as rows of the published survey."""
    part = table(spark, folder, "part").withColumnRenamed("p_partkey", "l_partkey")
    rows = lines_with_chain(spark, folder, items).join(part, "l_partkey")
    date = (
        F.when(F.col("l_linenumber") < 4, F.date_format("l_shipdate", "yyyy/MM/dd"))
        .when(F.col("l_linenumber") < 7, F.date_format("l_shipdate", "'el' yyyy-MM-dd"))
        .otherwise(F.lit("sin fecha"))
    )
    return rows.select(
        F.col("p_name").alias("producto"),
        F.concat_ws(" ", "p_type", "p_size").alias("presentacion"),
        F.col("p_brand").alias("marca"),
        F.concat(
            F.when(F.col("l_discount") == 0, F.lit("-")).otherwise(F.lit("$ ")),
            F.format_number(round2(F.col("l_extendedprice") / F.col("l_quantity")), 2),
        ).alias("precio"),
        date.alias("fecha_registro"),
        _choose(F.col("l_returnflag"), STATES).alias("estado"),
        _choose(F.col("store_id"), SURVEY_NAMES).alias("cadena_comercial"),
        F.concat(F.lit('Suc. "'), "l_suppkey", F.lit('", centro')).alias("nombre_comercial"),
        F.col("n_name").alias("municipio"),
    )


SURVEY = """
survey AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, p_name, p_brand, p_type, p_size, n_name, l_returnflag,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price,
    CASE r_name WHEN 'AFRICA' THEN 'aurrera' WHEN 'AMERICA' THEN 'chedraui' WHEN 'ASIA' THEN 'walmart' WHEN 'EUROPE' THEN 'lacomer' END AS store_id,
    'Suc. "' || l_suppkey || '", centro' AS branch_id,
    lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size) AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
here AS (SELECT * FROM survey WHERE l_returnflag IN ('R', 'A') AND store_id IS NOT NULL)"""


@query(
    "region_chain_filter",
    f"WITH {SURVEY} SELECT store_id, l_returnflag = 'R' AS accented, count(*) AS n FROM here GROUP BY ALL",
)
def region_chain_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = region_rows(_survey(spark, folder))
    return kept.groupBy("store_id", (F.col("estado") == "Querétaro").alias("accented")).agg(F.count("*").alias("n"))


@query(
    "survey_csv",
    f"""WITH {SURVEY}, m AS (SELECT *, {_term_case()} AS ean FROM here)
    SELECT ean, store_id, branch_id, floor(price * 100 + 0.5) / 100 AS price,
      CASE WHEN l_linenumber < 7 THEN date_trunc('day', l_shipdate) + INTERVAL 12 HOUR ELSE TIMESTAMP '2002-01-01 00:00:00' END AS captured_at
    FROM m WHERE ean IS NOT NULL""",
)
def survey_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "survey")
    _survey(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    observed, _ = survey_feed(read_survey(spark, path), term_table(spark), as_of(), path)
    return observed.select("ean", "store_id", "branch_id", "price", "captured_at")


def _typed(spark: SparkSession, folder: str, items: DataFrame | None = None) -> DataFrame:
    """Line items, all or those given, as someone might type them."""
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + F.lit(0.5)) / F.lit(100.0)
    # Line 7 of an order becomes a comment, some fields are left out or misspelt.
    comment = F.when(F.col("l_linenumber") == 7, F.lit(" # ")).otherwise(F.lit(""))
    return lines_with_chain(spark, folder, items).select(
        F.concat(comment, F.when(F.col("l_tax") == 0.08, F.lit("")).otherwise(F.col("l_partkey").cast("string"))).alias("EAN"),
        F.col("store_id").alias("Store_Id"),
        F.when(F.col("l_discount") == 0.1, F.lit("n/a")).otherwise(price.cast("string")).alias("PRICE"),
        F.when(F.col("l_linenumber") == 5, F.lit("ayer"))
        .when(F.col("l_linenumber") == 6, F.lit(""))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("Captured_At"),
        F.concat(F.lit("Branch "), "l_suppkey", F.lit(', "main"')).alias("branch"),
        F.lit("typed").alias("note"),
    )


def _write_typed(typed: DataFrame, path: str, **options) -> None:
    writer = typed.write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).options(**options).csv(path)


def _typed_files(spark: SparkSession, folder: str) -> str:
    """Folder of files with the line items as someone might type them."""
    path = work_dir(spark, "manual")
    _write_typed(_typed(spark, folder), path)
    return path


@query(
    "manual_csv",
    """WITH typed AS (
      SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, l_discount, l_tax, lower(r_name) AS store_id,
        floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey WHERE l_linenumber <> 7)
    SELECT CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS ean, store_id,
      'Branch ' || l_suppkey || ', "main"' AS branch,
      CASE WHEN l_discount = 0.1 THEN NULL ELSE p END AS price,
      CASE WHEN l_linenumber = 6 THEN TIMESTAMP '2002-01-01 00:00:00' WHEN l_linenumber = 5 THEN NULL
           ELSE date_trunc('day', l_shipdate) + INTERVAL 12 HOUR END AS captured_at,
      CASE WHEN l_tax = 0.08 THEN 'incomplete_row' WHEN l_discount = 0.1 THEN 'invalid_price'
           WHEN l_linenumber = 5 THEN 'invalid_date' END AS reason,
      count(*) AS n
    FROM typed GROUP BY ALL""",
)
def manual_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = manual_rows(read_manual(spark, _typed_files(spark, folder)), as_of())
    return rows.groupBy("ean", "store_id", "branch", "price", "captured_at", "reason").agg(F.count("*").alias("n"))


HALF = "(year({0}) * 24 + (month({0}) - 1) * 2 + CASE WHEN day({0}) <= 15 THEN 0 ELSE 1 END)"


@query(
    "half_month_latest",
    f"""WITH p AS (SELECT *, {HALF.format("l_shipdate")} AS period FROM lineitem),
    newest AS (SELECT max(period) AS period FROM p WHERE period <= {HALF.format("DATE '2002-01-01'")} AND period > {HALF.format("DATE '2002-01-01'")} - 24)
    SELECT l_orderkey, l_partkey, l_shipdate,
      lpad(CAST((period % 24) // 2 + 1 AS VARCHAR), 2, '0') || '-' || (period // 24) || '_0' || (period % 2 + 1) AS label
    FROM p WHERE period = (SELECT period FROM newest)""",
)
def half_month_latest(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").withColumn("period", half_month_index(F.col("l_shipdate")))
    return latest_period(items, "period", as_of()).select(
        "l_orderkey", "l_partkey", "l_shipdate", half_month_label(F.col("period")).alias("label")
    )


@query(
    "published_period",
    f"""WITH p AS (SELECT *, {HALF.format("l_shipdate")} AS period FROM lineitem),
    newest AS (SELECT max(period) AS period FROM p WHERE period <= {HALF.format("DATE '2002-01-01'")} AND period > {HALF.format("DATE '2002-01-01'")} - 24)
    SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(period AS INTEGER) AS period
    FROM p WHERE period = (SELECT period FROM newest) AND l_linenumber <= 3""",
)
def published_period(spark: SparkSession, folder: str) -> DataFrame:
    """All periods are published, the newest one of the window a second time with fewer lines; then it is read alone."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", half_month_index(F.col("l_shipdate")).alias("period")
    )
    path = work_dir(spark, "survey-periods")
    publish_periods(items, path)
    again = latest_period(items, "period", as_of()).where(F.col("l_linenumber") <= 3)
    publish_periods(again, path)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return newest_period(spark, path, fields, as_of())


@query(
    "survey_dates",
    f"""SELECT o_orderkey,
      CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2002-01-01 00:00:00' ELSE date_trunc('day', o_orderdate) + INTERVAL 12 HOUR END AS captured_at,
      CAST({HALF.format("o_orderdate")} AS INTEGER) AS period,
      lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || year(o_orderdate) || '_' || CASE WHEN day(o_orderdate) <= 15 THEN '01' ELSE '02' END AS label
    FROM orders""",
)
def survey_dates(spark: SparkSession, folder: str) -> DataFrame:
    written = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
        .otherwise(F.lit("pendiente"))
    )
    period = half_month_index(F.col("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        survey_date(written, as_of()).alias("captured_at"),
        period.alias("period"),
        half_month_label(period).alias("label"),
    )


@query(
    "first_usable_source",
    f"""WITH {OBS.replace("obs AS", "all_obs AS")}, obs AS (SELECT * FROM all_obs WHERE source = 'R'), {MEDIANS}
    SELECT ean, store_id, price, 'network' AS origin FROM medians""",
)
def first_usable_source(spark: SparkSession, folder: str) -> DataFrame:
    catalog, stores = products(spark, folder), chains(spark, folder)
    observed = observations(spark, folder)

    def cells(source: str, price: Column) -> DataFrame:
        medians = median_prices(observed.where(F.col("source") == source)).select("ean", "store_id", price.alias("price"))
        return sanitised(classify_cells(medians, catalog, stores))

    # The database has only unusable prices, so the file behind it counts; the cache is not reached.
    return first_usable(
        [("database", cells("N", -F.col("price"))), ("network", cells("R", F.col("price"))), ("cache", cells("A", F.col("price")))]
    ).select("ean", "store_id", "price", "origin")


@dataclass(frozen=True)
class SliceSource:
    """Observations with one source label."""

    id: str
    folder: str
    name: str = "slice"
    automatable: bool = True
    chains: tuple[str, ...] = ()

    def read(self, spark: SparkSession, run_at: datetime) -> Feed:
        return Feed(observations(spark, self.folder).where(F.col("source") == self.id))


@dataclass(frozen=True)
class MissingSource(SliceSource):
    """A source whose file does not exist."""

    def read(self, spark: SparkSession, run_at: datetime) -> Feed:
        return Feed(table(spark, self.folder, "no-such-table"))


@query(
    "multi_source_union",
    f"""WITH {OBS}, per_store AS (SELECT source, store_id, count(*) AS n FROM obs GROUP BY ALL)
    SELECT source, sum(n)::BIGINT AS n_obs, count(*) AS n_stores, false AS failed FROM per_store GROUP BY source
    UNION ALL SELECT 'broken', 0, 0, true FROM (SELECT count(*) FROM obs)""",
)
def multi_source_union(spark: SparkSession, folder: str) -> DataFrame:
    sources = [SliceSource("A", folder), MissingSource("broken", folder), SliceSource("N", folder), SliceSource("R", folder)]
    outcomes = Registry(sources).read(spark, datetime(2002, 1, 1))
    union = union_all(o.feed.observations for o in outcomes if o.feed is not None)
    counted = union.groupBy("source").agg(F.count("*").alias("n_obs"))
    stores = covered_stores(union).groupBy("source").agg(F.count("*").alias("n_stores"))
    failed = spark.createDataFrame(
        [(o.source.id, 0, 0, True) for o in outcomes if o.feed is None],
        "source string, n_obs bigint, n_stores bigint, failed boolean",
    )
    return counted.join(stores, "source").withColumn("failed", F.lit(False)).unionByName(failed)


def _pages_with_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages with structured data added after their head, by page number."""
    number = F.col("page_id")
    price = (number % 900 + 1).cast("string")
    kind = number % 7
    good = F.concat(F.lit('{"@type":"Product","name":"Page '), number, F.lit('","sku":"S'), number, F.lit('","offers":{"price":"'), price, F.lit('.50"}}'))
    low = F.concat(F.lit('{"@type":"Product","name":"Low","mpn":"M'), number, F.lit('","offers":{"lowPrice":'), price, F.lit(',"price":1}}'))
    nested = F.concat(F.lit('{"name":"Nested","offers":{"offers":[{"price":'), price, F.lit('.25,"availability":"OutOfStock"},{"price":2}],"lowPrice":3}}'))
    other = F.lit('{"@type":"WebSite","name":"No offer"}')
    broken = F.lit('{"@type":"Product", "offers": {"price": ')
    free = F.lit('{"@type":"Product","name":"Free","offers":{"price":0}}')

    def block(json: Column, quote: str = '"') -> Column:
        return F.concat(F.lit(f"<script type={quote}application/ld+json{quote}>"), json, F.lit("</script>"))

    blocks = (
        F.when(kind == 0, block(good))
        .when(kind == 1, F.concat(block(broken), block(low, "'")))
        .when(kind == 2, F.concat(block(other), block(nested)))
        .when(kind == 3, F.concat(block(free), block(good), block(low)))
        .when(kind == 4, block(other))
        .when(kind == 5, F.concat(F.lit("<SCRIPT type='application/ld+json'>\n"), low, F.lit("\n</SCRIPT>")))
        .otherwise(F.lit(""))
    )
    html = F.concat("html", blocks)
    return table(spark, folder, "pages").select("page_id", "url", html.alias("html"))


@query(
    "page_offers",
    """SELECT page_id, url,
      CASE page_id % 7 WHEN 0 THEN 'Page ' || page_id WHEN 2 THEN 'Nested' WHEN 3 THEN 'Page ' || page_id ELSE 'Low' END AS name,
      (page_id % 900 + 1) + CASE page_id % 7 WHEN 0 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 ELSE 0 END::DOUBLE AS price,
      CASE page_id % 7 WHEN 2 THEN 'OutOfStock' ELSE 'InStock' END AS availability,
      CASE page_id % 7 WHEN 0 THEN 'S' || page_id WHEN 3 THEN 'S' || page_id WHEN 2 THEN NULL ELSE 'M' || page_id END AS sku
    FROM pages WHERE page_id % 7 NOT IN (4, 6)""",
)
def offers_in_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = page_offers(_pages_with_blocks(spark, folder))
    return found.where(F.col("offer").isNotNull()).select("page_id", "url", "offer.*")


def _page_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as the page of a product; some entries lack the product key."""
    number = F.col("page_id")
    return table(spark, folder, "pages").select(
        F.when(number % 10 != 0, number.cast("string")).alias("ean"),
        F.concat(F.lit("Product "), number).alias("producto"),
        "url",
    )


@query(
    "page_observations",
    """WITH mapped AS (SELECT page_id AS ean_id, url FROM pages WHERE page_id % 10 <> 0)
    SELECT CAST(ean_id AS VARCHAR) AS ean, 'chedraui' AS store_id,
      (page_id % 900 + 1) + CASE page_id % 7 WHEN 0 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 ELSE 0 END::DOUBLE AS price,
      TIMESTAMP '2002-01-01 00:00:00' AS captured_at, mapped.url AS source_url
    FROM mapped JOIN pages ON pages.url = mapped.url WHERE page_id % 7 NOT IN (4, 6)""",
)
def page_observations(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages_with_blocks(spark, folder).drop("page_id")
    observed, _ = page_feed(pages, _page_mapping(spark, folder), "chedraui", as_of())
    return observed.select("ean", "store_id", "price", "captured_at", "source_url")


@query(
    "suggestions_shown",
    f"""WITH {SURVEY}, u AS (SELECT p_name || ' | ' || p_brand || ' | ' || p_type || ' ' || p_size AS clave, count(*) AS veces
        FROM here WHERE {_term_case()} IS NULL GROUP BY ALL ORDER BY veces DESC, clave LIMIT 80),
    pages_without AS (SELECT 'Product ' || m.page_id || ' (' || m.url || ')' AS clave, 1 AS veces
        FROM pages m JOIN pages p ON p.url = m.url WHERE m.page_id % 10 <> 0 AND p.page_id % 7 IN (4, 6))
    SELECT source, clave, veces FROM (SELECT 'profeco' AS source, * FROM u UNION ALL SELECT 'chedraui', * FROM pages_without)
    ORDER BY veces DESC, source, clave LIMIT 50""",
)
def suggestions_shown(spark: SparkSession, folder: str) -> DataFrame:
    survey = _survey(spark, folder).withColumn("arrival", F.monotonically_increasing_id())
    _, unmatched = survey_feed(survey, term_table(spark), as_of())
    pages = _pages_with_blocks(spark, folder).drop("page_id")
    _, without = page_feed(pages, _page_mapping(spark, folder), "chedraui", as_of())
    tagged = union_all(
        [
            survey_suggestions(unmatched).select("clave", "veces").withColumn("source", F.lit("profeco")),
            without.withColumn("source", F.lit("chedraui")),
        ]
    )
    return shown_suggestions(tagged, SUGGESTIONS_SHOWN).select("source", "clave", "veces")


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as search responses of three results, valid or not by kind of event."""
    value, number = F.col("value").cast("string"), F.col("event_id").cast("string")

    def result(*fields: Column | str) -> Column:
        return F.concat(F.lit("{"), *[f if isinstance(f, Column) else F.lit(f) for f in fields], F.lit("}"))

    full = result('"title":"Offer ', number, '","primary_offer":{"offer_price":', value, ',"offer_id":"O', number, '"},"us_item_id":"U', number, '","product_id":"P', number, '","seller_name":"Shop","product_page_url":"https://shop.example/', number, '"')
    plain = result('"name":"Plain ', number, '","price":"', value, '","us_item_id":', number, ',"link":""')
    worded = result('"title":"No price ', number, '","price":"ask us"')
    negative = result('"title":"Minus","extracted_price":-', value)
    extracted = result('"title":"Late","extracted_price":', value, ',"seller":"Other","offer_id":"X"')
    kinds = {
        "view": [full, plain],
        "click": [worded, plain, full],
        "error": [worded, negative],
        "purchase": [negative, extracted],
    }
    body = F.lit('{"search_metadata":{"status":"ok"}}')
    for kind, results in kinds.items():
        listed = F.concat(F.lit('{"organic_results":['), F.concat_ws(",", *results), F.lit("]}"))
        body = F.when(F.col("event_type") == kind, listed).otherwise(body)
    return table(spark, folder, "events").select("event_id", "event_type", body.alias("body"))


RESULTS = """
full_offer AS (SELECT event_id, event_type, floor(value * 100 + 0.5) / 100 AS price, 'Offer ' || event_id AS title, 'U' || event_id AS us_item_id,
  'P' || event_id AS product_id, 'O' || event_id AS offer_id, 'Shop' AS seller, 'https://shop.example/' || event_id AS url FROM events WHERE value > 0),
plain_offer AS (SELECT event_id, event_type, floor(value * 100 + 0.5) / 100 AS price, 'Plain ' || event_id AS title, CAST(event_id AS VARCHAR) AS us_item_id,
  CAST(event_id AS VARCHAR) AS product_id, NULL AS offer_id, NULL AS seller, 'https://www.walmart.com.mx/ip/' || event_id AS url FROM events WHERE value > 0),
late_offer AS (SELECT event_id, event_type, floor(value * 100 + 0.5) / 100 AS price, 'Late' AS title, NULL AS us_item_id, NULL AS product_id,
  'X' AS offer_id, 'Other' AS seller, NULL AS url FROM events WHERE value > 0),
results AS (
  SELECT 0 AS position, * FROM full_offer WHERE event_type = 'view'
  UNION ALL SELECT 1, * FROM plain_offer WHERE event_type IN ('view', 'click')
  UNION ALL SELECT 2, * FROM full_offer WHERE event_type = 'click'
  UNION ALL SELECT 1, * FROM late_offer WHERE event_type = 'purchase')"""


@query(
    "search_offers",
    f"WITH {RESULTS} SELECT event_id, CAST(position AS BIGINT) AS position, price, title, us_item_id, product_id, offer_id, seller, url FROM results",
)
def search_offers(spark: SparkSession, folder: str) -> DataFrame:
    offers = response_offers(_responses(spark, folder))
    return offers.select("event_id", F.col("position").cast("bigint").alias("position"), "offer.*")


@query(
    "first_search_offer",
    f"""WITH {RESULTS} SELECT e.event_id, f.price, f.title, f.us_item_id, f.url FROM events e LEFT JOIN
      (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY position) = 1) f USING (event_id)""",
)
def first_search_offer(spark: SparkSession, folder: str) -> DataFrame:
    return first_offer(_responses(spark, folder)).select(
        "event_id", "offer.price", "offer.title", "offer.us_item_id", "offer.url"
    )


@query(
    "document_rows",
    f"""WITH {OBS}, {MEDIANS}
    SELECT ean, store_id, CASE WHEN store_id = 'asia' THEN NULL ELSE price END AS price, 'MXN' AS currency,
      TIMESTAMP '2002-01-01 00:00:00' AS captured_at,
      CASE WHEN len(ean) = 1 THEN 'captura-manual' ELSE 'history' END AS source FROM medians""",
)
def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    medians = median_prices(observations(spark, folder))
    written = F.when(F.col("store_id") == "asia", F.lit("N/D")).otherwise(F.col("price").cast("string"))
    pairs = F.map_from_entries(F.collect_list(F.struct("store_id", written.alias("price"))))
    path = work_dir(spark, "documents")
    # One document per product; single-digit keys come without source.
    medians.groupBy("ean").agg(pairs.alias("by_store")).select(
        F.lit("2002-01-01T00:00:00.000").alias("generatedAt"),
        F.when(F.length("ean") > 1, F.lit("history")).alias("source"),
        F.create_map("ean", "by_store").alias("products"),
    ).write.json(path)
    cells = document_cells(read_documents(spark, path, one_per_file=False))
    return document_observations(cells).select("ean", "store_id", "price", "currency", "captured_at", "source")


@query(
    "document_defaults",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'desconocida' ELSE o_orderstatus END AS source,
      CASE o_orderstatus WHEN 'F' THEN 'Origen no declarado' ELSE o_orderpriority END AS "sourceLabel",
      CASE o_orderstatus WHEN 'O' THEN 'MXN' ELSE 'USD' END AS currency,
      CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_orderpriority END AS region
    FROM orders""",
)
def document_defaults(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    headers = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("generatedAt"),
        F.when(status != "P", status).alias("source"),
        F.when(status == "F", F.lit("")).otherwise(F.col("o_orderpriority")).alias("sourceLabel"),
        F.when(status != "O", F.lit("USD")).alias("currency"),
        F.when(status != "O", F.col("o_orderpriority")).alias("region"),
        F.lit(None).cast("string").alias("postalCode"),
    )
    return with_defaults(headers).select("o_orderkey", "source", "sourceLabel", "currency", "region")


@query(
    "source_label_merge",
    """WITH o AS (SELECT o_orderkey, o_orderstatus || '+' || o_orderpriority AS old, o_orderpriority || '+' || o_orderstatus || 'x' AS new,
        o_orderpriority AS label, o_orderstatus AS new_label FROM orders)
    SELECT o_orderkey, CASE WHEN split_part(old, '+', 1) = split_part(new, '+', 2) THEN old ELSE old || '+' || split_part(new, '+', 2) END AS sources,
      CASE WHEN contains(label, new_label) THEN label ELSE label || ' + ' || new_label END AS label
    FROM o""",
)
def source_label_merge(spark: SparkSession, folder: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        merge_sources(F.concat_ws("+", status, priority), F.concat_ws("+", priority, F.concat(status, F.lit("x")))).alias("sources"),
        merge_labels(priority, status).alias("label"),
    )


@query(
    "ingest_sources",
    f"""WITH {SURVEY}, {RESULTS},
    surveyed AS (SELECT 'survey' AS source, {_term_case()} AS ean, store_id, price FROM here),
    typed AS (SELECT 'manual' AS source, CAST(l_partkey AS VARCHAR) AS ean, lower(r_name) AS store_id, l_linenumber, l_discount, l_tax,
        floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    paged AS (SELECT 'pages' AS source, CAST(m.page_id AS VARCHAR) AS ean, 'chedraui' AS store_id, 1 AS price
      FROM pages m JOIN pages p ON p.url = m.url WHERE m.page_id % 10 <> 0 AND p.page_id % 7 NOT IN (4, 6)),
    searched AS (SELECT 'search' AS source, 'S' || event_id AS ean, 'walmart' AS store_id, price FROM results WHERE event_type = 'view' AND position = 0 AND price > 0),
    rows AS (SELECT * FROM surveyed WHERE ean IS NOT NULL
      UNION ALL SELECT source, ean, store_id, price FROM typed WHERE l_linenumber NOT IN (5, 7) AND l_tax <> 0.08 AND l_discount <> 0.1
      UNION ALL SELECT * FROM paged UNION ALL SELECT * FROM searched)
    SELECT source, count(*) AS n_rows, count(*) FILTER (price <= 100000) AS prices_written,
      count(DISTINCT (ean, store_id)) FILTER (price <= 100000) AS products_seen, count(*) FILTER (price > 100000) AS n_rejected, 'ok' AS status FROM rows GROUP BY source""",
)
def ingest_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One run over the four sources, their mappings read from files."""
    with shuffles_freed(spark):
        return _ingest_sources(spark, folder, work_dir(spark, "ingest-sources"))


def _ingest_sources(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The files of both large sources are gzipped, written slice by slice and deleted once their rows are staged."""

    def written(name: str, content: dict) -> str:
        value = F.lit(json.dumps(content, ensure_ascii=False)).alias("value")
        spark.range(1).select(value).write.text(f"{root}/{name}")
        return f"{root}/{name}"

    terms = [{"ean": e, "requiere": r, "excluye": x} for e, r, x in TERMS]
    survey, typed = f"{root}/survey", f"{root}/typed"
    for items in _slices_of_lines(spark, folder):
        _survey(spark, folder, items).write.mode("append").options(header=True, escape='"', **PACKED).csv(survey)
        _write_typed(_typed(spark, folder, items), typed, **PACKED)
    pages = _page_mapping(spark, folder)
    entry = F.struct("ean", "producto", "url")
    pages.select(F.to_json(F.struct(F.array(entry).alias("entradas"))).alias("value")).write.text(f"{root}/page-mapping")
    _pages_with_blocks(spark, folder).write.parquet(f"{root}/pages")
    seen = _responses(spark, folder).where(F.col("event_type") == "view")
    key = F.concat(F.lit("S"), F.col("event_id")).alias("ean")
    seen.select(key, F.lit("name").alias("by"), "body").write.parquet(f"{root}/responses")
    offered = F.concat(F.lit("Offer "), "event_id").alias("name")
    wanted = seen.select(key, offered, F.lit("pz").alias("unit"), F.lit(None).cast("double").alias("pack_amount"))
    wanted.write.parquet(f"{root}/wanted")
    sources = Registry(
        [
            SurveySource(survey, written("terms", {"entradas": terms})),
            ManualSource(typed, packed=True),
            PageSource(f"{root}/pages", f"{root}/page-mapping", "chedraui", mapping_lines=True),
            SearchSource(f"{root}/responses", f"{root}/wanted", written("ids", {"items": [], "_sin_mapear": []}), "walmart"),
        ]
    )
    known = [products(spark, folder).select("ean"), wanted.select("ean"), pages.select("ean"), term_table(spark).select("ean")]
    catalog = union_all(known).where(F.col("ean").isNotNull()).distinct()
    names = spark.createDataFrame([(s,) for s in dict.fromkeys(SURVEY_CHAINS.values())], "store_id string")
    stores = chains(spark, folder).select("store_id").union(names).distinct()
    large = {"survey": survey, "manual": typed}
    done = lambda source: discard(spark, large[source]) if source in large else None
    run = run_ingest(spark, sources, catalog, stores, f"{root}/run", datetime(2002, 1, 1), when_staged=done)
    return run.log.select("source", "n_rows", "prices_written", "products_seen", "n_rejected", "status")


_OFFERS = """raw_rows AS (SELECT event_id, event_type AS source, CASE event_type WHEN 'error' THEN 'not json'
    WHEN 'view' THEN '{"price": ' || value || ', "props": ' || props || '}'
    ELSE '{"offers": [{"price": ' || value || ', "seller": ' || props || '}], "store": "' || user_id || '", "sold": null, "new": true}' END AS raw FROM events)"""


def _raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw texts of several shapes, one of them no JSON."""
    table(spark, folder, "events").createOrReplaceTempView("raw_events")
    return spark.sql(f"WITH {_OFFERS.replace('FROM events', 'FROM raw_events')} SELECT * FROM raw_rows")


@query(
    "raw_fields",
    f"""WITH {_OFFERS}, parsed AS (SELECT source, raw, CASE WHEN json_valid(raw) THEN raw END AS good FROM raw_rows),
    fields AS (SELECT source, je.key AS field, CASE je.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
      WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
      FROM parsed, json_each(good) AS je WHERE good IS NOT NULL
    UNION ALL SELECT source, NULL, CASE WHEN raw IS NULL THEN 'missing' ELSE 'invalid' END FROM parsed WHERE good IS NULL)
    SELECT source, field, kind, count(*) AS n FROM fields GROUP BY ALL""",
)
def raw_field_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return raw_fields(_raw_rows(spark, folder))


@query(
    "raw_prices",
    f"""WITH {_OFFERS} SELECT event_id, coalesce(TRY_CAST(json_extract_string(good, '$.price') AS DOUBLE),
      TRY_CAST(json_extract_string(good, '$.offers[0].price') AS DOUBLE)) AS price,
      CAST(coalesce(json_extract_string(good, '$.props.k'), json_extract_string(good, '$.offers[0].seller.k')) AS BIGINT) AS k
    FROM (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS good FROM raw_rows)""",
)
def raw_prices(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.col("raw")
    return _raw_rows(spark, folder).select(
        "event_id",
        F.coalesce(raw_field(raw, "$.price", "double"), raw_field(raw, "$.offers[0].price", "double")).alias("price"),
        F.coalesce(raw_field(raw, "$.props.k", "bigint"), raw_field(raw, "$.offers[0].seller.k", "bigint")).alias("k"),
    )
