"""Queries that write or merge tables, in batch and from streams."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.operators.consolidation import consolidate
from basketwise.operators.validation import with_problems
from basketwise.plans.bindings import (
    EVENT_OBS,
    LATEST,
    MEDIANS,
    OBS,
    RAW,
    as_of,
    chains,
    events_as_observations,
    observations,
    products,
    raw_observations,
    table,
)
from basketwise.plans.catalogue import query
from basketwise.plans.ingest import run_ingest
from basketwise.session import work_dir
from basketwise.sinks.dimensions import upsert, upsert_report
from basketwise.sinks.document import publish_document, read_document_head, read_document_products
from basketwise.sinks.history import first_of_each, insert_or_ignore
from basketwise.sinks.run_log import run_log
from basketwise.sinks.snapshot import merge_cells, prices_snapshot, read_snapshot
from basketwise.sinks.versions import VersionedTable
from basketwise.sources.registry import Feed, Registry
from basketwise.streaming.current import read_current, read_medians, start_current, start_medians
from basketwise.streaming.ingest import file_stream, start_dedupe, start_ingest

SPLIT_DAY = "1999-01-01"


@query(
    "snapshot_merge",
    f"""WITH {OBS.replace("obs AS", "all_obs AS")},
    obs AS (SELECT * FROM all_obs WHERE captured_at < '{SPLIT_DAY}'), {MEDIANS.replace("medians AS", "old AS")},
    late AS (SELECT * FROM all_obs WHERE captured_at >= '{SPLIT_DAY}'),
    {MEDIANS.replace("medians AS", "new AS").replace("FROM obs", "FROM late")}
    SELECT ean, store_id, coalesce(new.price, old.price) AS price, new.price IS NOT NULL AS is_new
    FROM old FULL JOIN new USING (ean, store_id)""",
)
def snapshot_merge(spark: SparkSession, folder: str) -> DataFrame:
    observed = observations(spark, folder)
    current = consolidate(observed.where(F.col("captured_at") < SPLIT_DAY))
    new = consolidate(observed.where(F.col("captured_at") >= SPLIT_DAY))
    merged = merge_cells(current, new)
    return merged.select("ean", "store_id", "price", (F.col("captured_at") >= SPLIT_DAY).alias("is_new"))


@query(
    "snapshot_versions",
    f"""WITH {OBS.replace("obs AS", "all_obs AS")},
    obs AS (SELECT * FROM all_obs WHERE captured_at < '{SPLIT_DAY}'), {MEDIANS.replace("medians AS", "old AS")},
    late AS (SELECT * FROM all_obs WHERE captured_at >= '{SPLIT_DAY}' AND store_id = 'asia'),
    {MEDIANS.replace("medians AS", "new AS").replace("FROM obs", "FROM late")}
    SELECT CAST(1 AS BIGINT) AS version, ean, store_id, price FROM old
    UNION ALL SELECT 2, ean, store_id, coalesce(new.price, old.price) FROM old FULL JOIN new USING (ean, store_id)""",
)
def snapshot_versions(spark: SparkSession, folder: str) -> DataFrame:
    observed = observations(spark, folder)
    cells = VersionedTable(work_dir(spark, "snapshot-versions"), ("ean", "store_id"), ("store_id",))
    current = consolidate(observed.where(F.col("captured_at") < SPLIT_DAY))
    # A later run of a source that knows one store only.
    new = consolidate(observed.where((F.col("captured_at") >= SPLIT_DAY) & (F.col("store_id") == "asia")))
    versions = [cells.merge(rows.select("ean", "store_id", "price")) for rows in (current, new)]
    first, second = (cells.read(spark, v).select(F.lit(v).cast("bigint").alias("version"), "*") for v in versions)
    return first.unionByName(second)


@query(
    "snapshot_map",
    f"""WITH {OBS}, {LATEST}
    SELECT ean, string_agg(store_id || '=' || price, ';' ORDER BY store_id) AS prices, count(*) AS n_stores,
      (SELECT strftime(max(captured_at), '%Y-%m-%dT%H:%M:%S.000Z') FROM obs) AS "generatedAt"
    FROM latest GROUP BY ean""",
)
def snapshot_map(spark: SparkSession, folder: str) -> DataFrame:
    header, per_product = prices_snapshot(observations(spark, folder), as_of())
    entries = F.transform(F.map_entries("prices"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return per_product.select(
        "ean",
        F.array_join(entries, ";").alias("prices"),
        F.size("prices").cast("bigint").alias("n_stores"),
        header.select("generatedAt").scalar().alias("generatedAt"),
    )


@query(
    "snapshot_document",
    f"""WITH {OBS}, {LATEST}
    SELECT ean, store_id, CAST(price AS VARCHAR) AS price, currency, "generatedAt" FROM latest,
      (SELECT strftime(max(captured_at), '%Y-%m-%dT%H:%M:%S.000Z') AS "generatedAt", 'MXN' AS currency FROM obs)""",
)
def snapshot_document(spark: SparkSession, folder: str) -> DataFrame:
    root = work_dir(spark, "price-document")
    header, per_product = prices_snapshot(observations(spark, folder), as_of())
    version = publish_document(header, per_product, root, datetime(2002, 1, 1))
    head = read_document_head(spark, root, "generatedAt string, currency string", version)
    cells = read_document_products(spark, root, version)
    return cells.withColumnRenamed("price_text", "price").withColumns(
        {name: head.select(name).scalar() for name in ("currency", "generatedAt")}
    )


@query(
    "history_append",
    f"""WITH {OBS}, firsts AS (
      SELECT *, row_number() OVER (PARTITION BY ean, store_id, branch_id, captured_at, captured_at < '{SPLIT_DAY}' ORDER BY price, source) AS r FROM obs)
    SELECT ean, store_id, branch_id, captured_at, price, source FROM firsts WHERE r = 1""",
)
def history_append(spark: SparkSession, folder: str) -> DataFrame:
    observed = observations(spark, folder)
    history = first_of_each(observed.where(F.col("captured_at") < SPLIT_DAY))
    # The batch repeats everything the history holds.
    return insert_or_ignore(history, observed)


@query(
    "run_log",
    f"""WITH {RAW}, spoiled AS (SELECT * REPLACE (CASE WHEN source = 'NF' THEN list_append(problems, 'unknown_store') ELSE problems END AS problems) FROM problems),
    counted AS (SELECT source, count(*) AS n_rows, count(*) FILTER (len(problems) = 0) AS prices_written,
      count(*) FILTER (len(problems) > 0) AS n_rejected,
      count(DISTINCT (ean, store_id)) FILTER (len(problems) = 0) AS products_seen FROM spoiled GROUP BY source),
    failed AS (SELECT l_returnflag || l_linestatus AS source, count(*) AS n_errors FROM lineitem
      WHERE l_quantity = 1 AND l_returnflag = 'R' GROUP BY ALL)
    SELECT source, n_rows, prices_written, products_seen, n_rejected, coalesce(n_errors, 0) AS n_errors,
      CASE WHEN prices_written = 0 THEN 'failed' WHEN n_errors > 0 THEN 'partial' ELSE 'ok' END AS status
    FROM counted LEFT JOIN failed USING (source)""",
)
def run_log_per_source(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_observations(spark, folder)
    # One source names a store nobody knows in every row.
    store = F.when(F.col("source") == "NF", F.lit("elsewhere")).otherwise(F.col("store_id"))
    checked = with_problems(raw.withColumn("store_id", store), products(spark, folder), chains(spark, folder))
    items = table(spark, folder, "lineitem")
    errors = items.where((F.col("l_quantity") == 1) & (F.col("l_returnflag") == "R")).select(
        F.concat("l_returnflag", "l_linestatus").alias("source"), F.lit("timeout").alias("error")
    )
    return run_log(checked, errors)


@query(
    "dimension_upsert",
    """SELECT p_partkey, CASE WHEN p_size >= 20 THEN upper(p_name) ELSE p_name END AS name,
      CASE WHEN p_size >= 20 THEN 'new' ELSE 'old' END AS version FROM part""",
)
def dimension_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return upsert(*_old_and_new(spark, folder), "p_partkey")


def _old_and_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts up to size 25 as a dimension, parts from size 20 as its update."""
    part = table(spark, folder, "part")
    old = part.where(F.col("p_size") <= 25).select("p_partkey", F.col("p_name").alias("name"), F.lit("old").alias("version"))
    new = part.where(F.col("p_size") >= 20).select("p_partkey", F.upper("p_name").alias("name"), F.lit("new").alias("version"))
    return old, new


@query(
    "dimension_versions",
    """SELECT p_partkey, CASE WHEN p_size >= 20 THEN upper(p_name) ELSE p_name END AS name,
      CASE WHEN p_size >= 20 THEN 'new' ELSE 'old' END AS version FROM part""",
)
def dimension_versions(spark: SparkSession, folder: str) -> DataFrame:
    parts = VersionedTable(work_dir(spark, "dimension-versions"), ("p_partkey",), groups=16, spread=1)
    for rows in _old_and_new(spark, folder):
        parts.merge(rows)
    return parts.read(spark)


@query(
    "upsert_counts",
    """SELECT count(*) FILTER (p_size > 25) AS n_inserted, count(*) FILTER (p_size BETWEEN 20 AND 25) AS n_updated,
      count(*) FILTER (p_size < 20) AS n_kept FROM part""",
)
def upsert_counts(spark: SparkSession, folder: str) -> DataFrame:
    return upsert_report(*_old_and_new(spark, folder), "p_partkey")


@dataclass(frozen=True)
class UncheckedSource:
    """Unchecked observations that carry one source label."""

    id: str
    folder: str
    label: str
    automatable: bool = True
    chains: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"Source {self.id}"

    def read(self, spark: SparkSession, run_at: datetime) -> Feed:
        rows = raw_observations(spark, self.folder).where(F.col("source") == self.label)
        missing = F.lit(None).cast("string")
        return Feed(
            rows.select(
                "ean", "store_id", "branch_id", "price", F.lit("MXN").alias("currency"),
                "captured_at", "source",
                missing.alias("source_url"), missing.alias("raw"),
            )
        )


@query(
    "ingest_run",
    f"""WITH {RAW}, obs AS (SELECT ean, store_id, price FROM problems WHERE len(problems) = 0), {MEDIANS}
    SELECT ean, store_id, price, 'AF+AO+NF+NO+RF+RO+unnamed' AS sources FROM medians""",
)
def ingest_run(spark: SparkSession, folder: str) -> DataFrame:
    root = work_dir(spark, "ingest-run")
    labels = ["AF", "AO", "NF", "NO", "RF", "RO"]
    sources = [UncheckedSource(label, folder, label) for label in labels] + [UncheckedSource("unnamed", folder, "")]
    run_ingest(spark, Registry(sources), products(spark, folder), chains(spark, folder), root, datetime(2002, 1, 1))
    header, cells = read_snapshot(spark, f"{root}/snapshot")
    return cells.select("ean", "store_id", "price", header.select("source").scalar().alias("sources"))


EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_observations(file_stream(spark, f"{folder}/events.parquet", EVENT_COLUMNS))


@query(
    "stream_ingest",
    f"""WITH {EVENT_OBS}
    SELECT CASE WHEN ean IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) AND store_id <> 'error' AND price > 0 THEN 'valid' ELSE 'reject' END AS kind,
      store_id, count(*) AS n, max(captured_at) AS newest
    FROM obs GROUP BY ALL""",
)
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    root = work_dir(spark, "stream-ingest")
    kinds = table(spark, folder, "events").select(F.col("event_type").alias("store_id")).distinct()
    stores = kinds.where(F.col("store_id") != "error")
    stream = _event_stream(spark, folder)
    written = stream.withColumn("captured_at", F.col("captured_at").cast("string"))
    start_ingest(written, products(spark, folder), stores, root).awaitTermination()
    valid = spark.read.parquet(f"{root}/valid").withColumn("kind", F.lit("valid"))
    rejects = spark.read.parquet(f"{root}/rejects").withColumn("kind", F.lit("reject")).drop("problems")
    return valid.unionByName(rejects).groupBy("kind", "store_id").agg(
        F.count("*").alias("n"), F.max(F.col("captured_at").cast("timestamp_ntz")).alias("newest")
    )


@query(
    "stream_dedupe",
    f"WITH {EVENT_OBS} SELECT DISTINCT ean, store_id, captured_at FROM obs",
)
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    root = work_dir(spark, "stream-dedupe")
    stream = _event_stream(spark, folder)
    # Every event arrives twice.
    twice = stream.unionByName(_event_stream(spark, folder)).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    start_dedupe(twice, root).awaitTermination()
    return spark.read.parquet(f"{root}/deduped").select(
        "ean", "store_id", F.col("captured_at").cast("timestamp_ntz").alias("captured_at")
    )


@query(
    "stream_current",
    f"WITH {EVENT_OBS}, {LATEST} SELECT ean, store_id, price, captured_at FROM latest",
)
def stream_current(spark: SparkSession, folder: str) -> DataFrame:
    root = work_dir(spark, "stream-current")
    start_current(_event_stream(spark, folder), root).awaitTermination()
    return read_current(spark, root).select("ean", "store_id", "price", "captured_at")


@query(
    "stream_median",
    f"WITH {EVENT_OBS}, {MEDIANS} SELECT ean, store_id, price, n_obs, price_min, price_max FROM medians",
)
def stream_median(spark: SparkSession, folder: str) -> DataFrame:
    root = work_dir(spark, "stream-median")
    start_medians(_event_stream(spark, folder), root).awaitTermination()
    return read_medians(spark, root).select("ean", "store_id", "price", "n_obs", "price_min", "price_max")
