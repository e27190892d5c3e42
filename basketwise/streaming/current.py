"""Current prices and medians kept up to date from a stream.

The state lies in a fixed number of buckets by key. Every batch writes what it changed to a folder of
its own, bucket by bucket, so a batch that is run again after a failure replaces the same rows, and a
batch that needs the state reads only the buckets it touches. The deltas of a bucket are folded into
one folder from time to time, each batch folding a few buckets, so neither a batch nor a reader has
to go through the whole past and no batch has to rewrite the whole state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from basketwise.operators.consolidation import latest_prices, medians_of_counts, price_counts
from basketwise.streaming.ingest import READ_AND_STOP, batch_path

KEY = ("ean", "store_id")
FOLD_EVERY = 100
BUCKETS = 64


def add_up(counts: DataFrame) -> DataFrame:
    """Counted prices of several batches as one."""
    return counts.groupBy("ean", "store_id", "price").agg(F.sum("n").alias("n"))


def newest(rows: DataFrame) -> DataFrame:
    """The row of the last batch per product and store."""
    values = [c for c in rows.columns if c not in ("ean", "store_id")]
    kept = rows.groupBy("ean", "store_id").agg(F.max_by(F.struct(*values), "as_of_batch").alias("row"))
    return kept.select("ean", "store_id", "row.*")


@dataclass(frozen=True)
class KeyedTable:
    """A table that grows by batches, bucketed by key, with a rule that folds many rows of a key into one.

    Bucket b is folded by every batch n with n % every == b % every, from the batch ``every`` on. Which
    folders make up the state of a bucket so follows from the number of the batch alone, and a batch
    reads the same state whenever it runs: one folded folder and at most ``every`` recent ones,
    whatever the length of the stream. Older folders may be removed.
    """

    root: str
    fold: Callable[[DataFrame], DataFrame]
    every: int = FOLD_EVERY
    buckets: int = BUCKETS
    key: tuple[str, ...] = KEY

    def recent(self, batch_id: int) -> str:
        return batch_path(f"{self.root}/recent", batch_id)

    def _folded(self, batch_id: int) -> str:
        return f"{self.root}/folded/before={batch_id}"

    def _write(self, rows: DataFrame, path: str) -> None:
        bucketed = rows.withColumn("bucket", F.pmod(F.hash(*self.key), F.lit(self.buckets)))
        # A bucket comes into few files, and one that is much larger than the rest is split.
        bucketed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def append(self, batch_id: int, rows: DataFrame) -> None:
        if batch_id >= self.every:
            due = [b for b in range(self.buckets) if b % self.every == batch_id % self.every]
            self._write(self.read(rows.sparkSession, batch_id - 1, due, rows.schema), self._folded(batch_id))
        self._write(rows, self.recent(batch_id))

    def _stored(self, spark: SparkSession, folders: list[str], schema: StructType, number: str) -> DataFrame:
        # The schema is given, as a folder may hold no rows.
        whole = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField(number, LongType())])
        return spark.read.schema(whole).option("basePath", self.root).parquet(*folders)

    def changed(self, spark: SparkSession, batch_id: int, schema: StructType) -> DataFrame:
        """The rows a batch wrote."""
        return self._stored(spark, [self.recent(batch_id)], schema, "batch")

    def touched(self, spark: SparkSession, batch_id: int, schema: StructType) -> list[int]:
        """The buckets a batch wrote; at most as many as there are."""
        return sorted(r["bucket"] for r in self.changed(spark, batch_id, schema).select("bucket").distinct().collect())

    def rows(self, spark: SparkSession, batch_id: int, buckets: list[int] | None, schema: StructType) -> DataFrame:
        """Rows that make up the state after a batch, not yet folded, of some buckets or of all."""
        # The last batch that folded a bucket, or the first one.
        since = F.lit(batch_id) - F.pmod(F.lit(batch_id) - F.col("bucket"), F.lit(self.every))
        since = F.when(since < self.every, 0).otherwise(since)
        oldest = batch_id - self.every + 1
        recent = self._stored(spark, [self.recent(b) for b in range(oldest if oldest >= self.every else 0, batch_id + 1)], schema, "batch")
        state = recent.where(F.col("batch") >= since)
        folds = [self._folded(b) for b in range(max(self.every, oldest), batch_id + 1)]
        if folds:
            state = state.union(self._stored(spark, folds, schema, "before").where(F.col("before") == since))
        # All of these conditions are on folders, so that only those that count are read.
        if buckets is not None:
            state = state.where(F.col("bucket").isin(buckets))
        return state.select(*schema.names)

    def read(self, spark: SparkSession, batch_id: int | None = None, buckets: list[int] | None = None, schema: StructType | None = None) -> DataFrame:
        """State after a batch, by default the last one written."""
        if batch_id is None or schema is None:
            written = spark.read.parquet(f"{self.root}/recent")
            schema = schema or written.drop("batch", "bucket").schema
            batch_id = written.agg(F.max("batch")).first()[0] if batch_id is None else batch_id
        return self.fold(self.rows(spark, batch_id, buckets, schema))


def current_table(root: str, every: int = FOLD_EVERY) -> KeyedTable:
    """Latest rows; a late row never replaces a newer one."""
    return KeyedTable(f"{root}/latest", latest_prices, every)


def count_table(root: str, every: int = FOLD_EVERY) -> KeyedTable:
    return KeyedTable(f"{root}/counts", add_up, every)


def median_table(root: str, every: int = FOLD_EVERY) -> KeyedTable:
    return KeyedTable(f"{root}/medians", newest, every)


def _start(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_current(
    observations: DataFrame, root: str, every: int = FOLD_EVERY, trigger: dict = READ_AND_STOP
) -> StreamingQuery:
    """Writes the latest row per product and store of every batch."""
    table = current_table(root, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch_id, latest_prices(batch))

    return _start(observations, write, f"{root}/_checkpoint/latest", trigger)


def read_current(spark: SparkSession, root: str, every: int = FOLD_EVERY) -> DataFrame:
    return current_table(root, every).read(spark)


def start_medians(
    observations: DataFrame, root: str, every: int = FOLD_EVERY, trigger: dict = READ_AND_STOP
) -> StreamingQuery:
    """Keeps counted prices and writes the medians of the products a batch touched."""
    counts, medians = count_table(root, every), median_table(root, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counted = price_counts(batch)
        schema = counted.schema
        counts.append(batch_id, counted)
        new = counts.changed(spark, batch_id, schema)
        state = counts.rows(spark, batch_id, counts.touched(spark, batch_id, schema), schema)
        cells = add_up(state.join(new.select(*KEY).distinct(), list(KEY), "left_semi"))
        medians.append(batch_id, medians_of_counts(cells).withColumn("as_of_batch", F.lit(batch_id)))

    return _start(observations, write, f"{root}/_checkpoint/medians", trigger)


def read_medians(spark: SparkSession, root: str, every: int = FOLD_EVERY) -> DataFrame:
    return median_table(root, every).read(spark).drop("as_of_batch")
