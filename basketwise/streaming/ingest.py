"""Streaming ingest: new files of observations to a valid and a reject table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from basketwise.operators.validation import rejected_rows, valid_rows, with_problems
from basketwise.sinks.history import MONTH, first_of_each, new_rows


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of a parquet table, be it one file, a folder of part files, or a pattern for either."""
    # As a pattern the path may name a file too; a plain path would have to be a folder.
    pattern = path if "*" in path else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


# Read what is there and stop. Pass {"processingTime": "1 minute"} to keep running.
READ_AND_STOP = {"availableNow": True}


def batch_path(root: str, batch_id: int) -> str:
    """Folder of one batch; a batch that is run again overwrites its own folder only."""
    return f"{root}/batch={batch_id}"


def start_ingest(
    observations: DataFrame, products: DataFrame, stores: DataFrame, root: str, trigger: dict = READ_AND_STOP
) -> StreamingQuery:
    """Checks every batch and writes valid rows and rejects."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Checked once, written once, then split by reading back.
        staged = batch_path(f"{root}/checked", batch_id)
        with_problems(batch, products, stores).write.mode("overwrite").parquet(staged)
        checked = spark.read.parquet(staged)
        valid_rows(checked).write.mode("overwrite").parquet(batch_path(f"{root}/valid", batch_id))
        rejected_rows(checked).write.mode("overwrite").parquet(batch_path(f"{root}/rejects", batch_id))

    return (
        observations.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/_checkpoint/ingest")
        .trigger(**trigger)
        .start()
    )


def start_dedupe(observations: DataFrame, root: str, trigger: dict = READ_AND_STOP) -> StreamingQuery:
    """Writes the stream without repeats of the identity of an observation, however late they come.

    What is kept lies by month of capture, rows without a time in a part of their own. A batch is
    compared with what earlier batches kept in the very months it holds, so no state has to be bounded,
    no late first row is lost, and a row of an old date makes only its own month be read. A batch that
    runs again replaces its own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = batch_path(f"{root}/arrived", batch_id)
        first_of_each(batch).withColumn(MONTH, F.trunc("captured_at", "month")).write.mode("overwrite").parquet(staged)
        new = spark.read.parquet(staged)
        if batch_id:
            new = new_rows(kept_in_months_of(new, f"{root}/deduped", batch_id), new)
        parts = new.withColumn("batch", F.lit(batch_id).cast("long")).hint("rebalance", MONTH).write
        parts.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(MONTH, "batch").parquet(f"{root}/deduped")

    return (
        observations.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/_checkpoint/dedupe")
        .trigger(**trigger)
        .start()
    )


def kept_in_months_of(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """What earlier batches kept in the months of a batch; as many months as it holds are looked up."""
    months = [r[MONTH] for r in batch.select(MONTH).distinct().collect()]
    schema = StructType([*batch.schema.fields, StructField("batch", LongType())])
    within = F.col(MONTH).isin([m for m in months if m is not None])
    if None in months:
        within = within | F.col(MONTH).isNull()
    # Conditions on folders only, so that no other month is opened.
    return batch.sparkSession.read.schema(schema).parquet(path).where(within & (F.col("batch") < batch_id)).drop("batch")
