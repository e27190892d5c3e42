"""Streams: any batching gives what one batch gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketwise.operators.consolidation import latest_prices, median_prices
from basketwise.streaming.current import KeyedTable, add_up, count_table, read_current, read_medians, start_current, start_medians
from basketwise.streaming.ingest import file_stream, start_dedupe, start_ingest

OBS = "ean string, store_id string, branch_id string, price double, captured_at timestamp_ntz, source string"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Seven files, with late rows and a repeat in the last one."""
    folder = tmp_path_factory.mktemp("feed")
    start = datetime(2025, 1, 1)
    rows = [
        (str(n % 3), "xy"[n % 2], str(n % 5), float(n * 7 % 11 + 1), start + timedelta(hours=n * 37 % 50), "s") for n in range(70)
    ]
    for n in range(7):
        part = rows[n * 10:(n + 1) * 10] + (rows[:4] if n == 6 else [])
        spark.createDataFrame(part, OBS).coalesce(1).write.parquet(str(folder / f"part-{n}"))
    return str(folder)


def stream(spark, feed):
    return file_stream(spark, f"{feed}/*", OBS, files_per_batch=1)


def batch(spark, feed):
    return spark.read.schema(OBS).parquet(f"{feed}/*")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("every", [2, 100])
def test_current_prices(spark, feed, tmp_path, every):
    start_current(stream(spark, feed), str(tmp_path), every).awaitTermination()
    assert len(list((tmp_path / "latest" / "recent").glob("batch=*"))) == 7
    columns = ["ean", "store_id", "price", "captured_at"]
    assert rows_of(read_current(spark, str(tmp_path), every).select(columns)) == rows_of(latest_prices(batch(spark, feed)).select(columns))


@pytest.mark.parametrize("every", [2, 3, 100])
def test_medians(spark, feed, tmp_path, every):
    start_medians(stream(spark, feed), str(tmp_path), every).awaitTermination()
    columns = ["ean", "store_id", "price", "n_obs", "price_min", "price_max"]
    assert rows_of(read_medians(spark, str(tmp_path), every).select(columns)) == rows_of(median_prices(batch(spark, feed)).select(columns))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = KeyedTable(str(tmp_path), add_up, every=2)
    counts = spark.createDataFrame([("A", "x", 1.0, 3)], "ean string, store_id string, price double, n bigint")
    for batch_id in (0, 1, 2, 2, 3):
        table.append(batch_id, counts)
    assert table.read(spark, 3).agg(F.sum("n")).first()[0] == 12
    table.append(2, counts)
    assert table.read(spark, 2).agg(F.sum("n")).first()[0] == 9


def files_read(frame):
    """How many files the scans of a plan without shuffles open."""
    execution = frame._jdf.queryExecution()
    execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


@pytest.mark.parametrize("every", [3, 100])
def test_a_batch_reads_touched_buckets_only(spark, tmp_path, every):
    table = KeyedTable(str(tmp_path / "state"), add_up, every=every, buckets=16)
    row = "ean string, store_id string, price double, n bigint"
    many = spark.createDataFrame([(str(k), "x", 1.0, 1) for k in range(400)], row)
    few = spark.createDataFrame([("7", "x", 1.0, 5)], row)
    for batch_id in range(8):
        table.append(batch_id, few if batch_id == 5 else many)
    buckets = table.touched(spark, 5, few.schema)
    assert len(buckets) == 1
    state = table.rows(spark, 5, buckets, few.schema)
    # One folded folder at most, and the deltas of one bucket.
    assert files_read(state) <= min(6, every) + 1 < 16
    assert files_read(table.rows(spark, 5, None, few.schema)) >= 16 * 2
    assert {r["n"] for r in add_up(state.where("ean = '7'")).collect()} == {10}
    assert table.read(spark).agg(F.sum("n")).first()[0] == 7 * 400 + 5
    # Each batch folds only the buckets that are due.
    folds = sorted((tmp_path / "state" / "folded").glob("before=*"))
    assert len(folds) == max(0, 8 - every) and all(len(list(f.glob("bucket=*"))) <= -(-16 // every) for f in folds)


def test_dedupe_opens_only_the_months_of_a_batch(spark, tmp_path):
    from basketwise.streaming.ingest import kept_in_months_of

    when = [datetime(2020 + n // 12, n % 12 + 1, 3) for n in range(40)] + [None]
    for n, rows in enumerate([[("A", "x", "", 1.0, t, "s") for t in when], [("A", "x", "", 2.0, t, "s") for t in (when[0], None, datetime(2030, 1, 1))]]):
        spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{n}"))
    start_dedupe(file_stream(spark, str(tmp_path / "in" / "*"), OBS, files_per_batch=1), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "deduped"))
    # Rows without a time repeat no more, and an old row brings in its own month only.
    assert got.count() == 42 and got.where("captured_at IS NULL").count() == 1
    second = spark.read.parquet(str(tmp_path / "out" / "arrived" / "batch=1"))
    assert files_read(kept_in_months_of(second, str(tmp_path / "out" / "deduped"), 1)) == 2


def test_ingest_splits_valid_and_rejected(spark, feed, tmp_path):
    products = spark.createDataFrame([("0",), ("1",)], "ean string")
    stores = spark.createDataFrame([("x",)], "store_id string")
    written = stream(spark, feed).withColumn("captured_at", F.col("captured_at").cast("string"))
    start_ingest(written, products, stores, str(tmp_path)).awaitTermination()
    valid, rejects = spark.read.parquet(str(tmp_path / "valid")), spark.read.parquet(str(tmp_path / "rejects"))
    good = batch(spark, feed).where("ean IN ('0', '1') AND store_id = 'x'").count()
    assert valid.count() == good and rejects.count() == 74 - good


def test_dedupe(spark, feed, tmp_path):
    start_dedupe(stream(spark, feed), str(tmp_path)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "deduped"))
    keys = batch(spark, feed).select("ean", "store_id", "branch_id", "captured_at").distinct()
    assert got.count() == keys.count()


def test_dedupe_keeps_late_first_rows(spark, tmp_path):
    """One file per batch, days in the wrong order: every distinct row stays."""
    day = lambda n: datetime(2025, 1, 1) + timedelta(days=n)
    for n, days in enumerate(([100, 101], [1, 2, 101], [3, 4, 1])):
        rows = [("A", "x", None if n == 1 else "", 1.0, day(d), "s") for d in days]
        spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{n}"))
    stream = file_stream(spark, str(tmp_path / "in" / "*"), OBS, files_per_batch=1)
    start_dedupe(stream, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "deduped"))
    assert sorted(r["captured_at"] for r in got.collect()) == [day(d) for d in (1, 2, 3, 4, 100, 101)]


def test_streams_read_a_file_and_a_folder_of_part_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", "x", "", 1.0, datetime(2025, 1, n), "s") for n in range(1, 10)], OBS)
    rows.repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "file.parquet")
    for name in ("folder", "file"):
        start_current(file_stream(spark, str(tmp_path / f"{name}.parquet"), OBS), str(tmp_path / name)).awaitTermination()
        assert read_current(spark, str(tmp_path / name)).count() == 1
