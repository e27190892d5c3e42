"""Session settings and the shared folder for tables a job writes between steps."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows of a slice at least, and slices at most.
SLICE_ROWS, SLICES = 1 << 20, 6


def build_session(app: str, cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="basketwise-")


def run_folder(spark: SparkSession) -> str:
    """The folder that holds everything this application writes between steps; its caller may delete it.

    It lies under spark.checkpoint.dir, which every executor must reach. Only a session that
    runs in one process may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/basketwise-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the run folder."""
    return f"{run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a step go when the step ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def n_slices(n_rows: int) -> int:
    """In how many slices so many rows are dealt with; few rows in one."""
    return max(1, min(SLICES, n_rows // SLICE_ROWS))


def sliced(rows: DataFrame, n: int, *key: str) -> list[DataFrame]:
    """A table in n slices, the rows of a key in the same one.

    For written tables, which are read once per slice: where a slice is dealt with after the other,
    the disk holds the shuffle files of one of them at a time.
    """
    if n == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) for k in range(n)]


def materialise(frame: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Later steps start from the written table: it is computed once, survives lost
    executors, and its real size decides how it is joined.
    """
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``work_dir`` that no later step reads, before the folder of the run goes."""
    if not path.startswith(f"{run_folder(spark)}/"):
        raise ValueError(f"{path} was not written between steps of this application")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
