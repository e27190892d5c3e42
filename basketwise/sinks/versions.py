"""A keyed table in versions, of which a merge rewrites only the parts that its rows fall into.

Rows lie in a fixed number of parts. A merge writes the parts it touches anew, and a manifest that says
for every part which folder holds it; parts it does not touch are those of the version before. A
version counts once its manifest is written, so a run that dies half way changes nothing. Older
versions stay readable until their folders are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from basketwise.session import materialise

MANIFEST = "version bigint, part int, folder string, columns string"
GROUPS, SPREAD = 64, 4


@dataclass(frozen=True)
class VersionedTable:
    """Rows of unique keys below a folder.

    ``by`` names the columns of the key that updates have in common, such as the store whose prices a
    source delivers: their hash chooses one of ``groups``, so an update of one store rewrites one
    group. The hash of the whole key spreads a group over ``spread`` parts. Both numbers belong to the
    table and must not change. An update of keys from everywhere touches every part and
    rewrites the whole table. Missing keys equal each other.
    """

    root: str
    key: tuple[str, ...]
    by: tuple[str, ...] = ()
    groups: int = GROUPS
    spread: int = SPREAD

    def _part(self) -> Column:
        group = F.pmod(F.hash(*(self.by or self.key)), F.lit(self.groups))
        return (group * self.spread + F.pmod(F.xxhash64(*self.key), F.lit(self.spread))).cast("int")

    def manifest(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """One row per part of a version, by default of the newest, and one without a part; no row before the first."""
        try:
            manifests = spark.read.schema(MANIFEST).json(f"{self.root}/manifests/*")
        except AnalysisException:
            return spark.createDataFrame([], MANIFEST)
        wanted = F.lit(version) if version is not None else manifests.agg(F.max("version")).scalar()
        return manifests.where(F.col("version") == wanted)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest."""
        parts = self.manifest(spark, version).collect()
        if not parts:
            raise LookupError(f"{self.root} has no version {'at all' if version is None else version}")
        return self._rows(spark, parts)

    def _rows(self, spark: SparkSession, parts: list) -> DataFrame:
        schema = StructType.fromJson(json.loads(parts[0]["columns"]))
        folders = [f"{self.root}/data/{p['folder']}/part={p['part']}" for p in parts if p["folder"]]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Publishes a version with the rows merged in and returns its number.

        ``rows`` hold a key at most once. Where a key is known, ``combine(old, new)`` decides, by default the
        new row. Two merges at a time may take the same number; the later one then fails and can run again.
        """
        spark = rows.sparkSession
        names = rows.columns
        # Looked at for its parts and merged, so it is written first.
        staged = materialise(rows.withColumn("part", self._part()), "merge-rows")
        touched = {r["part"] for r in staged.select("part").distinct().collect()}
        before = self.manifest(spark).collect()
        version = before[0]["version"] + 1 if before else 1
        new = staged.select(*names)
        known = [p for p in before if p["part"] in touched]
        if known:
            old = self._rows(spark, known).select(*names)
            new = combine(old, new) if combine else newer(old, new, self.key)
        folder = f"{version}-{uuid.uuid4().hex}"
        if touched:
            # A part comes into few files, and one that is much larger than the rest is split.
            parted = new.select(*names).withColumn("part", self._part()).hint("rebalance", "part")
            parted.write.partitionBy("part").parquet(f"{self.root}/data/{folder}")
        columns = new.select(*names).schema.json()
        kept = touched
        if combine and known:
            # The rule may have left a part without rows.
            written = spark.read.schema("part int").parquet(f"{self.root}/data/{folder}")
            kept = {r["part"] for r in written.distinct().collect()}
        manifest = [(version, p["part"], p["folder"], p["columns"]) for p in before if p["folder"] and p["part"] not in touched]
        manifest += [(version, part, folder, columns) for part in sorted(kept)]
        # A version without rows has its number and columns all the same.
        manifest.append((version, None, None, columns))
        # At most one row per part; one file, so that it is there whole or not at all.
        listed = spark.createDataFrame(manifest, MANIFEST).coalesce(1)
        listed.write.mode("errorifexists").json(f"{self.root}/manifests/{version}")
        return version


def newer(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of both tables; where a key is in both, the new row."""
    same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(new[k]) for k in key))
    return new.unionByName(old.join(new, same, "left_anti"))
