"""Helpers shared by the operators: tables, cells of rows inside a task, connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    # Spark's own file server hands it to the executors.
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_cells(key: str, work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable:
    """A mapInPandas function over rows sorted by `key`: calls `work` once for each cell of equal keys.

    Only one cell and one batch are in memory at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            starts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1), len(batch)]
            for a, b in zip(starts, starts[1:], strict=False):
                part = batch.iloc[a:b]
                if held and held[0][key].iloc[0] != part[key].iloc[0]:
                    out = work(pd.concat(held, ignore_index=True))
                    held = []
                    if out is not None and len(out):
                        yield out
                held.append(part)
        if held:
            out = work(pd.concat(held, ignore_index=True))
            if out is not None and len(out):
                yield out

    return run


def spread(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives places that the links (x, y) connect the smallest label among them."""
    while True:
        least = np.minimum(label[x], label[y])
        if (label[x] == least).all() and (label[y] == least).all():
            return
        for side in (x, y):
            # The root of a tree takes the smaller label too, so that whole trees move.
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        while (label[label] != label).any():
            label[:] = label[label]


class Forest:
    """Union-find over any keys; the smallest key of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x, y) -> bool:
        """True if the two were in different trees."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        low, high = (x, y) if x < y else (y, x)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True


def _spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch["a"].to_list(), batch["b"].to_list(), strict=True):
            forest.join(a, b)
        nodes = [x for x in forest.up if forest.root(x) != x]
        yield pd.DataFrame({"a": nodes, "b": [forest.root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (a, b) of longs touches; root is the smallest node reachable.

    Alternates large-star and small-star until the links are stars. Each batch of links is first
    reduced to a spanning forest inside its task. Every round is written, so that a lost executor
    repeats one round only.
    """
    pairs = links.select("a", "b").where("a <> b").mapInPandas(_spanning, "a long, b long").distinct()
    pairs, seen = materialise(pairs, "links"), None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
