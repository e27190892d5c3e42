"""A Merkle manifest of a dataset: a log of nodes in postorder, and proofs read from it by position.

The rows of a tree are its leaves, in the order of their keys. While a level has several nodes,
every two consecutive ones, or a last one alone, become their digest. Leaves are dealt to aligned
builders of 2**BITS leaves each; a builder writes the nodes it completes in the order in which
they are completed, and builders of higher tiers go on from the tops of lower ones. The position
of a node in the postorder of its tree follows in closed form from the sizes of the subtrees to
its left and below it, so that the siblings that prove a leaf are addressed by number: those below
a builder's top lie in one stretch of the log, those above are the same for the whole builder. The
roots of the trees, in the order of their names, are the leaves of one more tree.

Defined results: nulls in any column are part of a leaf; a tree of a null name comes first; rows
without a key come first in their tree, rows of equal keys follow by digest and rows equal in both
are leaves each; a lone leaf is its tree's root; an empty table has an empty log and no proofs;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketwise.llm.numbering import numbered
from basketwise.session import materialise

#: Levels of a builder.
BITS = 10
PROOF = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
NODE = "tree string, total long, low int, block long, level int, index long, position long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def before(leaf: int) -> int:
    """How many nodes are complete before a leaf comes: those of all whole subtrees to its left."""
    return 2 * leaf - leaf.bit_count()


def subtree_size(level: int, index: int, total: int) -> int:
    """The nodes below and at a node of a tree of `total` leaves."""
    if (index + 1) << level <= total:
        return (2 << level) - 1
    return sum(min((index + 1) << (level - j), -(-total >> j)) - (index << (level - j)) for j in range(level + 1))


def position(level: int, index: int, total: int) -> int:
    """The place of a node in the postorder of its tree."""
    return before(index << level) + subtree_size(level, index, total) - 1


def height(total: int) -> int:
    return max(total - 1, 0).bit_length()


def siblings(level: int, index: int, total: int, top: int) -> Iterator[tuple[bool, int | None]]:
    """From a node up to a level: whether the other node of its run stands left, and its position, if there is one."""
    while level < top:
        other = index ^ 1
        yield other < index, position(level, other, total) if other < -(-total >> level) else None
        level, index = level + 1, index >> 1


def joined(own: str, left: bool, other: str | None) -> str:
    """The digest of a run of nodes that holds `own`."""
    return digest(own if other is None else other + own if left else own + other)


def _building(low: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        tree, total, block = (rows[name][0].as_py() for name in ("tree", "total", "block"))
        level, first, nodes = low, rows["index"][0].as_py(), rows["digest"].to_pylist()
        done = [(position(0, first + k, total), 0, first + k, d) for k, d in enumerate(nodes)] if low == 0 else []
        while level < min(low + bits, height(total)):
            nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
            level, first = level + 1, first >> 1
            done += [(position(level, first + k, total), level, first + k, d) for k, d in enumerate(nodes)]
        # Postorder is the order in which nodes are completed.
        done.sort()
        places, levels, indexes, digests = zip(*done, strict=True) if done else ((),) * 4
        n = len(done)
        return pa.table(
            {
                "tree": pa.array([tree] * n, pa.string()), "total": pa.array([total] * n, pa.int64()),
                "low": pa.array([low] * n, pa.int32()), "block": pa.array([block] * n, pa.int64()),
                "level": pa.array(levels, pa.int32()), "index": pa.array(indexes, pa.int64()),
                "position": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.string()),
            }
        )

    return work


def build(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """The log of nodes (tree, total, low, block, level, index, position, digest) over leaves (tree, total, index, digest).

    One round per tier of builders, so log2(leaves) / bits rounds; each is written.
    """
    tallest = height(leaves.agg(F.max("total")).first()[0] or 0)
    tops, log, low = leaves, None, 0
    while True:
        dealt = tops.select("tree", "total", "index", "digest", F.shiftright("index", bits).alias("block"))
        tier = materialise(dealt.groupBy("tree", "block").applyInArrow(_building(low, bits), NODE), "log")
        log = tier if log is None else log.union(tier)
        low += bits
        if low >= tallest:
            return log
        tops = tier.where((F.col("level") == low) & (F.col("total") > 1 << low))


def roots(log: DataFrame) -> DataFrame:
    """(tree, total, digest) of the last node of every tree."""
    last = (F.col("index") == 0) & (F.expr("shiftleft(1L, level)") >= F.col("total"))
    return log.where(last).select("tree", "total", "digest")


def _asking(bits: int | None):
    """Positions of the siblings above the builders' tops, or above the leaves themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree, total, index in zip(batch["tree"], batch["total"].tolist(), batch["index"].tolist(), strict=True):
                level = min(bits or 0, height(total))
                for rank, (left, place) in enumerate(siblings(level, index, total, height(total))):
                    rows.append((tree, total, index, rank, left, place))
            yield pd.DataFrame(rows, columns=["tree", "total", "index", "rank", "left", "position"]).astype({"position": "Int64"})

    return run


def paths(log: DataFrame, nodes: DataFrame, bits: int | None = None) -> DataFrame:
    """(tree, index, path) of nodes (tree, total, index): their siblings (rank, left, digest) up to the root, read from the log.

    The nodes are leaves, or the tops of builders of `bits` levels. A path has as many parts as the tree has levels.
    """
    asked = nodes.select("tree", "total", "index").mapInPandas(
        _asking(bits), "tree string, total long, index long, rank int, left boolean, position long"
    )
    found = asked.join(log.select("tree", "position", "digest"), ["tree", "position"], "left")
    part = F.struct("rank", "left", "digest")
    held = found.groupBy("tree", "index").agg(F.array_sort(F.collect_list(part)).alias("path"))
    empty = F.array().cast("array<struct<rank:int,left:boolean,digest:string>>")
    return nodes.join(held, ["tree", "index"], "left").withColumn("path", F.coalesce("path", empty))


def _proving(bits: int):
    def work(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({name: pa.array([], f.type) for name, f in zip(PROOF, [rows["key"], *[rows["digest"]] * 5], strict=True)})
        total, at, above, root, subroot = rows["total"][0].as_py(), {}, [], None, None
        for place, node, path, top, tree_top in zip(
            *(nodes[name].to_pylist() for name in ("position", "digest", "path", "root", "subroot")), strict=True
        ):
            if place is None:
                above, root, subroot = [(p["left"], p["digest"]) for p in path], top, tree_top
            else:
                at[place] = node
        levels, proofs, folded = min(bits, height(total)), [], []
        for index, own, altered in zip(*(rows[name].to_pylist() for name in ("index", "digest", "altered")), strict=True):
            near = [(left, None if place is None else at[place]) for left, place in siblings(0, index, total, levels)]
            own, others = altered or own, []
            for left, other in near + above:
                own = joined(own, left, other)
                others.append(other or "")
            proofs.append(digest("".join(others)))
            folded.append(own)
        columns = [rows["key"], rows["digest"], *(pa.array([x] * len(rows), pa.string()) for x in (subroot, root))]
        return pa.table([*columns, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], PROOF)

    return work


@dataclass(frozen=True)
class Manifest:
    """Numbered leaves (key, tree, digest, altered, total, index), the log of the trees, the trees in order, the log over them."""

    leaves: DataFrame
    log: DataFrame
    trees: DataFrame
    top: DataFrame


def manifest(leaves: DataFrame, key: str, tree: str, bits: int = BITS) -> Manifest:
    """The manifest of rows (key, tree, digest, altered)."""
    # A null name sorts before all others, names by their bytes.
    name = F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit(""))
    placed = numbered(leaves.select(F.col(key).alias("key"), name.alias("tree"), "digest", "altered"), "tree", "key", "digest")
    placed = materialise(placed, "leaves")
    log = build(placed, bits)
    named = roots(log).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    trees = materialise(numbered(named, "tree", "name"), "trees")
    return Manifest(placed, log, trees, build(trees, bits))


def proofs(made: Manifest, key: str, bits: int = BITS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of every leaf of a manifest.

    The siblings are read from the logs; folded_root starts from `altered` where that is not null.
    """
    upper = paths(made.top, made.trees).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper"))
    upper = materialise(upper.withColumn("root", roots(made.top).select("digest").scalar()), "tree-paths")
    tops = made.leaves.where(F.col("index") % (1 << bits) == 0).select("tree", "total", F.shiftright("index", bits).alias("index"))
    lower = paths(made.log, tops, bits).join(upper, "tree")
    nulls = [F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("digest")]
    whole = lower.select("tree", F.col("index").alias("block"), *nulls, F.concat("path", "upper").alias("path"), "root", "subroot")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema.fields[4:]]
    nodes = made.log.where("low = 0").select("tree", "block", "position", "digest", *none).union(whole)
    rows = made.leaves.withColumn("block", F.shiftright("index", bits))
    schema = f"key {made.leaves.schema['key'].dataType.simpleString()}, " + ", ".join(f"{name} string" for name in PROOF[1:])
    proven = rows.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInArrow(_proving(bits), schema)
    return proven.withColumnRenamed("key", key)


def leaf(*values: Column) -> Column:
    """The digest of values: `-` for a null, else the length in bytes, `:`, the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)
