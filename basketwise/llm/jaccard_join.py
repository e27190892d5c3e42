"""Jaccard join of documents on word shingles through R-trees over count vectors.

A document is the set of its 5-word shingles, hashed to 64 bits; equal sets are one class. The
shingles of a set are hashed into groups, and the counts by group are a point: the overlap of two
sets is at most the sum over the groups of the smaller count. Larger sets have more groups; a point
is folded to the groups of a smaller one. An R-tree over points bounds the overlap of two nodes by
the sum of the smaller of their upper corners, so that pairs of nodes, then pairs of points, fall
away; what survives is verified on the shingles themselves.

In many dimensions boxes around unlike points overlap, so a tree over all documents would prune
little. Classes are therefore dealt into cells first, without loss: sets that are alike to 0.8 share
a shingle among the first fifth of each in any common order. The order is by hash, with the
shingles that most texts share last. Classes that begin with the same shingle form a cell, and the
points of a cell are joined by R-trees. Cells around very common shingles are put together where
they meet and cut into tiles. The pairs of points that survive connect classes; only these groups
fetch their texts, are cut into tiles by size, and are joined by R-trees once more, now with every
survivor verified. Both joins put out a spanning forest of what they find, never all pairs.

Defined results: a null text, an empty one and one without words have an empty set and link with
nothing; a text of fewer words than a shingle is one shingle of its own kind; repeated rows and
equal texts are one class; a component without any id is null; an empty table gives no rows; other
columns are not looked at. Shingles and sets are told apart by 64-bit hashes (sets also by size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from basketwise.llm.common import components, in_cells, spread
from basketwise.session import materialise

SHINGLE = 5
#: Overlap over union, as a fraction of whole numbers.
SIMILAR = (80, 100)
#: Fewest groups of a point, shingles per group at most, and classes in a leaf of a tree.
GROUPS, PER_GROUP, LEAF = 64, 8, 32
#: Shingles a task holds at once; of each such block the commonest, from a least count on, are reported.
BLOCK, REPORTED, COMMON = 400_000, 16_384, 3
#: The commonest shingles of all texts that go last in the order: a fixed bound of what is broadcast.
LAST = 131_072
#: Prefix shingles per bucket; classes that give pairs at once; classes of a cell that is one task's work;
#: classes and shingles per tile of larger ones.
BUCKET, FEW, CELL, PART, TILE = 300_000, 8, 512, 1024, 400_000

#: Bits that say which rows are fetched: a fixed size of what is broadcast.
BITS = 1 << 23

#: Bytes of words whose hashes a task keeps.
_BYTES_KEPT = 4 << 20


class Shingler:
    """Hashes of words are kept, within a bound, because texts repeat them."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.words: dict[bytes, int] = {}
        self.held = 0
        rng = np.random.default_rng(20_240_101)
        self.factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a text, sorted."""
        listed = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not listed:
            return np.empty(0, np.uint64)
        known = self.words
        if self.held > _BYTES_KEPT:
            known.clear()
            self.held = 0
        for w in set(listed):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
                self.held += len(w)
        codes = np.fromiter(map(known.__getitem__, listed), dtype=np.uint64, count=len(listed))
        n = max(1, len(codes) - self.size + 1)
        with np.errstate(over="ignore"):
            total = np.full(n, min(len(codes), self.size), dtype=np.uint64)
            for k in range(min(self.size, len(codes))):
                total += codes[k : k + n] * self.factors[k]
            total ^= total >> np.uint64(31)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(29)
        total.sort()
        return total[np.append(True, total[1:] != total[:-1])]


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts by group; the groups are as many as keep their counts small, a power of two."""
    groups = GROUPS
    while groups * PER_GROUP < len(hashes):
        groups *= 2
    while True:
        counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts brought to fewer groups."""
    return points.reshape(len(points), -1, groups).sum(1, dtype=np.int32)


def needed(a, b, similar: tuple[int, int]):
    """The least overlap of sets of these sizes that are alike enough."""
    p, q = similar
    return -((-p * (a + b)) // (p + q))


def prefix_length(n: int, similar: tuple[int, int]) -> int:
    p, q = similar
    return n + (-p * n) // q + 1


def _describing(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, total = Shingler(size), [], 0

        def common(like: pa.DataType) -> Iterator[pa.RecordBatch]:
            if held:
                flat = np.concatenate(held)
                held.clear()
                flat.sort()
                begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                tokens, counts = flat[begin], np.diff(np.append(begin, len(flat)))
                some = np.nonzero(counts >= COMMON)[0]
                some = some[np.argsort(-counts[some], kind="stable")][:REPORTED]
                yield out(1, pa.nulls(len(some), like), pa.nulls(len(some), pa.int64()), counts[some], tokens[some].view(np.int64), None)

        def out(kind: int, ids: pa.Array, rows: pa.Array, n, nodes, points) -> pa.RecordBatch:
            kinds = pa.array(np.full(len(ids), kind, np.int32))
            points = pa.nulls(len(ids), pa.binary()) if points is None else pa.array(points, pa.binary())
            columns = [kinds, ids, rows, pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), points]
            return pa.RecordBatch.from_arrays(columns, ["kind", "id", "row", "n", "node", "point"])

        like = pa.int64()
        for batch in batches:
            ids, rows, texts = batch.columns
            like = ids.type
            ns, nodes, points = [], [], []
            for text in texts:
                found = shingler.hashes(text.as_py())
                ns.append(len(found))
                nodes.append(set_key(found) if len(found) else None)
                points.append(point(found).tobytes() if len(found) else None)
                held.append(found)
                total += len(found)
                if total > BLOCK:
                    yield from common(like)
                    total = 0
            yield out(0, ids, rows, ns, nodes, points)
        yield from common(like)

    return run


def _beginning(size: int, similar: tuple[int, int], last: np.ndarray, weights: np.ndarray, buckets: int):
    """Prefix shingles by bucket; equal sets of a block count once.

    A common shingle is spread over several buckets in proportion to its count.
    """

    def parts(values: np.ndarray, cut: np.ndarray) -> pa.Array:
        """The stretches of values between cuts, as bytes; they share the memory of the values."""
        offsets = (np.append(cut, len(values)) * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def out(tokens: list, nodes: list, sizes: list) -> pa.RecordBatch:
        lengths = [len(k) for k in tokens]
        t, x = np.concatenate(tokens), np.repeat(np.array(nodes, dtype=np.int64), lengths)
        n = np.repeat(np.array(sizes, dtype=np.uint32), lengths)
        tokens.clear()
        spread = np.ones(len(t), dtype=np.uint64)
        place = np.searchsorted(last, t)
        place[place == len(last)] = 0
        if len(last):
            hit = last[place] == t
            spread[hit] = np.uint64(1) + (weights[place[hit]] // (BUCKET // 4)).astype(np.uint64)
        with np.errstate(over="ignore"):
            bucket = ((t >> np.uint64(7)) + (x.view(np.uint64) % spread) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        columns = [pa.array(bucket[cut]), *(parts(values[order], cut) for values in (t, x, n))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "tokens", "nodes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        tokens, nodes, sizes, seen, total = [], [], [], set(), 0
        for batch in batches:
            for text in batch.column(0):
                found = shingler.hashes(text.as_py())
                if not len(found) or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                length = prefix_length(len(found), similar)
                place = np.searchsorted(last, found)
                place[place == len(last)] = 0
                late = last[place] == found if len(last) else np.zeros(len(found), bool)
                rest = found[~late]
                if len(rest) < length:
                    rest = np.concatenate([rest, found[late]])
                tokens.append(rest[:length])
                nodes.append(key)
                sizes.append(len(found))
                total += length
                if total > BLOCK:
                    yield out(tokens, nodes, sizes)
                    tokens, nodes, sizes, seen, total = [], [], [], set(), 0
        if tokens:
            yield out(tokens, nodes, sizes)

    return run


def _meeting(similar: tuple[int, int], last: np.ndarray):
    """Pairs of classes around a rare shingle (kind 0), or the classes around a common one (kind 1)."""
    p, q = similar

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.frombuffer(b"".join(rows["tokens"]), "<u8")
        x = np.frombuffer(b"".join(rows["nodes"]), "<i8")
        n = np.frombuffer(b"".join(rows["sizes"]), "<u4").astype(np.int64)
        order = np.lexsort((x, t))
        t, x, n = t[order], x[order], n[order]
        fresh = np.append(True, (t[1:] != t[:-1]) | (x[1:] != x[:-1]))
        t, x, n = t[fresh], x[fresh], n[fresh]
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        run = np.diff(np.append(begin, len(t)))
        place = np.searchsorted(last, t[begin])
        place[place == len(last)] = 0
        late = last[place] == t[begin] if len(last) else np.zeros(len(begin), bool)
        pairs = []
        few = ~late & (run >= 2) & (run <= FEW)
        for k in range(1, FEW):
            for j in range(k):
                at = begin[few & (run > k)]
                a, b = at + j, at + k
                alike = (q * n[a] >= p * n[b]) & (q * n[b] >= p * n[a])
                pairs.append(np.stack([x[a[alike]], x[b[alike]]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        many = np.repeat(late | (run > FEW), run)
        return pd.DataFrame(
            {
                "kind": np.append(np.zeros(len(pairs), np.int32), np.ones(many.sum(), np.int32)),
                "x": np.append(pairs[:, 0], t[many].view(np.int64)), "y": np.append(pairs[:, 1], x[many]),
            }
        )

    return work


def _possible(similar: tuple[int, int]):
    """Keeps the pairs whose points allow enough overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b, want in zip(batch["xp"], batch["yp"], needed(batch["xn"], batch["yn"], similar), strict=True):
                a, b = np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None]
                groups = min(a.shape[1], b.shape[1])
                keep.append(np.minimum(folded(a, groups), folded(b, groups)).sum() >= want)
            yield batch.loc[keep, ["x", "y"]].rename(columns={"x": "a", "y": "b"})

    return run


class Tree:
    """A packed R-tree of one level over points: leaves of neighbouring points and their upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> None:
        # Points are laid out by size, then by their heaviest groups, so that like ones share a leaf.
        heavy = points[:, :8].argmax(1)
        order = np.lexsort((points[:, 0], heavy, np.floor(np.log(np.maximum(sizes, 1)) * 8)))
        self.points, self.sizes = points, sizes
        self.leaves = [order[k : k + leaf] for k in range(0, len(order), leaf)]
        self.corner = np.stack([points[leaf].max(0) for leaf in self.leaves])
        self.least = np.array([sizes[leaf].min() for leaf in self.leaves])

    def survivors(self, other: Tree, similar: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places whose points allow enough overlap, by pairs of leaves whose corners do."""
        for k, leaf in enumerate(self.leaves):
            bound = np.minimum(self.corner[k], other.corner).sum(1)
            for m in np.flatnonzero(bound >= needed(self.least[k], other.least, similar)):
                if other is self and m < k:
                    continue
                right = other.leaves[m]
                least = needed(self.sizes[leaf][:, None], other.sizes[right][None, :], similar)
                i, j = np.nonzero(np.minimum(self.points[leaf][:, None, :], other.points[right][None, :, :]).sum(2) >= least)
                i, j = leaf[i], right[j]
                if other is self and m == k:
                    i, j = i[i < j], j[i < j]
                yield i, j


def _survivors(points: list[np.ndarray], n: np.ndarray, sides: np.ndarray, similar: tuple[int, int]) -> Iterator[tuple]:
    """Pairs of places of a cell that survive their points. Sides 0 and 1 meet each other, side 2 itself."""
    p, q = similar
    kinds = sorted({(int(side), len(x)) for side, x in zip(sides, points, strict=True)})
    length = np.array([len(x) for x in points])
    held = {kind: np.flatnonzero((sides == kind[0]) & (length == kind[1])) for kind in kinds}
    grids = {kind: np.stack([points[k] for k in held[kind]]) for kind in kinds}
    for x, a in enumerate(kinds):
        for b in kinds[x:]:
            meets = a[0] == b[0] == 2 or {a[0], b[0]} == {0, 1}
            apart = q * n[held[a]].max(initial=0) < p * n[held[b]].min() or q * n[held[b]].max(initial=0) < p * n[held[a]].min()
            if not meets or apart:
                continue
            groups = min(a[1], b[1])
            left = Tree(folded(grids[a], groups), n[held[a]])
            right = left if a == b else Tree(folded(grids[b], groups), n[held[b]])
            for i, j in left.survivors(right, similar):
                yield held[a][i], held[b][j]


def _pointing(similar: tuple[int, int]):
    """(a, b) of a spanning forest of the pairs of a cell that survive their points."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        points = [np.frombuffer(x, np.uint8) for x in rows["point"]]
        nodes, label = rows["node"].to_numpy(), np.arange(len(rows))
        for i, j in _survivors(points, rows["n"].to_numpy(), rows["side"].to_numpy(), similar):
            spread(label, i, j)
        joined = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": nodes[joined], "b": nodes[label[joined]]})

    return work


def _verifying(size: int, similar: tuple[int, int]):
    """(a, b) of a spanning forest of the links of each cell, of rows sorted by cell.

    A text is hashed as it comes and let go, so that only the hashes of one cell are in memory.
    """

    def work(nodes: list, sides: list, sets: list) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets])
        label, out = np.arange(len(sets)), []
        for left, right in _survivors([point(s) for s in sets], n, np.array(sides), similar):
            new = label[left] != label[right]
            for a, b in zip(left[new].tolist(), right[new].tolist(), strict=True):
                if label[a] == label[b]:
                    continue
                small, large = (sets[a], sets[b]) if n[a] <= n[b] else (sets[b], sets[a])
                place = np.searchsorted(large, small)
                place[place == len(large)] = 0
                if (large[place] == small).sum() >= needed(n[a], n[b], similar):
                    out.append((nodes[a], nodes[b]))
                    label[label == label[b]] = label[a]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        cell, nodes, sides, sets = None, [], [], []
        for batch in batches:
            for row in zip(*(batch.column(name) for name in ("cell", "node", "side", "text")), strict=True):
                here, node, side = (x.as_py() for x in row[:3])
                if here != cell:
                    if len(sets) > 1:
                        yield work(nodes, sides, sets)
                    cell, nodes, sides, sets = here, [], [], []
                found = shingler.hashes(row[3].as_py())
                # A fetched row may be another text under the same hash.
                if len(found) and set_key(found) == node:
                    nodes.append(node)
                    sides.append(side)
                    sets.append(found)
        if len(sets) > 1:
            yield work(nodes, sides, sets)

    return run


def _tiles(links: DataFrame, classes: DataFrame, similar: tuple[int, int], parts: Column) -> DataFrame:
    """(cell, side, node) of the tiles of the groups that links (a, b) connect.

    Within a group classes are put into bands of size, so that sets alike enough are in one band or
    in neighbours, and large bands into parts of bounded size. Each part meets itself, the other
    parts of its band, and the parts of the next band.
    """
    cells = components(links)
    step = float(np.log(similar[1] / similar[0]))
    rows = classes.select("node", "n").join(cells, "node").withColumn("band", F.floor(F.log("n") / step + 1e-9))
    rows = materialise(rows, "cells")
    counted = rows.groupBy("root", "band").agg(F.ceil(parts).cast("int").alias("parts"), F.count("*").alias("members"))
    after = counted.select("root", (F.col("band") - 1).alias("band"), F.col("parts").alias("next_parts"))
    before = counted.select("root", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_before"))
    sized = counted.join(after, ["root", "band"], "left").join(before, ["root", "band"], "left")
    alone = (F.col("members") == 1) & F.col("next_parts").isNull() & F.col("parts_before").isNull()
    dealt = rows.join(sized.where(~alone), ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    name = lambda a_band, a, b_band, b: F.concat_ws("-", F.lit("t"), "root", a_band, a, b_band, b)
    band, part = F.col("band"), F.col("part")
    empty = F.array().cast("array<int>")

    def others(count: Column) -> Column:
        return F.when(count.isNull() | (count < 1), empty).otherwise(F.sequence(F.lit(0), count - 1))

    own = F.array(F.struct(name(band, part, band, part).alias("cell"), F.lit(2).alias("side")))
    across = F.transform(
        F.filter(others(F.col("parts")), lambda o: o != part),
        lambda o: F.struct(name(band, F.least(part, o), band, F.greatest(part, o)).alias("cell"), (part > o).cast("int").alias("side")),
    )
    up = F.transform(others(F.col("next_parts")), lambda o: F.struct(name(band, part, band + 1, o).alias("cell"), F.lit(0).alias("side")))
    down = F.transform(others(F.col("parts_before")), lambda o: F.struct(name(band - 1, o, band, part).alias("cell"), F.lit(1).alias("side")))
    placed = dealt.select("node", F.explode(F.concat(own, across, up, down)).alias("at"))
    return placed.select("at.cell", "at.side", "node")


def classes_and_links(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: tuple[int, int] = SIMILAR
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, row, n, node) of every row, (node, n, least, ...) of every class, and links (a, b) that connect the classes."""
    id_type = documents.schema[key].dataType.simpleString()
    plain = documents.select(F.col(key).alias("id"), row_hash(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    described = plain.mapInArrow(_describing(size), f"kind int, id {id_type}, row long, n long, node long, point binary")
    described = materialise(described, "sets")
    rows = described.where("kind = 0").select("id", "row", "n", "node", "point")
    classes = rows.where("node IS NOT NULL").groupBy("node", "n").agg(F.min("id").alias("least"), F.first("point").alias("point"))
    classes = materialise(classes, "classes")
    order = described.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(LAST).toPandas()
    last = order["node"].to_numpy(np.int64).view(np.uint64)
    by_token = np.argsort(last)
    last, weights = last[by_token], order["n"].to_numpy(np.int64)[by_token]
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, int(total * (similar[1] - similar[0]) // similar[1] // BUCKET))
    begun = plain.select("text").mapInArrow(
        _beginning(size, similar, last, weights, buckets), "bucket long, tokens binary, nodes binary, sizes binary"
    )
    begun = begun.repartition(min(buckets, 4096), "bucket").sortWithinPartitions("bucket")
    met = materialise(begun.mapInPandas(in_cells("bucket", _meeting(similar, last)), "kind int, x long, y long"), "meetings")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"{name}n"), F.col("point").alias(f"{name}p"))

    pairs = met.where("kind = 0").select("x", "y").distinct().join(side("x"), "x").join(side("y"), "y")
    near = pairs.mapInPandas(_possible(similar), "a long, b long")
    near = materialise(near.union(_near_in_cells(met.where("kind = 1").select("x", "y"), classes, similar)), "near")
    members = _tiles(near, classes, similar, F.sum("n") / TILE)
    # A class is fetched through one of its rows.
    carrier = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"))
    wanted = materialise(members.join(carrier, "node"), "members")
    # Texts are read once per class, not once per cell.
    ids = materialise(wanted.select("row", "node").distinct(), "wanted")
    texts = _maybe(plain.select("row", "text"), ids).join(ids, "row")
    texts = materialise(texts.dropDuplicates(["row"]).select("node", "text"), "texts")
    verified = _by_cell(wanted.select("cell", "side", "node").join(texts, "node"))
    links = materialise(verified.mapInArrow(_verifying(size, similar), "a long, b long"), "links")
    return rows, classes, links


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Drops most rows whose `row` is not wanted, before their texts are moved.

    A table of BITS bits says which hashes are wanted; rows that share a bit with one get through
    and fall away in the join that follows.
    """
    slot = F.pmod("row", F.lit(BITS))
    word, bit = F.floor(slot / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(row, {BITS}) % 64 AS INT))")
    some = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = rows.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("word")).join(some, "word", "left")
    # As many words as the table has, whatever the data.
    table = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("t"))
    bits = F.get(table.select(F.transform("t", lambda w: w["bits"])).scalar(), word)
    return rows.where(bits.bitwiseAND(bit) != 0)


def _by_cell(rows: DataFrame) -> DataFrame:
    parts = max(64, rows.sparkSession.sparkContext.defaultParallelism * 4)
    return rows.repartition(parts, "cell").sortWithinPartitions("cell")


def _near_in_cells(around: DataFrame, classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect the classes around common shingles whose points allow enough overlap.

    Shingles with the same classes around them are one cell. Cells of more than a task's work are put
    together where they meet, and cut into tiles.
    """
    around = materialise(around.distinct(), "around")
    members = around.groupBy("x").agg(F.count("*").alias("k"), F.sum(F.xxhash64("y").cast("decimal(20,0)")).alias("who")).where("k > 1")
    cells = members.groupBy("k", "who").agg(F.min("x").alias("x")).select("x", "k")
    rows = materialise(around.join(cells, "x"), "cell-rows")
    small = rows.where(F.col("k") <= CELL).select(F.concat_ws("-", F.lit("r"), "x").alias("cell"), F.lit(2).alias("side"), F.col("y").alias("node"))
    large = rows.where(F.col("k") > CELL).select(F.col("x").alias("a"), F.col("y").alias("b"))
    tiles = _tiles(large, classes, similar, F.count("*") / PART)
    pointed = small.union(tiles).join(classes.select("node", "n", "point"), "node")
    return _by_cell(pointed).mapInPandas(in_cells("cell", _pointing(similar)), "a long, b long")


def _joined(documents: DataFrame, key: str, text: str, size: int, similar: tuple[int, int]) -> DataFrame:
    """(id, row, n, root, component_id) of every row; root tells components apart, also where ids are null."""
    rows, classes, links = classes_and_links(documents, key, text, size, similar)
    roots = classes.select("node", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = materialise(roots, "roots")
    lowest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(lowest, "root").select("node", "root", "component_id")
    # Rows without a set have a key of their own, so that they spread.
    joined = rows.withColumn("node", F.coalesce("node", "row")).join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select("id", "row", "n", F.coalesce("root", "row").alias("root"), component.alias("component_id"))


def row_hash(key: Column, text: Column) -> Column:
    """Tells rows apart by id and text, also where one is null."""
    return F.xxhash64(key, text)


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest id that links reach, itself included."""
    joined = _joined(documents, key, text, size, similar)
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def representatives(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """(row) of the one row that stays of each component, by `row_hash`: that of the smallest id, nulls last."""
    joined = _joined(documents, key, text, size, similar)
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    return joined.groupBy("root").agg(first.alias("first")).select("first.row")
