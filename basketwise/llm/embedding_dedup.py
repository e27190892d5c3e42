"""Near-duplicate vectors: int8 tile products with rigorous bounds, full precision where they leave doubt.

Equal vectors are taken together first. Each class is scaled to length 1 and written as u = s q + e
with int8 components q. For two classes |u.v - s s' q.q'| <= |e| + |e'| + |e||e'|, because |v| = 1
and |s q| <= 1 + |e|. Tiles of classes are multiplied with each other once; a pair whose upper bound
is below the threshold is no link, one whose lower bound reaches it is one, and only the pairs
between are computed in double precision. A tile product counts links per vector and keeps a spanning
forest of them, so that large groups do not put out all their pairs.

The number of products is that of all pairs of tiles: no bound by groups is rigorous for vectors
that spread in all directions.

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinite component links
with nothing; vectors of different lengths do not link; repeated rows are vectors that link;
an empty table gives no rows; a group without any id has a null component; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from basketwise.llm.common import components, in_cells, spread
from basketwise.session import materialise

THRESHOLD = 0.95
TILE = 4096
STRIP = 1024
#: More than the rounding of sums of doubles can change.
SLACK = 1e-12


def _packing(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for vector in batch["v"]:
                x = None if vector is None else np.asarray(vector, dtype=np.float64)
                fine = x is not None and len(x) and np.isfinite(x).all() and x.any()
                data.append(np.asarray(vector, dtype=kind).tobytes() if fine else None)
            yield pd.DataFrame({"id": batch["id"], "data": data})

    return run


def unit(data: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(d, dtype=kind) for d in data]).astype(np.float64)
    # Scaling by the largest component first keeps squares from over- and underflowing.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, and length of the error of each unit vector."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = u - scale[:, None] * q
    return q, scale, np.sqrt((error * error).sum(1)) + SLACK


def tile_links(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that link between two tiles of (unit vectors, q, scale, error)."""
    (u, qu, su, eu), (v, qv, sv, ev) = left, right
    # Products of int8 are whole numbers, exact in float32 as long as their sums stay below 2 ** 24.
    exact = np.float32 if 127 * 127 * u.shape[1] < 1 << 24 else np.float64
    columns = qv.T.astype(exact)
    widest = float(ev.max())
    for a in range(0, len(u), STRIP):
        b = min(a + STRIP, len(u))
        product = (qu[a:b].astype(exact) @ columns) * sv.astype(exact)
        # A first cut with the widest error; its own rounding is far below the added 1e-5.
        least = (threshold - eu[a:b] - widest * (1 + eu[a:b]) - 1e-5) / su[a:b]
        i, j = np.nonzero(product >= least[:, None].astype(exact))
        if same:
            i, j = i[j > i + a], j[j > i + a]
        i = i + a
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            estimate = su[x] * sv[y] * np.einsum("ij,ij->i", qu[x].astype(np.int32), qv[y].astype(np.int32))
            bound = eu[x] + ev[y] + eu[x] * ev[y]
            sure = estimate - bound >= threshold
            doubt = ~sure & (estimate + bound >= threshold)
            sure[doubt] = np.einsum("ij,ij->i", u[x[doubt]], v[y[doubt]]) >= threshold
            yield x[sure], y[sure]


def _comparing(kind: str, threshold: float):
    def tile(row) -> tuple:
        nodes, weights = np.frombuffer(row.nodes, "<i8"), np.frombuffer(row.weights, "<i8")
        width = len(row.data) // len(nodes)
        u = unit([row.data[k * width : (k + 1) * width] for k in range(len(nodes))], kind)
        return nodes, weights, (u, *quantised(u))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [tile(row) for row in rows.sort_values("side").itertuples()]
        same = len(sides) == 1
        (na, wa, left), (nb, wb, right) = sides[0], sides[-1]
        counts = [np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)]
        ids = na if same else np.concatenate([na, nb])
        label = np.arange(len(ids))
        for x, y in tile_links(left, right, threshold, same):
            np.add.at(counts[0], x, wb[y])
            np.add.at(counts[0] if same else counts[1], y, wa[x])
            spread(label, x, y if same else y + len(na))
        joined = np.nonzero(label != np.arange(len(ids)))[0]
        out = list(zip([1] * len(joined), ids[joined].tolist(), ids[label[joined]].tolist(), strict=True))
        for nodes, count in zip((na, nb)[: 1 if same else 2], counts, strict=False):
            some = count.nonzero()[0]
            out += zip([0] * len(some), nodes[some].tolist(), count[some].tolist(), strict=True)
        return pd.DataFrame(out, columns=["kind", "a", "b"])

    return work


def _tiled(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "dim": rows["dim"].iloc[:1], "tile": rows["tile"].iloc[:1],
            "nodes": [rows["node"].to_numpy("<i8").tobytes()], "weights": [rows["n"].to_numpy("<i8").tobytes()],
            "data": [b"".join(rows["data"])],
        }
    )


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    id_type = vectors.schema[key].dataType.simpleString()
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    plain = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    packed = plain.mapInPandas(_packing(kind), f"id {id_type}, data binary")
    rows = materialise(packed.withColumn("hash", F.md5("data")), "vectors")
    classes = rows.where("data IS NOT NULL").groupBy("hash").agg(
        F.first("data").alias("data"), F.count("*").alias("n"), F.min("id").alias("least")
    )
    classes = materialise(classes.select("hash", F.xxhash64("hash").alias("node"), F.octet_length("data").alias("dim"), "data", "n", "least"), "classes")
    tiles = max(1, -(-classes.count() // tile))
    dealt = classes.withColumn("tile", F.pmod("node", F.lit(tiles)).cast("int")).select("dim", "tile", "node", "n", "data")
    blocks = dealt.groupBy("dim", "tile").applyInPandas(_tiled, "dim int, tile int, nodes binary, weights binary, data binary")
    # Each pair of tiles is one cell; a tile is sent once to each of its cells.
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    first, second = F.least("tile", "other"), F.greatest("tile", "other")
    cell = F.concat_ws("-", "dim", first, second)
    paired = blocks.withColumn("other", other).select(cell.alias("cell"), (F.col("tile") > F.col("other")).alias("side"), "nodes", "weights", "data")
    cells = tiles * (tiles + 1) // 2
    parts = max(-(-cells // 8), min(cells, 2 * spark.sparkContext.defaultParallelism))
    paired = paired.repartition(parts, "cell").sortWithinPartitions("cell")
    found = materialise(paired.mapInPandas(in_cells("cell", _comparing(kind, threshold)), "kind int, a long, b long"), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select("a", "b"))
    named = classes.select("hash", "node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named.join(links, "node", "left"), "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("hash", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # Vectors that link with nothing have a key of their own, so that they spread.
    alone = F.concat_ws("-", F.lit("alone"), F.col("id").cast("string"))
    component = F.when(F.col("data").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.withColumn("hash", F.coalesce("hash", alone)).join(named, "hash", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
