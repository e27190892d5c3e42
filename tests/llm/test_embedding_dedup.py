import math

import numpy as np
import pytest

from __spark_entry__ import SMALL
from basketwise.llm import embedding_dedup
from basketwise.llm.queries import QUERIES


def brute(rows, threshold=0.95):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = [np.array(v, dtype=float) if usable(v) else None for _, v in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        known = [x for x in (least.get(root(i)), key) if x is not None]
        least[root(i)] = min(known, default=None)
    return sorted(((k, links[i], least[root(i)], k == least[root(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def found(spark, rows, kind="float", **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame, **options).collect()), key=repr)


def test_small_table_agrees_with_all_pairs(spark, tables):
    got = sorted((tuple(r) for r in QUERIES["op3_int8_embedding_dedup"](spark, SMALL).collect()), key=repr)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in tables["embeddings"]])


@pytest.mark.parametrize("tile", [4096, 40])
def test_groups_near_the_threshold(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for scale in (0.2, 0.3, 0.33, 0.36):
        base = rng.normal(size=16)
        base /= np.linalg.norm(base)
        rows += [base + rng.normal(size=16) * scale / 4 for _ in range(40)]
    rows += [rng.normal(size=16) for _ in range(60)]
    rows += [rows[3]] * 30
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]
    assert found(spark, rows, tile=tile) == brute([(i, v) for i, v in rows])


def test_edges(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e290]),
        (11, [1e-300, 0.0]), (12, [-1.0, 0.0]), (13, [19.0, math.sqrt(39.0)]),
    ]
    got = {r[0]: r for r in found(spark, rows, "double")}
    assert all(got[k][1:] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 12))
    assert {got[k][1] for k in (7, 8)} == {5} and got[10][2] == got[11][2] == 7
    assert got[None][1:3] == (0, None)
    assert found(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(300, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = embedding_dedup.quantised(u)
    estimate = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s
    assert (np.abs(estimate - u @ u.T) <= e[:, None] + e + e[:, None] * e).all()
