"""Logs, positions and proofs against a plain tree, level by level."""

import hashlib
import zlib

import pytest

from __spark_entry__ import SMALL
from basketwise.llm import merkle
from basketwise.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def leaf(doc, more=0):
    values = [doc["doc_id"], doc["source"], doc["lang"], None if doc["n_chars"] is None else doc["n_chars"] + more, doc["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(docs):
    """{doc_id: the expected row} of documents with distinct ids."""
    trees = {}
    for doc in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"])):
        trees.setdefault(doc["lang"], []).append(doc)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {n: levels([leaf(d) for d in trees[n]]) for n in names}
    top = levels([built[n][-1][0] for n in names])
    out = {}
    for n in names:
        for k, doc in enumerate(trees[n]):
            steps = []
            for grid, index in ((built[n], k), (top, names.index(n))):
                for level in grid[:-1]:
                    steps.append((index & 1, level[index ^ 1] if index ^ 1 < len(level) else ""))
                    index >>= 1
            altered = doc["doc_id"] is not None and zlib.crc32(str(doc["doc_id"]).encode()) % 7 == 0
            own = leaf(doc, 1 if altered else 0)
            for right, other in steps:
                own = sha(other + own if right else own + other)
            proof = sha("".join(other for _, other in steps))
            root = top[-1][0]
            out[doc["doc_id"]] = (doc["doc_id"], leaf(doc), built[n][-1][0], root, proof, own, own == root)
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_small_table(spark, tables):
    rows = QUERIES["op11_postorder_merkle_log"](spark, SMALL).select(*COLUMNS).collect()
    want = plain(tables["documents"])
    assert len(rows) == len(tables["documents"]) and {r["doc_id"]: tuple(r) for r in rows} == want
    assert 0 < sum(not r["verified"] for r in rows) < len(rows) / 4


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 100])
def test_positions_are_the_order_of_completion(total):
    order = []

    def walk(level, index):
        for child in (2 * index, 2 * index + 1) if level else ():
            if child < -(-total >> (level - 1)):
                walk(level - 1, child)
        order.append((level, index))

    walk(merkle.height(total), 0)
    assert [merkle.position(level, index, total) for level, index in order] == list(range(len(order)))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string, index int")


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_tiers_of_small_builders(spark, tmp_path, bits):
    docs = [{"doc_id": k, "text": f"t{k}", "lang": [None, "a", "b", "é"][min(k % 7, 3)], "source": "s", "n_chars": k} for k in range(83)]
    frame = documents(spark, [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "x", 1) for d in docs])
    leaves = frame.select("doc_id", "lang", merkle.leaf(*(frame[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("digest"))
    made = merkle.manifest(leaves.selectExpr("*", "cast(null AS string) AS altered"), "doc_id", "lang", bits)
    # The log of every tree is its nodes in postorder, without gaps.
    for tree, total in {(r["tree"], r["total"]) for r in made.leaves.collect()}:
        held = sorted(r["position"] for r in made.log.where(made.log["tree"] == tree).collect())
        assert held == list(range(merkle.position(merkle.height(total), 0, total) + 1))
    got = {r["doc_id"]: tuple(r) for r in merkle.proofs(made, "doc_id", bits).collect()}
    want = plain(docs)
    assert {k: v[:5] for k, v in got.items()} == {k: v[:5] for k, v in want.items()}
    assert all(v[5] == v[3] for v in got.values())


def test_edges(spark, tmp_path):
    rows = [
        (None, None, None, None, None, "t", 1), (None, "a", None, "s", 1, "t", 1), (1, "", "en", None, None, "t", 1),
        (1, "", "en", None, None, "t", 1), (2, "é" * 100_000, "en", "s", 5, "t", 1), (3, "x", "", "s", 2, "t", 1),
    ]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_postorder_merkle_log"](spark, str(tmp_path)).collect()
    assert len(got) == 6 and len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 3
    # A tampered row without n_chars stays as it is.
    assert all(r["verified"] for r in got if r["doc_id"] in (None, 1))
    lone = next(r for r in got if r["doc_id"] == 3)
    assert lone["leaf"] == lone["subroot"]
    documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op11_postorder_merkle_log"](spark, str(tmp_path / "none")).count() == 0
    hot = documents(spark, [(7, "same", "en", "s", 1, "t", 1)] * 300 + [(k, "t", "en", "s", 1, "t", 1) for k in range(20)])
    hot.write.parquet(str(tmp_path / "hot" / "documents.parquet"))
    got = QUERIES["op11_postorder_merkle_log"](spark, str(tmp_path / "hot")).collect()
    alike = leaf({"doc_id": 7, "source": "s", "lang": "en", "n_chars": 1, "text": "same"})
    others = [leaf({"doc_id": k, "source": "s", "lang": "en", "n_chars": 1, "text": "t"}) for k in range(20)]
    ordered = others[:7] + sorted([others[7], *[alike] * 300]) + others[8:]
    assert len(got) == 320 and {r["subroot"] for r in got} == {levels(ordered)[-1][0]}
