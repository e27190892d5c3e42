"""Nodes against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMALL
from basketwise.llm import conversation_trie as ct
from basketwise.llm.queries import QUERIES
from basketwise.session import materialise


def plain(sequences):
    """Rows of {conversation: ((turn, code points), ...)}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (node[-1][1] if node else 0)
        parts = [below[c] for c in children[node]]
        below[node] = (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), *below[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    own = {conv: [(t[2:], len(t[3])) for t in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = tuple(own.get(conv - conv % 100, [])[:h] + turns[h:])
    return out


def listed(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.select(*ct.OUT).collect())


def test_small_table(spark, tables):
    rows = [(c["conv_id"], c["turn"], c["role"], c["text"]) for c in tables["conversations"]]
    assert listed(QUERIES["op12_double_array_prefix_trie"](spark, SMALL)) == plain(rebuilt(rows))


def made(spark, sequences):
    rows = [(c, d + 1, t[0].encode(), t[1]) for c, turns in sequences.items() for d, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, depth long, id binary, chars long").withColumn("id", F.unhex(F.md5("id")))
    members = spark.createDataFrame([(c, len(t)) for c, t in sequences.items()], "conv long, length long")
    return materialise(members, "m"), materialise(turns, "t")


@pytest.mark.parametrize("shard, deal, long", [(7, 2, 5), (30, 1, 4096), (20, 3, 3), (100_000, 16, 4096)])
def test_shards_share_nodes(spark, shard, deal, long):
    rng = random.Random(shard)
    sequences = {}
    for c in range(120):
        start = sequences[rng.choice(list(sequences))][: rng.randrange(9)] if sequences and rng.random() < 0.7 else ()
        sequences[c * 3 - 30] = (*start, *((w := rng.choice("abcdef"), ord(w) - 90) for _ in range(rng.randrange(5))))
    # A third of all conversations are copies, and two long ones share nearly all.
    copy = tuple((f"x{k}", k) for k in range(6))
    sequences |= {1000 + c: copy for c in range(60)}
    sequences |= {2000: copy * 5 + (("end", 1),), 2001: copy * 5, 2002: copy * 2 + tuple((f"y{k}", 2) for k in range(20))}
    assert listed(ct.nodes(*made(spark, sequences), shard, deal, long)) == plain(sequences)


def test_double_array():
    rng = random.Random(5)
    sequences = sorted([rng.randrange(40) for _ in range(rng.randrange(7))] for _ in range(300))
    trie = ct.DoubleArray(sequences)
    paths = {tuple(s): trie.walk(s) for s in sequences}
    assert all(len(path) == len(s) + 1 for s, path in paths.items())
    prefixes = {s[:d] for s in paths for d in range(len(s) + 1)}
    assert len({tuple(path[: d + 1]) for s, path in paths.items() for d in range(len(path))}) == len(prefixes) == len(trie.order)
    assert len({path[d] for path in paths.values() for d in range(len(path))}) == len(prefixes)
    assert trie.walk([41, 1]) == [0]


def test_edges(spark, tmp_path):
    rows = [
        (None, 1, "user", "lost"), (100, None, None, None), (100, 1, "user", "b"), (100, 1, "user", "b"), (103, 2, "user", "é" * 100_000),
        (103, 0, "assistant", ""), (-5, 0, "user", "x"), (250, 0, "user", "no head"), (251, 7, "user", "🙂"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, depth int")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = listed(QUERIES["op12_double_array_prefix_trie"](spark, str(tmp_path)))
    # Spark's remainder of a negative id is negative: -5 belongs to 0.
    want = rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    own = [(("user", "x"), 1)]
    want[-5] = tuple(own[zlib.crc32(b"-5") % 6 :])
    assert got == plain(want)
    frame.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert listed(QUERIES["op12_double_array_prefix_trie"](spark, str(tmp_path / "none"))) == []
