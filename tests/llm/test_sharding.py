import zlib

from __spark_entry__ import SMALL
from basketwise.llm import sharding
from basketwise.llm.queries import QUERIES


def test_small_table(spark, tables):
    rows = QUERIES["op2_slot_sharding"](spark, SMALL).collect()
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in tables["documents"]}
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    sums, places = {}, {}
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(len(t) + 16 for t in texts.values())
    assert max(sums.values()) <= max(1.02 * sum(sums.values()) / 40, largest + 16)


def test_map_versions(spark, tmp_path):
    loads = {s: 1000 + 37 * (s % 11) + (5000 if s < 30 else 0) for s in range(512)}
    first = sharding.even_map(8, 512)
    second = sharding.rebalance(first, loads, 8)
    third = sharding.grow(second, loads, 8)
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == second
    assert sharding.load_map(spark, str(tmp_path / "map")) == third

    def totals(m, n):
        return [sum(loads[s] for s, k in enumerate(m.shard_of) if k == shard) for shard in range(n)]

    assert max(totals(second, 8)) - min(totals(second, 8)) <= 0.002 * sum(loads.values()) / 8
    # A new shard takes slots only into itself, and as much as the others keep.
    assert all(a == b or b == 8 for a, b in zip(second.shard_of, third.shard_of, strict=True))
    grown = totals(third, 9)
    assert max(grown) - min(grown) <= 0.05 * sum(grown) / 9


def test_edges(spark, tmp_path):
    rows = [(None, "a", 1), (None, None, 2), (1, None, 3), (1, None, 3), (2, "", 4), (3, "é" * 100_000, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = sharding.shard(frame, "doc_id", "text", 3, str(tmp_path / "a")).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 16, 16, 17, 200_016]
    assert {(r["shard"], r["slot"]) for r in got} and len({(r["shard"], r["slot"]) for r in got}) == 6
    assert sharding.shard(frame.limit(0), "doc_id", "text", 3, str(tmp_path / "b")).count() == 0


def test_a_frequent_key_or_text_spreads(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("if(id < 10000, 5, if(id < 20000, null, id)) AS doc_id", "if(id < 15000, 'equal text', concat('t', id)) AS text")
    got = sharding.shard(rows, "doc_id", "text", 20, str(tmp_path / "hot")).collect()
    loads, slots = {}, {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots[r["virtual_slot"]] = slots.get(r["virtual_slot"], 0) + 1
    assert len(got) == 30_000 and max(loads.values()) < 1.01 * sum(loads.values()) / 20
    assert max(slots.values()) < 25 and len({(r["shard"], r["slot"]) for r in got}) == 30_000
