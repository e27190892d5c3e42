import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from __spark_entry__ import SMALL
from basketwise.llm import packing
from basketwise.llm.queries import QUERIES


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_places(rows, lengths, limit):
    """All pieces of all documents are there, and every sequence is gapless from 0."""
    places = defaultdict(list)
    starts = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        starts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    for key, n in lengths.items():
        parts = sorted(starts[key])
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert [s for _, s, _ in parts] == [sum(x for _, _, x in parts[:k]) for k in range(len(parts))]
        assert sum(x for _, _, x in parts) == n
        assert len(parts) == 1 or all(x == limit for _, _, x in parts[1:])
    return len(places)


def test_small_table(spark, tables, exact):
    rows = QUERIES["op1_sum_of_squares_packing"](spark, SMALL).collect()
    ids = {d["doc_id"]: exact(d["text"]) for d in tables["documents"]}
    n = check_places(rows, {k: len(v) for k, v in ids.items()}, 2048)
    total = sum(map(len, ids.values()))
    assert n <= -(-total // 2048) + 2
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_edges_and_whole_sequences(spark, exact):
    texts = {1: None, 2: "", 3: "one two three", 4: "x y " * 40, 5: "<|endoftext|> \u3000 \u0e01 中文 🙂", 6: "\n\n  \t " * 30}
    rows = [(k, t, "extra") for k, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string")
    cut = packing.pieces(frame, limit=16, keep_ids=True)
    packed = packing.pack(cut, limit=16, group=3)
    got = packed.collect()
    check_places(got, {k: len(exact(t)) for k, t in texts.items()}, 16)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in got:
        ids = np.frombuffer(whole[r["sequence_id"]]["ids"], "<u4")
        assert ids[r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    assert packing.pack(packing.pieces(frame.limit(0))).count() == 0


def test_repeated_and_null_keys(spark):
    big = 2**60 + 1
    frame = spark.createDataFrame([(None, "a"), (None, "b"), (big, "c"), (big, "c")], "doc_id long, text string")
    got = packing.pack(packing.pieces(frame)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [big, big, None, None]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_both_readers_agree_on_every_character(exact):
    """All characters that take the faster reader, next to others of every class."""
    table = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000 and not packing._RARE.search(chr(c))]
    assert len(table) > 700
    for c in table:
        text = f"a{c}b {c} {c}{c}1{c}. {c}the\n{c}  {c}'s"
        assert packing.token_ids(text).tolist() == exact(text), repr(c)


def test_long_texts_agree(exact):
    for text in ("x" * 3000, "ab " * 4000, "é" * 2000, " " * 1000 + "a" + "\n" * 400, "aB3." * 1500):
        assert packing.token_ids(text).tolist() == exact(text)


def test_added_tokens_are_read_as_the_unaltered_tokenizer_reads_them():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = [token.content for token in plain.get_added_tokens_decoder().values()]
    assert added
    for token in added:
        for text in (f"end {token} x", token, f"a{token}{token}b", f"{token[:-1]} {token.upper()}", f"\u4e2d{token}\u3000 end"):
            assert packing.token_ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], text


def brute_sum_of_squares(lengths, limit):
    """Tries every gap and compares the whole sum."""
    gaps, bins, out = {}, 0, []
    for s in lengths:
        count = np.bincount([g for g in gaps.values() if g], minlength=limit + 1)
        best = None
        for g in sorted({g for g in gaps.values() if g >= s}):
            after = count.copy()
            after[g] -= 1
            after[g - s] += g > s
            score = (after.astype(int) ** 2).sum()
            if best is None or score < best[0]:
                best = (score, g)
        if best is None:
            gaps[bins] = limit - s
            out.append(limit)
            bins += 1
        else:
            b = next(b for b, g in gaps.items() if g == best[1])
            gaps[b] -= s
            out.append(best[1])
    return out, bins


def test_sum_of_squares_is_the_least_at_every_step():
    rng = np.random.default_rng(1)
    for limit in (10, 37):
        lengths = np.sort(rng.integers(1, limit + 1, 200))[::-1]
        bins, offsets = packing.sum_of_squares(lengths, limit)
        gaps, n = brute_sum_of_squares(lengths.tolist(), limit)
        assert (limit - offsets).tolist() == gaps and bins.max() + 1 == n


def test_equal_pieces_spread_over_the_groups(spark):
    from basketwise.session import materialise

    rows = spark.range(60_000).selectExpr("if(id < 20000, 7, id) AS doc_id", "0 AS piece", "0L AS start", "if(id < 20000, 100L, 1 + id % 400) AS length", "0L AS ids_crc32")
    packed = packing.pack(materialise(rows, "equal")).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(groups) == 8 and max(groups.values()) < 1.1 * 60_000 / 8
    least = -(-sum(r["length"] for r in packed) // 2048)
    assert len({r["sequence_id"] for r in packed}) <= least + len(groups)
