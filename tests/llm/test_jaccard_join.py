import random
import re

import pytest

from __spark_entry__ import SMALL
from basketwise.llm import jaccard_join
from basketwise.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            small, large = sorted((len(a), len(b)))
            if small and 100 * small >= 80 * large and 100 * (k := len(a & b)) >= 80 * (len(a) + len(b) - k):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        known = [x for x in (least.get(root(i)), key) if x is not None]
        least[root(i)] = min(known, default=None)
    return sorted(((k, len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(frame, **options).collect()), key=repr)


def test_small_tables_agree_with_all_pairs(spark, tables):
    got = sorted((tuple(r) for r in QUERIES["op9_count_vector_jaccard"](spark, SMALL).collect()), key=repr)
    assert got == brute([(d["doc_id"], d["text"]) for d in tables["documents"]])


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [400_000, 3_000])
def test_large_families_and_shared_passages(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "LAST", 200)
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for n, length, edits in ((60, 120, 5), (40, 40, 2), (3, 300, 9), (12, 9, 1)):
        texts += family(rng, [word() for _ in range(length)], n, edits)
    passage = " ".join(word() for _ in range(30))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(3, 12)))}" for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [texts[5]] * 20 + ["same"] * 9 + ["same same"] * 3
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert joined(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É a b c d"), (8, "é a b c d"),
        (None, "null id null id null"), (None, "null id null id null"), (9, "one"), (9, "one"), (9, "other text"),
        (10, long), (11, long + " more"), (12, "a b c d e"), (13, "a b c d e"),
    ]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, []) == []


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a b", 6, "y")], "doc_id long, text string, n int, node string")
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(frame).collect()) == [(1, 1, 1), (2, 1, 1)]
    kept = jaccard_join.representatives(frame).collect()
    first = frame.where("doc_id = 1").select(jaccard_join.row_hash(frame["doc_id"], frame["text"])).first()[0]
    assert [r["row"] for r in kept] == [first]


def test_size_bound_is_rigorous():
    for a in range(1, 60):
        for b in range(1, 60):
            least = jaccard_join.needed(a, b, (80, 100))
            assert all((100 * k >= 80 * (a + b - k)) == (k >= least) for k in range(min(a, b) + 1))
