import random
import re

import pytest

from basketwise.llm import contamination
from basketwise.session import materialise


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items, window):
    out = []
    for key, text in documents:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            t = words(item)
            n = min(window, len(t))
            for i in range(len(t) - n + 1) if t else []:
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == t[i : i + n]:
                        hit |= set(range(j, j + n))
                        names.add("" if name is None else str(name))
        out.append((key, len(w), len(hit), len(names), sorted(names)))
    return sorted(out, key=repr)


def found(spark, documents, items, window):
    docs = spark.createDataFrame([(*d, "clash", 1) for d in documents], "doc_id long, text string, term string, pos int")
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, n int")
    got = contamination.contaminated(docs, bench, window).select("doc_id", "n_words", "n_hit", "n_items", "items")
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("window", [1, 2, 4])
def test_random_texts_agree_with_brute_force(spark, window):
    rng = random.Random(window)
    say = lambda n: " ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(n))
    items = [(k, say(rng.randint(0, 9))) for k in range(25)] + [(3, "aa bb cc dd"), (None, "ff ff ff ff ff")]
    documents = [(k, say(rng.randint(0, 30))) for k in range(60)]
    documents += [(100, items[7][1] + ". " + items[8][1].upper()), (101, "aa " * 200), (102, items[9][1])]
    assert found(spark, documents, items, window) == brute(documents, items, window)


def test_edges(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "É short"), (3, None), (4, ""), (5, "...")]
    long = "word " * 30_000 + "ONE, two; three four five six seven eight nine TEN eleven"
    documents = [
        (1, None), (2, ""), (3, "é short"), (4, "É-short"), (5, long), (5, long), (6, "one two three four five six seven eight nine"),
        (None, "xx É short yy"), (None, "none"), (7, "two three four five six seven eight nine ten eleven"),
    ]
    assert found(spark, documents, items, 10) == brute(documents, items, 10)
    assert found(spark, [], items, 10) == []
    assert found(spark, documents, [], 10) == brute(documents, [], 10)


def test_a_long_item_meets_a_long_text(spark):
    """Thousands of windows of one item, some of them in a text that repeats its words in other places."""
    say = [f"w{k % 40}x{k // 7}" for k in range(5000)]
    items = [(1, " ".join(say)), (2, " ".join(say[100:130]))]
    documents = [(1, " ".join(say[500:2500] + ["and"] + say[3000:3009])), (2, " ".join(reversed(say))), (3, " ".join(say))]
    w = {k: words(text) for k, text in documents}
    windows = {k: {tuple(words(text)[i : i + 10]) for i in range(len(words(text)) - 9)} for k, text in items}
    want = []
    for key, listed in w.items():
        at = {k: [j for j in range(len(listed) - 9) if tuple(listed[j : j + 10]) in windows[k]] for k in windows}
        hit = {j + x for places in at.values() for j in places for x in range(10)}
        names = [str(k) for k in sorted(at) if at[k]]
        want.append((key, len(listed), len(hit), len(names), names))
    assert found(spark, documents, items, 10) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "blue red"), (3, "red " + "x " * 9 + "blue"), (4, "red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red blue")], "item_id long, text string")
    listed = materialise(contamination.item_words(items, "item_id", "text"), "t")
    terms = listed.select("term").distinct()
    pairs = contamination.anchors(listed, contamination.term_counts(docs, terms, "text"), 10)
    index = materialise(contamination.postings(docs, terms), "t")
    near = contamination.near(index, pairs, 4).join(index.select("d", "id").distinct(), "d")
    assert sorted((r["id"], r["first"], r["last"]) for r in near.collect()) == [(1, 0, 3), (2, 0, 1)]
