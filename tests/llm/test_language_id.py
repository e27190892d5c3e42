import itertools
import random

import numpy as np

from __spark_entry__ import SMALL
from basketwise.llm import language_id
from basketwise.llm.queries import QUERIES


def test_held_out_accuracy(spark, tables):
    rows = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, SMALL).collect()}
    lang = {d["doc_id"]: d["lang"] for d in tables["documents"]}
    assert set(rows) == set(lang)
    held = [k for k, r in rows.items() if r["held_out"]]
    right = sum(rows[k]["lang_pred"] == lang[k] for k in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows.values())


def test_viterbi_agrees_with_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k, switch = rng.integers(1, 7), rng.integers(1, 4), float(rng.choice([0.5, 2.0, 5.0]))
        scores = rng.normal(size=(1, n, k)).astype(np.float32)
        value = lambda p: sum(scores[0, t, x] for t, x in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(k), repeat=n)))
        path = language_id.viterbi(scores, np.array([n]), switch)[0]
        assert abs(value(path) - best) < 1e-4


TEXTS = [
    ("en", "the cat and the dog went to the house with the children and their friends"),
    ("es", "el gato y el perro fueron a la casa con los niños y sus amigos del barrio"),
    ("ru", "кошка и собака пошли в дом вместе с детьми и их друзьями из города"),
]


def model(spark):
    rows = [(k, lang, f"{text} {k}") for k in range(8) for lang, text in TEXTS]
    return language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_spans_of_mixed_text_and_scripts(spark):
    mixed = f"{TEXTS[0][1]} {TEXTS[1][1]} {TEXTS[2][1]}"
    frame = spark.createDataFrame([(1, mixed), (2, "Дом КОШКА"), (3, "12 % --"), (4, None), (5, ""), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.label(frame, model(spark)).collect()}
    spans = [(s["lang"], s["words"]) for s in got[1]["spans"]]
    assert [lang for lang, _ in spans] == ["en", "es", "ru"]
    assert all(abs(n - len(text.split())) <= 1 for (_, n), (_, text) in zip(spans, TEXTS, strict=True))
    assert got[2]["lang_pred"] == "ru" and got[2]["score"] == 1
    assert all((got[k]["lang_pred"], got[k]["score"], got[k]["spans"]) == ("und", 0, []) for k in (3, 4, 5))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    nothing = language_id.learn(empty)
    frame = spark.createDataFrame([(1, "some text", "x"), (None, "other", "y")], "doc_id long, text string, lang_pred string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.label(frame, nothing).collect()} == {("und", 0.0)}
    assert language_id.label(frame.limit(0), model(spark)).count() == 0
    long = spark.createDataFrame([(1, "the cat and the dog " * 20_000), (2, "a" * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.label(long, model(spark), spans=False).collect()}
    assert got[1] == "en" and got[2] in ("en", "es")


UNSPACED = [
    ("en", "the cat and the dog went to the house with the children and their friends"),
    ("zh", "小猫和小狗跟孩子们以及他们的朋友一起去了城里的房子然后又回到了学校"),
    ("ja", "ねこといぬはこどもたちとともだちといっしょにまちのいえへいきました学校にもどりました"),
    ("th", "แมวและสุนัขไปบ้านในเมืองกับเด็กและเพื่อนของพวกเขาแล้วกลับโรงเรียน"),
]


def test_words_are_cut_where_the_script_changes():
    cut = language_id.words_of
    assert cut("hola niño — 12%") == ["hola", "niño", "—", "12%"]
    assert cut("кошка-cat дом") == ["кошка", "-cat", "дом"]
    assert cut("abc中文字符很长def") == ["abc", "中文字符", "很长", "def"]
    assert cut("") == [] and cut("。。。 😀") == ["。。。", "😀"]
    long = "中" * 100_001 + "x" * 100_000
    assert len(cut(long)) == 25_002 and "".join(cut(long)) == long


def test_spans_in_scripts_without_spaces(spark):
    rows = [(k, lang, text) for k in range(8) for lang, text in UNSPACED]
    known = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    texts = dict(UNSPACED)
    mixed = texts["zh"] + texts["en"] + texts["th"]
    frame = spark.createDataFrame([(1, mixed), (2, texts["ja"]), (3, texts["zh"] * 400)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.label(frame, known).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["zh", "en", "th"]
    assert got[2]["lang_pred"] == "ja" and got[3]["lang_pred"] == "zh" and got[3]["score"] == 1
    at = [s["first_word"] for s in got[1]["spans"]] + [len(language_id.words_of(mixed))]
    spelled = ["".join(language_id.words_of(mixed)[a:b]) for a, b in itertools.pairwise(at)]
    assert spelled == [texts["zh"], texts["en"].replace(" ", ""), texts["th"]]


def plainly(model, text, switch):
    """Language and score by loops: one word, one language at a time, the best path by its definition."""
    words = language_id.words_of(text)
    buckets, n = model.weights.shape[1] - 1, len(model.langs)
    scores, letters = [], []
    for word in words:
        table, _ = language_id.grams([word.lower()], buckets)
        sums = [sum(float(model.weights[k][g]) for g in table.ravel()) for k in range(n)]
        script = language_id.script_of(word)
        allowed = [script >= 0 and bool(model.scripts[k, script]) for k in range(n)]
        if any(allowed):
            sums = [x if a else -np.inf for x, a in zip(sums, allowed, strict=True)]
        scores.append([max(x - max(sums), -language_id.WORST) if script >= 0 else 0.0 for x in sums])
        letters.append(sum(c.isalpha() for c in word))
    if not sum(letters):
        return "und", 0.0
    # Best value of a path that ends in each language, and the path itself; of equal ones that which stays, then the first language.
    ends = [(scores[0][k], (k,)) for k in range(n)]
    for row in scores[1:]:
        reached = [[(v - switch * (p[-1] != k), p) for v, p in ends] for k in range(n)]
        best = [max(came, key=lambda c: (round(c[0], 3), c[1][-1] == k, -c[1][-1])) for k, came in enumerate(reached)]  # noqa: B023
        ends = [(v + row[k], (*p, k)) for k, (v, p) in enumerate(best)]
    path = max(ends, key=lambda e: (round(e[0], 3), -e[1][-1]))[1]
    share = [sum(c for c, x in zip(letters, path, strict=True) if x == k) for k in range(n)]
    top = max(range(n), key=lambda k: share[k])
    return model.langs[top], share[top] / sum(letters)


def test_labels_agree_with_a_plain_version(spark):
    rows = [(k, lang, text) for k in range(4) for lang, text in TEXTS + UNSPACED[1:]]
    known = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    rng = random.Random(4)
    pool = [w for _, text in TEXTS + UNSPACED[1:] for w in language_id.words_of(text)] + ["Zebra", "12", "--", "Ελλάδα", "xyz中x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.label(frame, known, switch=3.0, spans=False).collect()}
    want = {k: plainly(known, text, 3.0) for k, text in enumerate(texts)}
    same = [k for k in want if got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9]
    assert len(same) == len(texts), [(texts[k], got[k], want[k]) for k in want if k not in same][:3]
