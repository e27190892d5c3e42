import numpy as np

from __spark_entry__ import SMALL
from basketwise.llm import quality
from basketwise.llm.queries import QUERIES


def test_scores_against_labels_that_were_not_used(spark, tables):
    rows = {r["doc_id"]: r for r in QUERIES["op8_weak_label_quality"](spark, SMALL).collect()}
    assert set(rows) == {d["doc_id"] for d in tables["documents"]}
    good = {r["doc_id"]: r["quality"] for r in tables["labels"] if r["doc_id"] in rows}
    right = {k: rows[k]["keep"] == bool(q) for k, q in good.items()}
    clean = [k for k, q in good.items() if q]
    assert sum(right.values()) >= 0.9 * len(right) and sum(right[k] for k in clean) >= 0.97 * len(clean)


def test_em_finds_the_accuracies(spark):
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.65])
    right = rng.random((len(truth), 5)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1)
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert np.abs(model.accuracy() - accuracy).max() < 0.03 and abs(model.good - 0.7) < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > ((votes.sum(1) > 0) == truth).mean()


def test_edges(spark):
    prose = "Some words of a plain text, of moderate length, stand in a row. They end here, more or less. " * 3
    rows = [(n, prose + f"And line {n}.", "x") for n in range(30)] + [(100 + n, "BUY!! NOW!! " * 40 + str(n), "x") for n in range(10)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "word " * 50_000, "x"), (None, prose, "x"), (1, prose + "And line 1.", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    voted = quality.voted(frame)
    assert voted.count() == len(rows)
    model, scorer = quality.train(frame, voted, sample=40)
    got = quality.score(frame, scorer).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert min(scores[n] for n in range(30)) > 0.5 > max(scores[100 + n] for n in range(10))
    empty = frame.limit(0)
    model, scorer = quality.train(empty, quality.voted(empty))
    assert model is None and quality.score(empty, scorer).count() == 0


PROSE = "Some words of a plain text, of moderate length, stand in a row. They end here, more or less. " * 3
JUNK = "BUY!! NOW!! %% $$ " * 40


def trained(spark, counted, **options):
    """The training's models and what its scorer was given, for texts with their numbers of rows."""
    frame = spark.createDataFrame(list(enumerate(counted)), "k long, x struct<text:string,n:int>")
    frame = frame.selectExpr("explode(sequence(1, x.n)) AS i", "k", "x.text AS text").selectExpr("k * 1000000 + i AS doc_id", "text")
    given = {}
    plain = quality.fit_scorer

    def fit(places, shares, goal, dimensions, *rest, **more):
        given.update(rows=len(places), goal=goal, weight=rest[0] if rest else None)
        return plain(places, shares, goal, dimensions, *rest, **more)

    quality.fit_scorer = fit
    try:
        model, scorer = quality.train(frame, quality.voted(frame), **options)
    finally:
        quality.fit_scorer = plain
    return frame, scorer, given


def test_few_distinct_texts_of_many_rows_train_the_scorer(spark):
    counted = [(PROSE + f"And line {n}.", 500) for n in range(5)] + [(JUNK + str(n), 500) for n in range(3)]
    frame, scorer, given = trained(spark, counted, sample=40)
    assert given["rows"] == 8 and scorer.weights.any()
    scores = {r["doc_id"]: r["score"] for r in quality.score(frame.where("doc_id % 1000000 = 1"), scorer).collect()}
    assert all((scores[n * 1_000_000 + 1] > 0.5) == (n < 5) for n in range(8))


def test_a_text_of_a_third_of_all_rows_weighs_a_third(spark):
    """Whichever its hash, the copies take one place and weigh what they are."""
    for hot in range(4):
        counted = [(PROSE + f"Hot {hot}.", 1000)] + [(PROSE + f"And line {n}.", 1) for n in range(1000)] + [(JUNK + str(n), 1) for n in range(1000)]
        _, scorer, given = trained(spark, counted, sample=200)
        weight = given["weight"] / given["weight"].sum()
        assert given["rows"] == 200 and abs(weight.max() - 1 / 3) < 0.07 and np.sort(weight)[-2] < 0.01
        assert 0.2 < weight @ (given["goal"] < 0.5) < 0.47


def test_texts_without_spaces_count_to_their_end(spark):
    features = quality.Features(quality.DIMENSIONS)
    head = "中文文本" * 16
    for tail in ("。，%" * 50, "Ab9" * 100, "#" * 5000 + "x1" * 40):
        for text in (head, "f00dF" * 13):
            plain, longer = (dict(zip(*map(list, features.of(t)), strict=True)) for t in (text, text + tail))
            assert plain != longer and len(longer) > 2
    a, b = (features.of("a" * 64 + end) for end in ("b7-" * 40, "B?7" * 40))
    assert list(a[0]) != list(b[0])
    clean = "这是一个关于天气的普通句子，今天下雨，明天会晴。" * 30
    assert -1 not in quality.votes(clean) and -1 not in quality.votes("\n".join(clean[k:] for k in range(4)))
    # Short texts stay bad by length, long runs of letters with case by the lengths of their words.
    assert quality.votes("好。")[5] == quality.votes("two words")[5] == quality.votes("a b c d")[5] == quality.votes("=" * 500)[5] == -1
    assert quality.votes("dGhpcyBpcyBub3Qg" * 40)[6] == -1
    rows = [(n, PROSE + f"And line {n}.") for n in range(30)] + [(100 + n, JUNK + str(n)) for n in range(10)]
    rows += [(200, "a" * 64), (201, "a" * 64 + "!%$A" * 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    _, scorer = quality.train(frame.where("doc_id < 200"), quality.voted(frame.where("doc_id < 200")))
    scores = {r["doc_id"]: r["score"] for r in quality.score(frame, scorer).collect()}
    assert scores[200] != scores[201]
