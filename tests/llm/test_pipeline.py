"""Each stage against a plain version of what it decides, on the small documents."""

import corpus_pipeline
from __spark_entry__ import SMALL
from basketwise.llm import pii
from basketwise.session import materialise

from . import test_contamination, test_jaccard_join, test_packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_decide_as_plain_versions_do(spark, tables):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, _on(spark, stage, docs, SMALL)
        got[name] = (before, docs)
    kept = lambda name: {r["doc_id"]: r["text"] for r in got[name][1].collect()}
    given = lambda name: [(r["doc_id"], r["text"]) for r in got[name][0].collect()]
    assert set(kept("language ID")) == {d["doc_id"] for d in tables["documents"] if any(map(str.isalpha, d["text"] or ""))}
    groups = test_jaccard_join.brute(given("n-gram Jaccard join"))
    assert set(kept("n-gram Jaccard join")) == {c for _, _, c in groups}
    items = [(b["item_id"], b["text"]) for b in tables["benchmark"]]
    clean = {k for k, _, n_hit, _, _ in test_contamination.brute(given("benchmark decontamination"), items, 10) if not n_hit}
    assert set(kept("benchmark decontamination")) == clean
    before, after = dict(given("personal data")), kept("personal data")
    assert set(before) == set(after)
    for _, frame in list(got.values())[:-1]:
        assert frame.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    rows = got["best-fit packing"][1].collect()
    lengths = {k: len(test_packing.packing.token_ids(t)) for k, t in after.items()}
    test_packing.check_places(rows, lengths, 2048)


def test_edges(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", None, None), (None, "another text in english words", None, "s", 1),
        (None, text, "en", "s", 2), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "12 34", "en", "s", 5),
        (6, "mail me at bob.smith@mail.example.com please", "en", "s", 44),
    ]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = _on(spark, stage, docs, str(tmp_path))
    out = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in docs.collect())
    assert [k for k, _, _ in out] == [0, 1, 6] and "bob.smith" not in out[2][1] and out[2][2] == len(out[2][1])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3


def _on(spark, stage, docs, folder):
    return materialise(stage(spark, docs, folder), "stage")


def test_extra_columns_pass_through(spark):
    frame = spark.createDataFrame([(1, "some text of words", "en", "s", 5, "r", 9)], COLUMNS + ", row string, score int")
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = _on(spark, stage, frame, SMALL)
    assert frame.columns == [*[c.split()[0] for c in COLUMNS.split(", ")], "row", "score"] and frame.count() == 1
    assert pii.pseudonymise(frame, "k").columns == frame.columns


def test_mixed_texts_and_tables_without_languages_stay(spark):
    parts = {
        "en": "the weather is fine today and the children are playing outside in the garden",
        "de": "das wetter ist heute schön und die kinder spielen draußen im garten",
        "fr": "le temps est beau aujourd'hui et les enfants jouent dehors dans le jardin",
        "es": "el tiempo es bueno hoy y los niños juegan fuera en el jardín",
    }
    rows = [(k, text, lang, "s", 5) for k, (lang, text) in enumerate(parts.items())]
    rows += [(10, " ".join(parts.values()), None, "s", 5), (11, "12 34", None, "s", 5), (12, None, None, "s", 0)]
    frame = spark.createDataFrame(rows, COLUMNS)
    stage = dict(corpus_pipeline.STAGES)["language ID"]
    assert sorted(r["doc_id"] for r in stage(spark, frame, SMALL).collect()) == [0, 1, 2, 3, 10]
    unlabelled = frame.withColumn("lang", frame["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang", "source", "n_chars")
    assert sorted(r["doc_id"] for r in stage(spark, unlabelled, SMALL).collect()) == [0, 1, 2, 3, 10, 11, 12]
