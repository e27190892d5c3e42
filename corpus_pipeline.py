"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Language ID drops what has no language, the Jaccard join keeps one document of each group,
decontamination drops documents with benchmark passages, personal data is replaced, and what is left
is packed into token sequences. All but the last return the columns of `documents`.

Defined results: rows are kept or dropped whole; a null id is an id of its own to the joins; a null
text has no language and goes, unless no row has a language at all; of rows that repeat an id and a text one stays after the Jaccard join;
an empty table stays empty; further columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.llm import contamination, jaccard_join, language_id, packing, pii
from basketwise.llm.common import ship, table
from basketwise.llm.queries import PII_KEY
from basketwise.session import materialise

#: Words of a document that may stand in benchmark passages.
HIT_WORDS = 0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language, whatever its share; all of them where no row has a language to learn from."""
    columns = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    renamed = docs.withColumnsRenamed(columns)
    model = language_id.learn(docs)
    if not model.langs:
        return docs
    labelled = language_id.label(renamed, model, columns["text"], tuple(columns.values()), spans=False)
    kept = labelled.where(F.col("lang_pred") != "und")
    return kept.select(*(F.col(short).alias(name) for name, short in columns.items()))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every group that shingles link."""
    return _only(docs, jaccard_join.representatives(docs)).transform(_once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    marked = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, marked.where(F.col("n_hit") <= HIT_WORDS).select("row"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY)
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens."""
    return packing.pack(materialise(packing.pieces(docs), "pieces"))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose hash of id and text is among the kept rows."""
    rows = kept.select(F.col("row").alias("kept row"))
    return docs.join(rows, jaccard_join.row_hash(docs["doc_id"], docs["text"]) == rows["kept row"], "left_semi")


def _once(docs: DataFrame) -> DataFrame:
    """One of the rows that repeat an id and a text. Only rows of repeated ids are moved."""
    again = docs.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    if again.isEmpty():
        return docs
    same = docs["doc_id"].eqNullSafe(again["again"])
    return docs.join(again, same, "left_anti").union(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _shipped(stage):
    """Sees to it that the workers of whichever session runs a stage have the package."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language ID", _shipped(identify_language)),
    ("n-gram Jaccard join", _shipped(keep_one_of_each_group)),
    ("benchmark decontamination", _shipped(decontaminate)),
    ("personal data", _shipped(replace_personal_data)),
    ("best-fit packing", _shipped(pack)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
