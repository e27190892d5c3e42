"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Training texts are read into postings (term, document, position). Of every window of a benchmark
item the two terms that are rarest in the training texts are looked up; their positions, less their
places in the item, must agree on where the item would begin. Only such alignments are followed up
with the item's other terms. A window occurs where all its words stand in a row.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Ties between
equally rare terms go to the smaller term.

Defined results: a null text has no words, an item without words no window; a row without an id is
followed by its text; repeated rows are reported each; items that repeat an id count once; empty
tables leave no hits; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.llm.common import ascii_lower
from basketwise.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, d, h, words): d and h together stand for a row's id and text, also where the id is null."""
    return documents.select(
        F.col(key).alias("id"),
        F.xxhash64(F.col(key)).alias("d"),
        F.xxhash64(F.col(key), F.col(text)).alias("h"),
        words_of(F.col(text)).alias("words"),
    )


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, n, p, term): the words of every distinct item with their places."""
    named = items.select(F.col(key).cast("string").alias("item_id"), words_of(F.col(text)).alias("words")).distinct()
    return named.select("item_id", F.xxhash64("item_id", "words").alias("item"), F.size("words").alias("n"), F.posexplode("words").alias("p", "term"))


def term_counts(documents: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """How often each of the given terms occurs in all texts; counted in the tasks first."""
    found = documents.select(F.explode(words_of(F.col(text))).alias("term")).join(terms, "term")
    return found.groupBy("term").agg(F.count("*").alias("df"))


def anchors(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, p1, p2, t1, t2): the two rarest terms of each window whose terms all occur; with one word p2 is p1."""
    last = F.greatest(F.col("n") - window, F.lit(0))
    first = F.greatest(F.col("p") - window + 1, F.lit(0))
    in_windows = words.join(counts, "term").withColumn("start", F.explode(F.sequence(first, F.least(F.col("p"), last))))
    wide = in_windows.groupBy("item", "n", "start").agg(
        F.array_sort(F.collect_list(F.struct("df", "term", "p"))).alias("terms")
    ).where(F.size("terms") == F.least(F.col("n"), F.lit(window)))
    second = F.when(F.size("terms") > 1, F.col("terms")[1]).otherwise(F.col("terms")[0])
    return wide.select(
        "item", F.col("terms")[0]["p"].alias("p1"), second["p"].alias("p2"),
        F.col("terms")[0]["term"].alias("t1"), second["term"].alias("t2"),
    ).distinct()


def postings(documents: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of the given terms: (id, d, h, n_words, pos, term); every document also has a row without a term."""
    rows = _keyed(documents, key, text).select("id", "d", "h", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "term"))
    wanted = terms.select("term", F.lit(True).alias("wanted"))
    kept = rows.join(wanted, "term", "left").where("wanted OR pos = 0 OR pos IS NULL")
    # The first word stands for its document; where it is also wanted, it gives two rows.
    both = F.filter(
        F.array(
            F.when((F.col("pos") == 0) | F.col("pos").isNull(), F.struct(F.lit(None).cast("string").alias("term"), F.col("n_words").alias("n_words"))),
            F.when(F.col("wanted"), F.struct(F.col("term"), F.lit(None).cast("int").alias("n_words"))),
        ),
        lambda x: x.isNotNull(),
    )
    return kept.select("id", "d", "h", "pos", F.explode(both).alias("x")).select("id", "d", "h", "pos", "x.*")


def alignments(index: DataFrame, pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, h, item, begin): where both anchors of some window agree on the place of the item's first word.

    The places met at an alignment are paired with those less than a window further on; these
    pairs are looked up among the item's anchors. Most alignments meet one place only and end
    there, and no item's windows are gone through for a hit, so items may be of any length.
    """
    alone = F.col("p1") == F.col("p2")
    places = pairs.select("item", F.col("p1").alias("p"), F.col("t1").alias("term"), alone.alias("alone")).union(
        pairs.select("item", "p2", "t2", alone)
    ).distinct()
    hits = index.where("term IS NOT NULL").join(places, "term").select("d", "h", "item", (F.col("pos") - F.col("p")).alias("begin"), "p", "alone")
    met = hits.groupBy("d", "h", "item", "begin").agg(F.array_sort(F.collect_set("p")).alias("ps"), F.max("alone").alias("alone"))

    def further(p: Column, place: Column) -> Column:
        following = F.slice("ps", place + 1, window)
        close = F.filter(following, lambda q: (q - p < window) & ((q > p) | F.col("alone")))
        return F.transform(close, lambda q: F.struct(p.alias("low"), q.alias("high")))

    both = met.where((F.size("ps") > 1) | F.col("alone")).withColumn("pair", F.explode(F.flatten(F.transform("ps", further))))
    anchored = pairs.select("item", F.least("p1", "p2").alias("low"), F.greatest("p1", "p2").alias("high")).distinct()
    found = both.select("d", "h", "item", "begin", "pair.low", "pair.high").join(anchored, ["item", "low", "high"], "left_semi")
    return found.select("d", "h", "item", "begin").distinct()


def occurrences(documents: DataFrame, words: DataFrame, found: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """(d, h, item, begin, p): the item's words that stand in whole windows of an alignment."""
    some = found.select("h").distinct()
    # Only documents with an alignment are read into words again.
    keyed = documents.withColumn("__h", F.xxhash64(F.col(key), F.col(text))).join(some.withColumnRenamed("h", "__h"), "__h", "left_semi")
    tokens = _keyed(keyed, key, text).select("d", "h", F.posexplode("words").alias("pos", "term")).distinct()
    wanted = found.join(words.select("item", "n", "p", "term"), "item").withColumn("pos", F.col("begin") + F.col("p"))
    equal = wanted.join(tokens, ["d", "h", "pos", "term"]).select("d", "h", "item", "begin", "n", "p")
    along = Window.partitionBy("d", "h", "item", "begin").orderBy("p")
    runs = equal.withColumn("run", F.col("p") - F.row_number().over(along))
    long = Window.partitionBy("d", "h", "item", "begin", "run")
    whole = runs.withColumn("row_words", F.count("*").over(long)).where(F.col("row_words") >= F.least(F.col("n"), F.lit(window)))
    return whole.select("d", "h", "item", "begin", "p")


def contaminated(
    documents: DataFrame, items: DataFrame, window: int = WINDOW,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, row, n_words, n_hit, n_items, items) of every document; items are the sorted ids whose windows occur.

    row is a hash of id and text that tells rows apart where ids are null or repeated.
    """
    words = materialise(item_words(items, item_key, item_text), "item-words")
    counts = materialise(term_counts(documents, words.select("term").distinct(), text), "term-counts")
    pairs = materialise(anchors(words, counts, window), "anchors")
    rare = pairs.select(F.col("t1").alias("term")).union(pairs.select("t2")).distinct()
    index = materialise(postings(documents, rare, key, text), "postings")
    found = materialise(alignments(index, pairs, window), "alignments")
    hits = materialise(occurrences(documents, words, found, window, key, text), "occurrences")
    n_hit = hits.select("d", "h", (F.col("begin") + F.col("p")).alias("pos")).distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    ids = words.select("item", F.coalesce("item_id", F.lit("")).alias("item_id")).distinct()
    names = hits.select("d", "h", "item").distinct().join(ids, "item").groupBy("d", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    seen = n_hit.join(names, ["d", "h"])
    rows = index.where("term IS NULL").select("id", "d", "h", F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(seen, ["d", "h"], "left").select(
        F.col("id").alias(key), F.col("h").alias("row"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
    )


def near(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Proximity matches: (d, h, item, p1, p2, first, last) where both anchors of a window stand within a distance, in any order.

    Positions are dealt into stretches of the distance, so only neighbouring ones are compared.
    """
    listed = index.where("term IS NOT NULL").select("d", "h", "pos", "term")
    ones = listed.join(pairs, listed["term"] == pairs["t1"]).select("d", "h", "item", "p1", "p2", F.col("pos").alias("a"))
    twos = listed.join(pairs, listed["term"] == pairs["t2"]).select("d", "h", "item", "p1", "p2", F.col("pos").alias("b"))
    stretch = F.floor(F.col("a") / distance)
    ones = ones.withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    twos = twos.withColumn("stretch", F.floor(F.col("b") / distance))
    met = ones.join(twos, ["d", "h", "item", "p1", "p2", "stretch"])
    return met.where(F.abs(F.col("a") - F.col("b")) <= distance).select(
        "d", "h", "item", "p1", "p2", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("last")
    )
