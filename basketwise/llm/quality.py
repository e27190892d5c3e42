"""Quality classifier from weak labels: labellers, expectation-maximisation, hashed linear scorer.

Several heuristic labellers vote good, bad or nothing on every text. Their accuracies are estimated
without labels: expectation-maximisation on the counts of vote patterns, over all texts. A pattern's
posterior is the label of its texts. A linear scorer over hashed word shapes then learns from the
posteriors of a bounded sample (`sample`, a documented parameter) and scores every whole text.

The sample is of distinct texts, each weighted by its rows: the smaller a text's hash and the more
rows it has, the sooner it is in (priority sampling). A text of many rows is in by itself and weighs
what its rows weigh; the others stand for those left out.

Only the counts of vote patterns (at most 3 to the number of labellers) and the sampled texts' hashed
shares reach the driver.

Words are runs between white space; longer ones than PIECE count in consecutive pieces, so texts of
scripts without spaces are scored to their end. The vote on length counts the letters of long words
too, and long words of letters without case say nothing about word lengths and sentences.

Defined results: a null text is an empty one; an empty text is voted bad by its length; repeated rows
count each; an empty table gives no rows and an untrained scorer of 0.5; other columns are not
looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LABELLERS = ("repeats", "capitals", "symbols", "variety", "lines", "length", "word_length", "sentences")
SYMBOLS = b"%$*&|#@~^<>{}[]\\=_!"
DIMENSIONS = 1 << 12
SAMPLE = 4000
#: Distinct words whose shapes a task keeps.
KEPT = 300_000
#: Characters of a word that are looked at as one; of a word that counts as long; letters that count as a word within one.
PIECE, LONG, LETTERS = 64, 12, 6


def _vote(value: float, bad_above: float, good_below: float) -> int:
    return -1 if value > bad_above else 1 if value < good_below else 0


def _size(words: list[str]) -> int:
    """The number of words; a long one counts by its letters."""
    return sum(max(1, sum(map(str.isalpha, w)) // LETTERS) if len(w) > LONG else 1 for w in words)


def _caseless(text: str) -> bool:
    """Whether most letters are of scripts without case."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c.islower() or c.isupper() for c in letters) < len(letters)


def votes(text: str) -> list[int]:
    """1 good, -1 bad, 0 nothing, by labeller."""
    words = text.split()
    n = len(words)
    short = -1 if n < 5 and _size(words) < 5 else 0
    if n < 3:
        return [0, 0, 0, 0, 0, short, 0 if short or _caseless(text) else -1, 0]
    raw = text.encode("utf-8", "replace")
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip()]
    variety = math.log(len(set(words))) / math.log(n)
    length = len(text) / n - 1
    ends = raw.count(b".") + raw.count(b",") + raw.count(b"?")
    unspaced = length > 9.5 and _caseless(text)
    return [
        _vote(sum(map(eq, words, words[1:])) / n, 0.1, 0.02),
        _vote(sum(map(str.isupper, words)) / n, 0.3, 0.1),
        _vote(symbols / n, 0.2, 0.03),
        _vote(-variety, -0.7, -0.8) if n >= 20 else 0,
        _vote(1 - len(set(lines)) / len(lines), 0.3, 0.05) if len(lines) > 3 else 0,
        short,
        0 if unspaced else _vote(abs(length - 5.5), 4, 2.5),
        0 if unspaced else _vote(abs(math.log((ends + 0.5) / n) + 2), 2, 1.2),
    ]


def _voting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = batch.drop(columns="text")
        out["votes"] = [votes(text) for text in batch["text"]]
        yield out


def voted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, votes) of every text; votes follow LABELLERS."""
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = documents.schema[key].dataType.simpleString()
    return rows.mapInPandas(_voting, f"`{key}` {kind}, votes array<int>")


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and of each labeller the chances of -1, 0, 1 for bad and for good texts."""

    good: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        places = np.arange(patterns.shape[1])
        bad, good = (np.log(self.chances[k][places, patterns + 1]).sum(1) for k in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good + math.log((1 - self.good) / self.good), -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, how often a vote it gives is right."""
        right = self.good * self.chances[1][:, 2] + (1 - self.good) * self.chances[0][:, 0]
        wrong = self.good * self.chances[1][:, 0] + (1 - self.good) * self.chances[0][:, 2]
        return right / (right + wrong)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from the majority of the votes; a vote of nothing says nothing about the class."""
    total = patterns.sum(1)
    belief = 1 / (1 + np.exp(-2.0 * total))
    model = None
    for _ in range(rounds):
        chances = np.zeros((2, patterns.shape[1], 3))
        for k, weight in enumerate((counts * (1 - belief), counts * belief)):
            for vote in (-1, 1):
                chances[k, :, vote + 1] = ((patterns == vote) * weight[:, None]).sum(0)
            given = chances[k].sum(1) + 2.0
            # Smoothed towards a labeller that is right four times in five.
            chances[k, :, 0] = (chances[k, :, 0] + (1.6, 0.4)[k]) / given
            chances[k, :, 2] = (chances[k, :, 2] + (0.4, 1.6)[k]) / given
            chances[k, :, 1] = 1.0
        model = LabelModel(float(np.clip((counts * belief).sum() / counts.sum(), 0.01, 0.99)), chances)
        now = model.posterior(patterns)
        if np.abs(now - belief).max() < 1e-9:
            break
        belief = now
    return model


_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters by case and digits, runs taken together, other characters as they are; and whether the word is long."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in word)
    return _RUNS.sub(r"\1+", kinds) + ("_" if len(word) > LONG else "")


def _pieces(words: list[str]) -> list[str]:
    """The words, those longer than PIECE in consecutive pieces."""
    if not words or max(map(len, words)) <= PIECE:
        return words
    return [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]


class Features:
    """Hashed shares of word shapes, of pairs of them, and of words that repeat the one before."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.known: dict[str, tuple[int, int]] = {}

    def _look(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            raw = word.encode("utf-8", "replace")
            found = self.known[word] = (zlib.crc32(shape(word).encode("utf-8", "replace")), zlib.crc32(raw))
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, shares), the shares as square roots."""
        words = _pieces(text.split())
        if not words:
            return np.array([0]), np.array([1.0], np.float32)
        look = self._look
        both = np.array([look(w) for w in words], dtype=np.uint64)
        shapes, names = both[:, 0], both[:, 1]
        pairs = (shapes[:-1] * np.uint64(31) + shapes[1:] * np.uint64(17)) ^ np.uint64(0x5BD1)
        repeated = np.where(names[1:] == names[:-1], np.uint64(1), np.uint64(2))
        ids = np.concatenate([shapes, pairs, repeated]) % np.uint64(self.dimensions)
        places, counts = np.unique(ids, return_counts=True)
        return places.astype(np.int64), np.sqrt(counts / len(words)).astype(np.float32)


def _sampling(dimensions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(dimensions)
        seen: set[int] = set()
        for batch in batches:
            # A text's copies in a task give one row.
            batch = batch[~(batch["order"].duplicated() | batch["order"].isin(seen))]
            seen.update(batch["order"])
            found = [features.of(text) for text in batch["text"]]
            yield batch.drop(columns="text").assign(
                votes=[votes(text) for text in batch["text"]], places=[f[0] for f in found], shares=[f[1] for f in found]
            )

    return run


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float


def fit_scorer(
    places: list[np.ndarray], shares: list[np.ndarray], goal: np.ndarray, dimensions: int, weight: np.ndarray,
    rounds: int = 300, rate: float = 0.05, decay: float = 1e-4,
) -> Scorer:
    """Logistic regression on posterior labels over sparse, weighted rows; both classes weigh the same."""
    lengths = np.array([len(p) for p in places])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    column, value = np.concatenate(places), np.concatenate(shares).astype(np.float64)
    weight = weight / weight.sum()
    share = float(np.clip(goal @ weight, 1e-3, 1 - 1e-3))
    each = (goal / share + (1 - goal) / (1 - share)) * weight
    w = np.zeros(dimensions + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.add.reduceat(value * w[column], starts) + w[-1])))
        d = each * (p - goal)
        g = np.append(np.bincount(column, value * np.repeat(d, lengths), dimensions) + decay * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Scorer(w[:-1], float(w[-1]))


def _scoring(scorer: Scorer, dimensions: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(dimensions)
        for batch in batches:
            scores = []
            for text in batch["text"]:
                places, shares = features.of(text)
                scores.append(float(1 / (1 + np.exp(-np.clip(scorer.weights[places] @ shares + scorer.bias, -700, 700)))))
            out = batch.drop(columns="text")
            out["score"] = scores
            yield out

    return run


def train(
    documents: DataFrame, votes_of: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, dimensions: int = DIMENSIONS
) -> tuple[LabelModel | None, Scorer]:
    """Fits both models. The label model counts all texts; the scorer sees `sample` distinct texts, weighted by their rows."""
    patterns = votes_of.groupBy("votes").count().collect()
    empty = Scorer(np.zeros(dimensions), 0.0)
    if not patterns:
        return None, empty
    model = fit_labels(np.array([r["votes"] for r in patterns]), np.array([r["count"] for r in patterns], dtype=float))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(content.alias("text"), F.xxhash64(content).alias("order"), F.xxhash64(F.col(key)).alias("copy"))
    # Of a text's rows those of the smallest key's hash are read; hashes and numbers are all that moves.
    texts = rows.groupBy("order").agg(F.count("*").alias("n"), F.min("copy").alias("copy"))
    chosen = texts.withColumn("rank", _uniform(F.col("order")) / F.col("n")).orderBy("rank", "order").limit(sample + 1)
    read = rows.join(F.broadcast(chosen), ["order", "copy"]).select("order", "n", "rank", "text")
    schema = "order long, n long, rank double, votes array<int>, places array<long>, shares array<float>"
    taught = read.mapInPandas(_sampling(dimensions), schema).dropDuplicates(["order"]).toPandas().sort_values(["rank", "order"])
    # The first text left out tells how many rows one of the others stands for.
    least = 1 / taught["rank"].iloc[sample] if len(taught) > sample else 1.0
    taught = taught[:sample]
    goal = model.posterior(np.array(taught["votes"].tolist()))
    weight = np.maximum(taught["n"].to_numpy(dtype=float), least)
    return model, fit_scorer(taught["places"].tolist(), taught["shares"].tolist(), goal, dimensions, weight)


def _uniform(order: Column) -> Column:
    """A hash as a number above 0 and up to 1."""
    return (F.shiftrightunsigned(order, 11) + 1) / F.lit(float(1 << 53))


def score(documents: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, score) of every text: the chance that it is good."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(_scoring(scorer, dimensions), f"`{key}` {kind}, score double")
