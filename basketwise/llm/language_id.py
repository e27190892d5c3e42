"""Language identification of mixed text: scripts narrow the candidates, Viterbi labels the words.

Words are the runs between white space, cut where the script changes and, in scripts that are
written without spaces, into pieces of four characters, so that such passages get spans and weights
of their own (``words_of``). Each distinct word is scored once per language from
hashed character pairs, triples and the whole word; languages never seen with the word's script
are left out. A Viterbi pass over the words of a text, in which changing the language costs a fixed
penalty, labels every word; the text's language is the one with most letters, and the score is its
share of the letters. Whole texts are labelled.

Learning counts over all rows given and keeps one hashed table per language, whose size is a
parameter; only that table reaches the driver and is broadcast.

Defined results: a text that is null or has no letter is `und` with score 0 and no spans; without
any labelled text everything is `und`; languages with equal letters are taken in sorted order;
repeated rows are labelled each; other columns are not looked at. A single word of another script
does not outweigh two switches, so it stays in the span around it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: First code points of the ranges that tell scripts apart; fixed values of the Unicode blocks.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0x10000, "other"), (0x20000, "han"),
)
SCRIPTS = tuple(sorted({name for _, name in SCRIPT_STARTS}))

#: Scripts written without spaces between words, and the characters in a piece of them.
UNSPACED = ("han", "kana", "thai", "lao", "khmer", "burmese", "tibetan")
PIECE = 4

BUCKETS = 1 << 15
SWITCH = 12.0
WORST = 8.0
LEAST_SHARE = 0.001
#: Distinct words that a task keeps at once, and cells of a Viterbi block.
KEPT_WORDS, BLOCK = 200_000, 400_000
SPANS = "array<struct<lang:string,first_word:int,words:int>>"

_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])
_STARTS = [start for start, _ in SCRIPT_STARTS]


@dataclass(frozen=True)
class Model:
    """Log probabilities per language and bucket, and the scripts each language uses."""

    langs: tuple[str, ...]
    weights: np.ndarray
    scripts: np.ndarray


def _ranges(name: str) -> str:
    """The characters of a script, for a class of a pattern."""
    ends = [*_STARTS[1:], 0x110000]
    return "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for (a, script), b in zip(SCRIPT_STARTS, ends, strict=True) if script == name)


_NAMED = tuple(s for s in SCRIPTS if s != "other")
#: A character of a script other than Latin; without one there is nothing to cut.
_BEYOND = re.compile(f"[{''.join(_ranges(s) for s in _NAMED if s != 'latin')}]")
_NEUTRAL = f"[{_ranges('other')}]"
#: A run of one script with the characters of no script around it.
_RUN = re.compile("|".join(f"(?P<{s}>{_NEUTRAL}*+[{_ranges(s)}][{_ranges(s)}{_ranges('other')}]*+)" for s in _NAMED) + f"|{_NEUTRAL}++")


def words_of(text: str) -> list[str]:
    """The words of a text, in order; together they are all of it but its white space."""
    words = text.split()
    if text.isascii() or not _BEYOND.search(text):
        return words
    out = []
    for word in words:
        if not _BEYOND.search(word):
            out.append(word)
            continue
        for run in _RUN.finditer(word):
            step = PIECE if run.lastgroup in UNSPACED else len(run[0])
            out.extend(run[0][k : k + step] for k in range(0, len(run[0]), step))
    return out


def script_of(word: str) -> int:
    """The script of the first letter; -1 without one."""
    for c in word:
        if c.isalpha():
            return SCRIPTS.index(SCRIPT_STARTS[bisect_right(_STARTS, ord(c)) - 1][1])
    return -1


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs, triples and whole of each word (marked at both ends), and where each word starts."""
    marked = [f"^{word}^" for word in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(40)
    one = np.append(codes[1:], np.uint64(0))
    two = np.append(codes[2:], np.zeros(2, np.uint64))[: len(codes)]
    pairs = ((codes * a + one * b) * c) >> shift
    triples = ((codes * b + one * c + two * a) * a) >> shift
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - place
    # Sums over a word of letters weighted by odd powers of its place stand for the whole word.
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((codes * b + np.uint64(1)) * (place.astype(np.uint64) * c + a), starts) * b >> shift
    size = np.uint64(buckets)
    table = np.empty((len(codes), 3), dtype=np.int64)
    table[:, 0] = np.where(left >= 2, pairs % size, buckets)
    table[:, 1] = np.where(left >= 3, triples % size, buckets)
    table[:, 2] = np.where(place == 0, np.repeat(whole % size, lengths), buckets)
    return table, starts


def _counting(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush() -> None:
            for lang, counted in words.items():
                if not counted:
                    continue
                total = sums.setdefault(lang, np.zeros(buckets + 1 + len(SCRIPTS)))
                listed = list(counted)
                for k in range(0, len(listed), 50_000):
                    some = listed[k : k + 50_000]
                    weight = np.fromiter((counted[w] for w in some), dtype=float, count=len(some))
                    table, starts = grams(some, buckets)
                    each = np.repeat(weight, np.diff(np.append(starts, len(table))))
                    total[: buckets + 1] += np.bincount(table.ravel(), np.repeat(each, 3), buckets + 1)
                    for w, n in zip(some, weight, strict=True):
                        if (s := script_of(w)) >= 0:
                            total[buckets + 1 + s] += n
                counted.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
            if sum(map(len, words.values())) > KEPT_WORDS:
                flush()
        flush()
        for lang, total in sums.items():
            total[buckets] = 0
            slots = total.nonzero()[0]
            yield pd.DataFrame({"lang": lang, "slot": slots, "n": total[slots].astype(np.int64)})

    return run


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Counts the grams of all rows with a text and a language."""
    known = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = known.mapInPandas(_counting(buckets), "lang string, slot int, n long")
    # At most one row per language and slot: the size of the model.
    sums = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(sums["lang"].unique()))
    table = np.zeros((len(langs), buckets + 1 + len(SCRIPTS)))
    table[[langs.index(x) for x in sums["lang"]], sums["slot"]] = sums["n"]
    counts, scripts = table[:, :buckets], table[:, buckets + 1 :]
    weights = np.zeros((len(langs), buckets + 1), dtype=np.float32)
    if langs:
        weights[:, :buckets] = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * buckets))
        shares = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        scripts = shares >= LEAST_SHARE
    return Model(langs, weights, scripts)


class Scorer:
    """Scores distinct words once; forgets them when there are too many."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.langs)), dtype=np.float32)
        self.letters = np.zeros(1024, dtype=np.int32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if not new:
            return
        first = len(self.ids)
        self.ids.update(zip(new, range(first, first + len(new)), strict=True))
        if first + len(new) > len(self.letters):
            room = 2 * (first + len(new))
            self.scores = np.resize(self.scores, (room, self.scores.shape[1]))
            self.letters = np.resize(self.letters, room)
        weights, buckets = self.model.weights, self.model.weights.shape[1] - 1
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            table, starts = grams([w.lower() for w in some], buckets)
            sums = np.stack([np.add.reduceat(row[table].sum(1), starts) for row in weights], axis=1)
            scripts = np.fromiter(map(script_of, some), dtype=np.int64, count=len(some))
            usable = self.model.scripts[:, scripts].T
            sums = np.where(usable | ~usable.any(1, keepdims=True), sums, -np.inf)
            sums = np.maximum(sums - sums.max(1, keepdims=True), -WORST)
            sums[scripts < 0] = 0
            self.scores[first + k : first + k + len(some)] = sums
            self.letters[first + k : first + k + len(some)] = [sum(map(str.isalpha, w)) for w in some]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word; scores is texts x words x languages, padded with zeros."""
    texts, words, langs = scores.shape
    rows = np.arange(texts)
    best = scores[:, 0].copy()
    stayed = np.ones((words, texts, langs), dtype=bool)
    came = np.zeros((words, texts), dtype=np.int16)
    for t in range(1, words):
        top = best.argmax(1)
        moved = best[rows, top] - switch
        stayed[t] = best >= moved[:, None]
        came[t] = top
        best = np.where(stayed[t], best, moved[:, None]) + scores[:, t]
    out = np.zeros((texts, words), dtype=np.int16)
    now = best.argmax(1)
    # Padding scores nothing, so the best label at a text's end is still the best label at the end of its row.
    for t in range(words - 1, -1, -1):
        out[:, t] = now
        now = np.where(stayed[t][rows, now], now, came[t])
    return out


def _labelling(model: Model, switch: float, spans: bool):
    langs = np.array([*model.langs, "und"], dtype=object)

    def block(ids: list[np.ndarray], scorer: Scorer) -> list[tuple]:
        lengths = np.array([len(x) for x in ids])
        grid = np.zeros((len(ids), lengths.max()), dtype=np.int64)
        inside = np.arange(grid.shape[1]) < lengths[:, None]
        grid[inside] = np.concatenate(ids)
        scores = np.where(inside[:, :, None], scorer.scores[grid], np.float32(0))
        letters = np.where(inside, scorer.letters[grid], 0)
        path = viterbi(scores, lengths, switch)
        share = np.stack([np.where(path == k, letters, 0).sum(1) for k in range(len(model.langs))], axis=1)
        total = letters.sum(1)
        out = []
        for k, n in enumerate(lengths):
            if not total[k]:
                out.append(("und", 0.0, []))
                continue
            top = share[k].argmax()
            found = []
            if spans:
                cuts = [0, *(np.nonzero(path[k, 1:n] != path[k, : n - 1])[0] + 1), n]
                found = [{"lang": langs[path[k, a]], "first_word": int(a), "words": int(b - a)} for a, b in zip(cuts, cuts[1:], strict=False)]
            out.append((langs[top], float(share[k, top] / total[k]), found))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            results: list[tuple] = [("und", 0.0, [])] * len(batch)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for k in range(0, len(texts) if model.langs else 0, 500):
                split = [(i, words) for i in range(k, min(k + 500, len(texts))) if texts[i] and (words := words_of(texts[i]))]
                if len(scorer.ids) > KEPT_WORDS:
                    scorer.clear()
                scorer.learn(set().union(*(words for _, words in split)))
                known = scorer.ids
                held = [(i, np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))) for i, words in split]
                held.sort(key=lambda x: len(x[1]))
                a = 0
                while a < len(held):
                    b = a + 1
                    while b < len(held) and (b - a + 1) * len(held[b][1]) <= BLOCK and len(held[b][1]) <= 2 * len(held[a][1]) + 50:
                        b += 1
                    for (i, _), found in zip(held[a:b], block([x for _, x in held[a:b]], scorer), strict=True):
                        results[i] = found
                    a = b
            found = [pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64())]
            if spans:
                found.append(pa.array([r[2] for r in results], pa.list_(_SPAN)))
            names = [*batch.schema.names[:-1], "lang_pred", "score", *(("spans",) if spans else ())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names)

    return run


def label(
    rows: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), switch: float = SWITCH, spans: bool = True
) -> DataFrame:
    """(*keep, lang_pred, score, spans): spans are runs of words (as words_of gives them) of one language, in order."""
    kept = [f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep]
    schema = ", ".join([*kept, "lang_pred string", "score double", *([f"spans {SPANS}"] if spans else [])])
    return rows.select(*keep, F.col(text).alias("labelled text")).mapInArrow(_labelling(model, switch, spans), schema)
