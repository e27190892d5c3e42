"""Best-fit packing of documents into token sequences by sums of squares.

Documents are turned into token ids that end with the id 0; longer ones are cut into whole
sequences with the rest as the first piece. Pieces are dealt by hash into groups of a bounded
expected size, and each group is packed by itself: longest first, every piece goes where the
squared counts of open bins per residual gap become smallest. A bin is opened only where no gap
holds the piece, so a group leaves few bins unfilled.

Defined results: a null or empty text is the single id 0; the name of an added token in a text, such
as <|endoftext|>, is that token's id, as the tokenizer gives it unaltered; repeated rows are packed each; pieces of
equal length go in the order of their keys; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 2048
GROUP = 8192
PIECES = "piece int, start long, length long, ids_crc32 long"

#: Characters on whose classes the two tokenizer libraries agree (tests go through all of them);
#: texts with others, or with long runs of white space, take the slower library.
_RARE = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u036f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bd]|\s{500}")


@functools.cache
def _encoders(vocabulary: str, ranks: str):
    """The exact tokenizer, a faster reader of the same vocabulary, and what finds added tokens, which only the first knows."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    added = [token.content for token in exact.get_added_tokens_decoder().values()]
    holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return exact, fast, holds_added


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """The ids of a text, then 0."""
    exact, fast, holds_added = _encoders(vocabulary, ranks)
    if not text:
        ids = []
    elif _RARE.search(text) or holds_added(text):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, 0], dtype="<u4")


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the rest first."""
    first = n - (-(-n // limit) - 1) * limit
    return [(0, first), *((start, limit) for start in range(first, n, limit))]


def _cutting(limit: int, keep_ids: bool, vocabulary: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, list[tuple]] = {}
            rows, origin = [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                found = seen.get(text)
                if found is None:
                    ids = token_ids(text, vocabulary, ranks)
                    found = []
                    for piece, (start, length) in enumerate(cuts(len(ids), limit)):
                        part = ids[start : start + length].tobytes()
                        found.append((piece, start, length, zlib.crc32(part), part if keep_ids else None))
                    seen[text] = found
                rows += found
                origin += [k] * len(found)
            piece, start, length, crc, ids = zip(*rows, strict=True) if rows else ((),) * 5
            columns = {
                batch.schema.names[0]: batch.column(0).take(pa.array(origin, pa.int32())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pieces(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    keep_ids: bool = False,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document; ids are little-endian 32-bit numbers."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}" + (", ids binary" if keep_ids else "")
    rows = documents.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(_cutting(limit, keep_ids, vocabulary, ranks), schema)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length; lengths come longest first."""
    count = np.zeros(limit + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        # Taking gap g changes the sum of squares by 2 (count[g - s] - count[g]) + 2; a gap left at 0 is closed.
        change = count[: limit + 1 - s] - count[s:]
        change[0] = -count[s] - (1 if count[s] else 0)
        fits = count[s:limit] > 0
        if fits.any():
            g = s + int(np.where(fits, change[: limit - s], np.iinfo(np.int64).max).argmin())
            place = open_bins[g].pop()
            count[g] -= 1
        else:
            g, place = limit, used
            used += 1
        bins[k], offsets[k] = place, limit - g
        if g > s:
            open_bins[g - s].append(place)
            count[g - s] += 1
    return bins, offsets


def pack(cut: DataFrame, key: str = "doc_id", limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. `cut` is read twice, so hand in a written table.

    The number of groups follows the number of pieces, so each task packs about `group` of them.
    """
    groups = max(1, -(-cut.count() // group))
    # Equal pieces are told apart by where they are written, so that they spread as well.
    written = F.xxhash64(key, "piece", "ids_crc32", "length", F.monotonically_increasing_id())
    dealt = cut.withColumn("grp", F.pmod(written, F.lit(groups)).cast("long"))

    def work(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.sort_by(order)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), limit)
        places = rows["grp"].to_numpy() * (1 << 32) + bins
        return rows.drop_columns("grp").append_column("sequence_id", pa.array(places)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("grp").applyInArrow(work, ", ".join(_fields(cut)) + ", sequence_id long, offset long")


def _fields(frame: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that kept their ids; at most `limit` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    hexed = F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(hexed).alias("ids"))
