"""Secrets by form, told apart from examples by how widely the corpus copies them.

Every text is searched for candidates: assigned values, access keys, hexadecimal runs, and opaque
runs of mixed characters. The base kinds are found by form alone and always stay. The value of each
candidate is hashed, and the distinct repositories and owners that hold a hash are counted over the
whole corpus: what several owners publish is an example that was copied, what a single owner
publishes, even in many of its repositories, is specific to it and looks live. An opaque run becomes
a finding only where it is live; base findings are marked either way.

Defined results: a null text is an empty one; a null owner or repository counts as one of its own;
spans are in code points, the end excluded; repeated rows are rows each, in one repository; an
opaque run that meets a base span is left out; an empty table gives no rows; other columns are not
looked at. A whole text is searched, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketwise.session import materialise

# The base kinds in their order, and the fewest characters of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "opaque")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: An opaque run: characters of keys, and how many of them at least, altogether and distinct.
OPAQUE = r"[A-Za-z0-9_-]{24,}"
DISTINCT = 12
#: Owners that may hold a value that is specific to one of them.
OWNERS = 1

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
#: Shorter matches fail whole, as all of a run belongs to one match; so only long ones are looked for.
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"[0-9a-f]{24,}")
_opaque = re.compile(OPAQUE)

SPANS = "array<struct<start:int,rank:int,end:int,hash:string>>"


def mixed(run: str) -> bool:
    """Capitals, small letters and digits, and enough different characters."""
    return len(set(run)) >= DISTINCT and all(re.search(x, run) for x in ("[A-Z]", "[a-z]", "[0-9]"))


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) in the order of starts, then kinds."""
    if not text:
        return []
    found = [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for rank, form in ((1, _access), (2, _hex)):
        found += [(m.start(), rank, m.end(), m[0]) for m in form.finditer(text)]
    base = sorted(found)
    reach, k = 0, 0
    for m in _opaque.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= m.start() and mixed(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
    for batch in batches:
        spans = [
            [{"start": a, "rank": rank, "end": b, "hash": hashlib.sha256(value.encode()).hexdigest()} for a, rank, b, value in candidates(t.as_py())]
            for t in batch.column(0)
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, kind)], ["row", "key", "repository", "owner", "spans"])


def search(documents: DataFrame, key: str, text: str, repository: str, owner: str) -> DataFrame:
    """(row, key, repository, owner, spans) of every row, written; row tells rows apart."""
    kinds = [documents.schema[name].dataType.simpleString() for name in (key, repository, owner)]
    schema = f"row long, key {kinds[0]}, repository {kinds[1]}, owner {kinds[2]}, spans {SPANS}"
    named = documents.select(
        F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.col(repository).alias("repository"), F.col(owner).alias("owner"),
    )
    return materialise(named.mapInArrow(_searching, schema), "candidates")


def ownership(searched: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate value over the whole corpus."""
    held = searched.select("repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    # Distinct pairs first, combined in the task that finds them: a value that fills a third of the corpus leaves few rows.
    pairs = held.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def findings(searched: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(row, start, rank, end, hash, repositories, owners, live) of every span that stays, base ones first of all."""
    spans = searched.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.rank", "s.end", "s.hash")
    # The counts are written, so that adaptive execution may split a value that many rows hold.
    judged = spans.join(materialise(ownership(searched), "ownership"), "hash").withColumn("live", F.col("owners") <= owners)
    return judged.where(F.col("live") | (F.col("rank") < 3))


def scan(documents: DataFrame, key: str, text: str, repository: str, owner: str, owners: int = OWNERS) -> DataFrame:
    """(key, spans, n_live, n_example) of every row; spans (start, rank, end, live) in the order of starts, then kinds."""
    searched = search(documents, key, text, repository, owner)
    span = F.struct("start", "rank", "end", "live")
    by_row = findings(searched, owners).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    found = searched.where(F.size("spans") > 0).select("row", "key").join(by_row, "row", "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,live:boolean>>")
    # Only rows with candidates are moved.
    every = found.select("key", F.coalesce("spans", empty).alias("spans")).union(
        searched.where(F.size("spans") == 0).select("key", empty.alias("spans"))
    )
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return every.select(F.col("key").alias(key), "spans", live.alias("n_live"), (F.size("spans").cast("long") - live).alias("n_example"))


def written(spans, kinds: tuple[str, ...] = KINDS):
    """`kind:start:end`, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
