"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes uncompressed archives with Spark's text writer: a record is one value, and the
blank lines that end a record are the line separator. The reader takes .warc and .warc.gz files.
It checks length, trailer and payload digest of every record. After a failed check it searches for
the next version line (or gzip member) where a whole valid record begins, goes on from there, and
logs the bytes between as a quarantined gap.

Defined results: a null payload is empty; a null or repeated id is written as it is, and of equal
payloads all rows with the smallest id are responses; a null url has no target header; line breaks
in a url are percent-encoded; an empty table gives no records; other columns are not written. A file
holds no more than the bytes asked for, unless a single record is larger: that has a file of its own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.session import materialise

#: Formats of the archive standard; fixed values.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"

SMALLEST_REVISIT = 100
#: Bytes of an archive, which one task reads back as a whole; only a single record may be larger.
FILE_BYTES = 128 << 20
#: Bytes of the classes of records that are written together; the last one takes all that are larger.
CLASSES = [4096 * 16**n for n in range(5)]
#: More bytes than the names and fixed values in the head of a record.
HEAD_BYTES = 1024

READ = (
    "file string, begins long, ends long, kind string, reason string, record_id string, record_type string, uri string, "
    "payload_bytes long, payload_digest string, refers_to string"
)


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to (page_id, url, payload) rows.

    Only digests that occur twice are joined back; they are written first, so that their real size
    decides whether the payloads have to move. Rows that cannot be revisits carry a key of their own,
    so that they spread. Spark splits a digest that holds many rows.
    """
    content = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn(payload, content).withColumns(
        {"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(F.col(payload), 256)}
    )
    large = F.col("payload_bytes") >= SMALLEST_REVISIT
    firsts = (
        rows.where(large).groupBy("payload_digest").agg(F.min(page_id).alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("payload_digest").alias("joined_by"), "first_id")
    )
    firsts = materialise(firsts, "first-payloads")
    own = F.concat_ws("-", F.lit("own"), F.col(page_id).cast("string"), F.xxhash64(payload).cast("string"))
    keyed = rows.withColumn("joined_by", F.when(large, F.col("payload_digest")).otherwise(own))
    again = F.col("first_id").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("first_id"))
    return keyed.join(firsts, "joined_by", "left").drop("joined_by").withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first_id"))}
    ).drop("first_id")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def record_text(page_id: str, url: str, payload: str) -> Column:
    """A whole record without the blank lines that end it."""
    line = "\r\n"
    clean = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, HTTP_HEAD).otherwise(F.concat(F.lit(HTTP_HEAD), F.col(payload)))
    parts = [
        F.lit(VERSION + line + "WARC-Type: "), F.col("record_type"),
        F.lit(line + "WARC-Record-ID: "), _urn(F.col(page_id)),
        F.lit(f"{line}WARC-Date: {CAPTURED}"),
        F.coalesce(F.concat(F.lit(line + "WARC-Target-URI: "), clean), F.lit("")),
        F.lit(line + "WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{line}WARC-Profile: {REVISIT_PROFILE}{line}WARC-Refers-To: "), _urn(F.col("refers_to")),
                F.lit(line + "X-Payload-Length: "), F.col("payload_bytes").cast("string"),
            ),
        ).otherwise(""),
        F.lit(f"{line}Content-Type: application/http;msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(line + line), block,
    ]
    return F.concat(*parts)


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES
) -> None:
    """Writes one record per row, into archives of no more than the given bytes.

    Spark bounds the records of a file, not its bytes. So records are written by classes of size, each
    with as many records a file as fit if all are as large as the class allows: the files of a class are
    a sixteenth full at least. Most tables have one or two classes; classes without rows cost nothing.
    """
    pages = pages.select(page_id, url, payload)
    body = F.coalesce(F.octet_length(payload), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length(url), F.lit(0))
    found = F.size(F.filter(F.array(*(F.lit(limit) for limit in CLASSES)), lambda limit: limit < body))
    longest = F.max(F.octet_length(F.col(page_id).cast("string"))).alias("id_bytes")
    seen = pages.groupBy(found.alias("size")).agg(longest).collect()
    ids = 2 * max((r["id_bytes"] or 0 for r in seen), default=0)
    # The size goes along, so that the rows of a class are chosen before payloads are joined.
    rows = with_revisits(pages.withColumn("warc size", found), page_id, payload)
    for n, size in enumerate(sorted(r["size"] for r in seen) or [0]):
        fit = file_bytes // (CLASSES[size] + HEAD_BYTES + ids) if size < len(CLASSES) else 1
        values = rows.where(F.col("warc size") == size).select(record_text(page_id, url, payload).alias("value"))
        writer = values.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(fit, 1))
        writer.mode("append" if n else "errorifexists").text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n:]+:[^\r\n]*\r\n)+)\r\n")


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record that begins at `at` and where it ends, or the check that failed."""
    head = _HEAD.match(data, at)
    if not head:
        return None, at, "no record begins here"
    fields = {}
    for line in head[1].split(b"\r\n")[:-1]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None, at, "bad length"
    begin, end = head.end(), head.end() + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "the record does not end where its length says"
    block, kind = data[begin:end], fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else block
    length = len(payload)
    if kind == "revisit":
        length = int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdigit() else None
    elif digest and hashlib.sha256(payload).hexdigest() != digest:
        return None, at, "the payload does not have its digest"
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind, "uri": fields.get("warc-target-uri"),
        "payload_bytes": length, "payload_digest": digest or hashlib.sha256(payload).hexdigest(),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload": payload,
    }, end + 4, ""


def _plain(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        record, end, why = _record(data, at)
        if record:
            yield {"kind": "record", "begins": at, "ends": end, "reason": None, **record}
            at = end
            continue
        found = at
        while (found := data.find(b"WARC/1.", found + 1)) >= 0 and not _record(data, found)[0]:
            pass
        end = found if found >= 0 else len(data)
        yield {"kind": "gap", "begins": at, "ends": end, "reason": why}
        at = end


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The content of the gzip member at `at` and where it ends; None if it is not whole."""
    unzip = zlib.decompressobj(31)
    try:
        content = unzip.decompress(memoryview(data)[at:]) + unzip.flush()
    except zlib.error:
        return None, at
    return (content, len(data) - len(unzip.unused_data)) if unzip.eof else (None, at)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and quarantined gaps of an archive, in order; begins and ends are offsets in the file.

    In a compressed file the offsets are those of the member. A member that unpacks but holds a
    broken record is a gap of its own. An archive that starts with a damaged member is still taken
    as compressed if a later one unpacks.
    """
    first = data.find(b"\x1f\x8b\x08")
    if data[:5] == b"WARC/" or first < 0 or (0 <= data.find(b"WARC/1.") < first):
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        content, end = _member(data, at) if data[at : at + 3] == b"\x1f\x8b\x08" else (None, at)
        if content is not None:
            yield from ({**row, "begins": at, "ends": end} for row in _plain(content))
            at = end
            continue
        found = at
        while (found := data.find(b"\x1f\x8b\x08", found + 1)) >= 0:
            if (_member(data, found)[0] or b"").startswith(b"WARC/"):
                break
        end = found if found >= 0 else len(data)
        yield {"kind": "gap", "begins": at, "ends": end, "reason": "no whole gzip member"}
        at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record and per quarantined gap of all archives in a folder; payloads on demand.

    An archive is one task's work; the writer bounds how many bytes a file holds. Archives from elsewhere
    must not exceed the 2 GiB of a binary value.
    """
    schema = READ + (", payload binary" if payloads else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for row in salvage(bytes(data)):
                    row["file"] = file
                    rows.append([row.get(name) for name in names])
                    if len(rows) == 1000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, schema)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    frame[["begins", "ends", "payload_bytes"]] = frame[["begins", "ends", "payload_bytes"]].astype("Int64")
    return frame


def page_records(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that were read."""

    def number(urn: str) -> Column:
        return F.col(urn).substr(F.lit(len("urn:page:") + 1), F.length(urn)).try_cast("long")

    return read.where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
