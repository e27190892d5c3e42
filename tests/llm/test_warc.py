import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from basketwise.llm import warc


def archived(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path)
    return path


def expected(rows):
    out, first = [], {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(first.get(data, key), key)
    for key, _, html in rows:
        data = (html or "").encode()
        again = data in first and first[data] != key
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "https://a.example/x", "é" * 60), (2, None, "é" * 60), (3, "http://b.example/\r\nWARC/1.1", "short"), (4, "u", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", "x" * 500 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 200),
    (8, "u", "x" * 100_000), (9, "u", "x" * 100_000), (None, "u", "z"), (10, "u", "q" * 99), (11, "u", "q" * 99), (12, "u", "q" * 100), (12, "u", "q" * 100),
]


def test_round_trip(spark, tmp_path):
    path = archived(spark, tmp_path, ROWS)
    read = warc.read_archives(spark, path, payloads=True)
    assert read.where("kind = 'gap'").count() == 0
    got = sorted((tuple(r) for r in warc.page_records(read).collect()), key=repr)
    assert got == expected(ROWS)
    pages = {r["record_id"]: bytes(r["payload"]) for r in read.where("record_type = 'response'").collect()}
    assert pages["urn:page:7"] == ROWS[6][2].encode() and pages["urn:page:8"] == b"x" * 100_000


@pytest.mark.parametrize("bound", [1, 20_000, 300_000])
def test_archives_are_bounded_by_bytes(spark, tmp_path, bound):
    sizes = [n * 37 % 3000 for n in range(60)] + [4096, 4097, 60_000, 65_536, 65_537, 200_000, 1_100_000, 17_000_000] + [30_000] * 25
    rows = [(n, f"http://h/{n}/" + "\r\n" * (n % 40), f"{n:06}" + "x" * size) for n, size in enumerate(sizes)]
    rows += [(1000 + n, "u", "same " * 1000) for n in range(40)] + [(5, "u", "same " * 1000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame = frame.withColumns({"size": F.lit("clash"), "record_type": F.lit(7), "value": F.lit(None)}).coalesce(2)
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path, file_bytes=bound)
    read = warc.read_archives(spark, path)
    assert read.where("kind = 'gap'").count() == 0
    assert sorted((tuple(r) for r in warc.page_records(read).collect()), key=repr) == expected(rows)
    files = read.groupBy("file").agg(F.count("*").alias("n"), F.max("ends").alias("length")).collect()
    assert all(f["n"] == 1 or f["length"] <= bound for f in files)
    if bound == 300_000:
        # Files are filled: far fewer than records.
        assert len(files) < len(rows) / 2


def test_empty_table(spark, tmp_path):
    assert warc.read_archives(spark, archived(spark, tmp_path, [])).count() == 0


def whole(spark, tmp_path):
    frame = spark.createDataFrame([(n, f"http://h/{n}", f"page {n} " * 30) for n in range(20)], "page_id long, url string, html string")
    rows = warc.with_revisits(frame).select(warc.record_text("page_id", "url", "html").alias("v"), "page_id").orderBy("page_id")
    return [r["v"].encode() + b"\r\n\r\n" for r in rows.collect()]


def split(found):
    found = list(found)
    return [r["record_id"] for r in found if r["kind"] == "record"], [r for r in found if r["kind"] == "gap"]


def test_salvage_of_plain_files(spark, tmp_path):
    parts = whole(spark, tmp_path)
    names = [f"urn:page:{n}" for n in range(20)]
    assert split(warc.salvage(b"".join(parts)))[0] == names
    damages = {
        "a byte of a payload": (3, parts[3][:-30] + b"#" + parts[3][-29:]),
        "a length": (4, parts[4].replace(b"Content-Length: ", b"Content-Length: 9")),
        "a head": (5, b"WXRC" + parts[5][4:]),
        "a tail that is gone": (6, parts[6][:-50]),
        "noise with a version line": (7, b"\x00" * 40 + b"WARC/1.1\r\nbroken\r\n"),
    }
    for what, (n, broken) in damages.items():
        data = b"".join([*parts[:n], broken, *parts[n + 1 :]])
        records, gaps = split(warc.salvage(data))
        assert records == names[:n] + names[n + 1 :], what
        assert [(g["begins"], g["ends"]) for g in gaps] == [(sum(map(len, parts[:n])), sum(map(len, parts[:n])) + len(broken))], what
    records, gaps = split(warc.salvage(b"".join(parts)[:-700]))
    assert records == names[: len(records)] and len(records) >= 16 and gaps[-1]["ends"] == sum(map(len, parts)) - 700


def test_salvage_of_compressed_files(spark, tmp_path):
    parts = [gzip.compress(p) for p in whole(spark, tmp_path)]
    names = [f"urn:page:{n}" for n in range(20)]
    assert split(warc.salvage(b"".join(parts)))[0] == names
    for n in (0, 9, 19):
        broken = parts[n][:40] + b"\xff\x00\xff" + parts[n][43:]
        records, gaps = split(warc.salvage(b"".join([*parts[:n], broken, *parts[n + 1 :]])))
        start = sum(map(len, parts[:n]))
        assert records == names[:n] + names[n + 1 :]
        assert [(g["begins"], g["ends"]) for g in gaps] == [(start, start + len(parts[n]))]
    assert split(warc.salvage(b"junk " * 10 + parts[0]))[0] == names[:1]
    assert split(warc.salvage(b"")) == ([], [])


def test_files_are_read_from_a_folder(spark, tmp_path):
    parts = whole(spark, tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(parts[:9]) + b"garbage")
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[9:])))
    read = warc.read_archives(spark, str(tmp_path / "in"))
    assert {r["record_id"] for r in read.where("kind = 'record'").collect()} == {f"urn:page:{n}" for n in range(20)}
    gap = read.where("kind = 'gap'").first()
    assert gap["file"].endswith("a.warc") and gap["ends"] - gap["begins"] == 7
