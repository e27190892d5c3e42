"""Sources: files in, observations out."""

import gzip
import json
import time
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F


from basketwise import session
from basketwise.operators.validation import membership, membership_of_written
from basketwise.plans.ingest import read_runs, run_ingest
from basketwise.session import FREED, run_folder, shuffles_freed
from basketwise.sinks.history import _spans, append_history, insert_or_ignore, read_history
from basketwise.sinks.periods import newest_period, publish_periods
from basketwise.sinks.snapshot import prices_snapshot, read_snapshot, write_document, write_snapshot
from basketwise.sinks.dimensions import upsert, upsert_report
from basketwise.sinks.document import publish_document, read_document_head, read_document_products, read_manifest
from basketwise.sinks.versions import VersionedTable
from basketwise.sources.dimensions import branches_of, load_dimensions, store_list
from basketwise.sources.feeds import ManualSource, PageSource, SearchSource, SurveySource
from basketwise.sources.manual import csv_fields, manual_feed, numbered_lines, read_manual
from basketwise.sources.mappings import id_mapping, page_mapping, term_mapping, unmapped
from basketwise.sources.price_documents import (
    document_cells,
    document_header,
    document_observations,
    first_usable,
    origin_of,
    read_documents,
    with_defaults,
)
from basketwise.sources.product_pages import page_feed, page_offers
from basketwise.sources.raw import raw_field, raw_fields
from basketwise.sources.registry import Feed, Registry, moment, shown_suggestions, union_all
from basketwise.sources.search_results import first_offer, response_offers, search_observations
from basketwise.sources.survey import latest_published, read_survey, survey_feed, survey_suggestions
from basketwise.operators.id_match import match_offers

NOW = datetime(2026, 9, 1, 6)


def now():
    return moment(NOW)


SURVEY = """producto,presentacion,marca,categoria,precio,fecha_registro,estado,cadena_comercial,nombre_comercial,municipio
LECHE ENTERA,"BOTE 1 LT",LALA,x,$ 29.50,2025/11/03,Querétaro,WAL-MART,"Suc. ""Centro"", norte",Querétaro
Leche light,BOTE 1 LT,LALA,x,31,2025-11-04,QUERÉTARO,Mega  Soriana,S1,Querétaro
Leche entera,BOTE 1 LT,LALA,x,0,2025/11/03,Querétaro,Chedraui,C1,Querétaro
Leche entera,BOTE 1 LT,LALA,x,28,2025/11/03,Jalisco,Chedraui,C1,Guadalajara
Leche entera,BOTE 1 LT,LALA,x,28,2025/11/03,Querétaro,Tienda Don Juan,C1,Querétaro
Leche light,BOTE 1 LT,LALA,x,30,2025/11/02,queretaro,Soriana,S1,Querétaro
"""


def test_survey_is_read_by_header_and_matched(spark, tmp_path):
    (tmp_path / "11-2025_01.csv").write_text(SURVEY)
    (tmp_path / "10-2025_02.csv").write_text(SURVEY.splitlines()[0] + "\n")
    (tmp_path / "05-2023_01.csv").write_text("too old\n")
    found = latest_published(spark, str(tmp_path), F.lit("2026-02-03").cast("timestamp_ntz"))
    assert found.endswith("11-2025_01.csv")
    assert latest_published(spark, str(tmp_path), F.lit("2020-01-01").cast("timestamp_ntz")) is None
    mapping = spark.createDataFrame([(0, "MILK", ["leche", "lala", "1 lt"], ["light"])], "entry_no int, ean string, requiere array<string>, excluye array<string>")
    observed, unmatched = survey_feed(read_survey(spark, found), mapping, now(), found)
    rows = observed.collect()
    assert [(r["ean"], r["store_id"], r["branch_id"], r["price"], r["captured_at"]) for r in rows] == [
        ("MILK", "walmart", 'Suc. "Centro", norte', 29.5, datetime(2025, 11, 3, 12))
    ]
    assert json.loads(rows[0]["raw"])["marca"] == "LALA"
    suggestions = survey_suggestions(unmatched).collect()
    assert [tuple(r) for r in suggestions] == [("Leche light | LALA | BOTE 1 LT", 2, 31.0)]


def test_survey_columns_may_come_in_any_order(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("precio, estado ,producto\n5,Querétaro,Pan\n")
    row = read_survey(spark, str(path)).first()
    assert (row["precio"], row["estado"], row["producto"], row["marca"]) == ("5", "Querétaro", "Pan", None)


MANUAL = '''# comment
   # indented comment

EAN,Store_ID,price,captured_at,branch,note
75001,heb,29.90,2026-08-29,HEB Juriquilla,"shelf, left"
,heb,10,,,
75002,heb,free,,,
75003,heb,12.345,,,"say ""hi"""
75004,heb,5,someday,,
# the end
'''


def test_manual_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(MANUAL)
    (tmp_path / "B.CSV").write_text("price,ean,store_id\r\n7,75009,walmart\r\n")
    (tmp_path / "c.txt").write_text("ean,store_id,price\n1,x,1\n")
    observed, dropped = manual_feed(read_manual(spark, str(tmp_path)), now())
    got = {r["ean"]: r for r in observed.collect()}
    assert set(got) == {"75001", "75003", "75009"}
    assert (got["75001"]["price"], got["75001"]["captured_at"]) == (29.9, datetime(2026, 8, 29, 12))
    assert json.loads(got["75001"]["raw"]) == {"archivo": "a.csv", "branch": "HEB Juriquilla", "note": "shelf, left"}
    assert (got["75003"]["price"], got["75003"]["captured_at"]) == (12.35, NOW)
    assert json.loads(got["75003"]["raw"])["note"] == 'say "hi"'
    assert got["75009"]["store_id"] == "walmart"
    assert {(r["file"], r["line_no"], r["reason"]) for r in dropped.collect()} == {
        ("a.csv", 6, "incomplete_row"), ("a.csv", 7, "invalid_price"), ("a.csv", 9, "invalid_date"),
    }


def test_line_numbers_hold_over_splits(spark, tmp_path):
    for name in ("x.csv", "y.csv"):
        (tmp_path / name).write_text("".join(f"{name}-{i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert lines.select("file_path").rdd.getNumPartitions() > 1
        assert lines.count() == 10000
        assert lines.where(F.concat_ws("-", "file", "line_no") != F.col("value")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_fields(spark):
    cases = [('a,"b,c",d', ["a", "b,c", "d"]), ('"x ""y""",', ['x "y"', ""]), ("", [""]), ('a,"open, end', ["a", "open, end"]), (",,", ["", "", ""])]
    frame = spark.createDataFrame(cases, "line string, want array<string>")
    for r in frame.select(csv_fields(F.col("line")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_documents(spark, tmp_path):
    doc = {"generatedAt": "2026-08-29T06:00:00.000", "source": "manual", "products": {"A": {"heb": 29.9, "walmart": "abc", "aurrera": None}, "B": {"heb": "5"}}}
    (tmp_path / "prices.json").write_text(json.dumps(doc, indent=2))
    documents = read_documents(spark, str(tmp_path / "prices.json"))
    header = with_defaults(document_header(documents)).first()
    assert (header["source"], header["sourceLabel"], header["currency"]) == ("manual", "Origen no declarado", "MXN")
    cells = document_cells(documents)
    got = {(r["ean"], r["store_id"]): r["price"] for r in cells.collect()}
    assert got == {("A", "heb"): 29.9, ("A", "walmart"): None, ("A", "aurrera"): None, ("B", "heb"): 5.0}
    row = document_observations(cells).where("ean = 'B'").first()
    assert (row["currency"], row["source"], row["captured_at"]) == ("MXN", "manual", datetime(2026, 8, 29, 6))


def test_first_usable_source(spark):
    schema = "ean string, store_id string, price double"
    empty = spark.createDataFrame([], schema)
    file = spark.createDataFrame([("A", "heb", 1.0)], schema)
    cache = spark.createDataFrame([("B", "heb", 2.0), ("C", "heb", 2.0)], schema)
    assert tuple(origin_of(first_usable([("db", empty), ("file", file), ("cache", cache)])).first()) == ("file", 1)
    assert tuple(origin_of(first_usable([("db", cache), ("file", file)])).first()) == ("db", 2)
    assert tuple(origin_of(first_usable([("db", empty), ("file", empty)])).first()) == ("none", 0)


def block(data):
    return f'<script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script>'


PAGES = [
    ("u1", block({"@type": "Product", "name": "N", "mpn": "M", "offers": {"price": "12.5"}}), (12.5, "InStock", "M")),
    ("u2", block("{broken") + block({"@type": "WebSite"}) + block({"offers": {"offers": [{"price": 9, "availability": "Out"}], "lowPrice": 1}}), (9.0, "Out", None)),
    ("u3", block({"@type": "Product", "offers": {"price": 0}}) + block({"@type": "Product", "sku": "S", "offers": {"lowPrice": 3, "price": 4}}), (3.0, "InStock", "S")),
    ("u4", block({"@type": "Product", "name": "no offer"}), None),
    ("u5", "<p>nothing</p>", None),
    ("u6", block({"@type": "Product", "offers": {"price": "ask"}}), None),
]


def test_pages(spark):
    pages = spark.createDataFrame([(u, h) for u, h, _ in PAGES], "url string, html string")
    got = {r["url"]: r["offer"] for r in page_offers(pages).collect()}
    for url, _, want in PAGES:
        assert (got[url] and (got[url]["price"], got[url]["availability"], got[url]["sku"])) == want, url
    mapping = spark.createDataFrame([("1", "One", "u1"), ("4", "Four", "u4"), ("", "None", "u2"), ("9", "Gone", "u9")], "ean string, producto string, url string")
    observed, suggestions = page_feed(pages, mapping, "chedraui", now())
    assert [(r["ean"], r["price"], r["captured_at"]) for r in observed.collect()] == [("1", 12.5, NOW)]
    assert [r["clave"] for r in suggestions.collect()] == ["Four (u4)"]


def test_search_results(spark):
    full = {"title": "T", "primary_offer": {"offer_price": 30.5, "offer_id": "o"}, "us_item_id": 123, "product_id": "p", "seller_name": "S", "product_page_url": "http://x"}
    fallback = {"name": "F", "extracted_price": "49.9", "us_item_id": "9"}
    bodies = [
        ("full", [full, fallback], 30.5), ("first valid", [{"price": 0}, {"price": -1}, {"price": "ask"}, {"title": "none"}, fallback], 49.9),
        ("empty", [], None), ("bad", [{"primary_price": "x"}], None),
    ]
    frame = spark.createDataFrame([(k, json.dumps({"organic_results": rs})) for k, rs, _ in bodies] + [("nothing", "{}"), ("broken", "{")], "k string, body string")
    got = {r["k"]: r["offer"] for r in first_offer(frame).collect()}
    for k, _, price in bodies:
        assert (got[k] and got[k]["price"]) == price
    assert got["nothing"] is None and got["broken"] is None
    first = got["full"]
    assert (first["us_item_id"], first["product_id"], first["offer_id"], first["seller"], first["url"]) == ("123", "p", "o", "S", "http://x")
    late = got["first valid"]
    assert (late["title"], late["product_id"], late["url"]) == ("F", "9", "https://www.walmart.com.mx/ip/9")
    assert response_offers(frame).count() == 3
    products = spark.createDataFrame([("A", "Fancy thing", "pz", 1.0, None)], "ean string, name string, unit string, pack_amount double, mapped_id string")
    offers = response_offers(frame.where("k = 'full'").withColumn("ean", F.lit("A"))).withColumn("offer", F.col("offer").withField("title", F.lit("fancy thing")))
    row = search_observations(match_offers(products, offers.limit(0), offers), "walmart", now()).first()
    assert (row["ean"], row["price"], json.loads(row["raw"])["matched_by"]) == ("A", 30.5, "name_search")


def test_mappings(spark, tmp_path):
    (tmp_path / "terms.json").write_text(json.dumps({"entradas": [{"ean": "1", "requiere": ["a", "b"], "excluye": []}, {"ean": "2", "requiere": ["c"]}]}))
    (tmp_path / "ids.json").write_text(json.dumps({"items": [{"ean": "1", "us_item_id": "001"}, {"ean": "2"}, {"us_item_id": "3"}, {"ean": "1", "us_item_id": "002"}], "_sin_mapear": [{"ean": "7", "nombre": "N", "motivo": "why"}]}))
    (tmp_path / "pages.json").write_text(json.dumps({"entradas": [{"ean": "1", "producto": "P", "url": "u"}]}))
    terms = {r["entry_no"]: r for r in term_mapping(spark, str(tmp_path / "terms.json")).collect()}
    assert terms[0]["requiere"] == ["a", "b"] and terms[1]["excluye"] is None
    assert [(r["ean"], r["us_item_id"]) for r in id_mapping(spark, str(tmp_path / "ids.json")).collect()] == [("1", "002")]
    assert unmapped(spark, str(tmp_path / "ids.json")).first()["reason"] == "why"
    assert page_mapping(spark, str(tmp_path / "pages.json")).first()["url"] == "u"


def test_dimensions(spark, tmp_path):
    stores = spark.createDataFrame([("s", "Shop", [("Suc. Satélite", "North")])], "id string, name string, branches array<struct<name: string, zone: string>>")
    assert branches_of(stores).first()["id"] == "s-suc-satelite"
    for name in ("stores", "branches", "categories", "products"):
        spark.createDataFrame([("k", "n")], "id string, name string").write.parquet(str(tmp_path / name))
    assert load_dimensions(spark, str(tmp_path)).categories.first()["name"] == "n"
    many = spark.range(300).selectExpr("string(id) AS store_id", "'n' AS name", "id")
    assert [x.id for x in store_list(many, "id")] == [str(n) for n in range(300)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert {tuple(r) for r in upsert(old, new, "id").collect()} == {(1, "a"), (2, None), (3, "c")}
    assert tuple(upsert_report(old, new, "id").first()) == (1, 1, 1)


OBS = "ean string, store_id string, branch_id string, price double, currency string, captured_at timestamp_ntz, source string, source_url string, raw string"


def observed(spark, *rows):
    return spark.createDataFrame([(e, s, b, p, "MXN", t, src, None, None) for e, s, b, p, t, src in rows], OBS)


def test_history_drops_repeats(spark, tmp_path):
    path = str(tmp_path / "history")
    batch = observed(
        spark, ("A", "x", None, 5.0, NOW, "s"), ("A", "x", None, 4.0, NOW, "s"), ("A", "x", "b", 5.0, NOW, "s"),
        ("A", "x", None, 5.0, datetime(2026, 8, 1), "s"),
    )
    append_history(spark, path, batch)
    append_history(spark, path, batch)
    assert sorted(r["price"] for r in read_history(spark, path).collect()) == [4.0, 5.0, 5.0]
    append_history(spark, path, observed(spark, ("B", "x", None, 1.0, NOW, "s")))
    assert read_history(spark, path).count() == 4
    assert insert_or_ignore(batch.limit(1), batch).count() == 3


def test_snapshot_merge_keeps_other_cells(spark, tmp_path):
    root = str(tmp_path / "snapshot")
    cells = "ean string, store_id string, price double, captured_at timestamp_ntz, source string"
    first = spark.createDataFrame([("A", "heb", 29.0, NOW, "m"), ("A", "walmart", 31.0, NOW, "m"), ("B", "walmart", 69.0, NOW, "m")], cells)
    write_snapshot(spark, root, first, "profeco+manual", "Survey + Manual", NOW, partial=False)
    later = datetime(2026, 9, 2)
    write_snapshot(spark, root, spark.createDataFrame([("A", "walmart", 30.5, later, "w")], cells), "walmart", "Walmart", later, partial=True)
    header, current = read_snapshot(spark, root)
    assert {(r["ean"], r["store_id"]): r["price"] for r in current.collect()} == {("A", "heb"): 29, ("A", "walmart"): 30.5, ("B", "walmart"): 69}
    head = header.first()
    assert (head["source"], head["sourceLabel"], head["generatedAt"]) == ("profeco+manual+walmart", "Survey + Manual + Walmart", later)
    again = datetime(2026, 9, 3)
    write_snapshot(spark, root, spark.createDataFrame([], cells), "walmart", "Walmart", again, partial=True)
    head = read_snapshot(spark, root)[0].first()
    assert (head["source"], head["sourceLabel"]) == ("profeco+manual+walmart", "Survey + Manual + Walmart")
    assert read_snapshot(spark, root)[1].count() == 3


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "snapshot")
    cells = "ean string, store_id string, price double, captured_at timestamp_ntz, source string"
    one = spark.createDataFrame([("A", "heb", 1.0, NOW, "m")], cells)
    write_snapshot(spark, root, one, "s", "S", NOW, partial=False)
    # Cells of a run that died before writing its head.
    one.withColumn("price", F.lit(9.0)).write.parquet(f"{root}/cells/29990101T000000000000")
    assert read_snapshot(spark, root)[1].first()["price"] == 1.0


def test_snapshot_document(spark, tmp_path):
    rows = [("A", "x", None, 5.0, NOW, "s"), ("A", "x", None, 6.0, datetime(2026, 8, 1), "s"), ("A", "b", None, 7.0, NOW, "s"), ("B", "x", None, 1.0, NOW, "s")]
    header, products = prices_snapshot(observed(spark, *rows), now())
    assert header.first()["generatedAt"] == "2026-09-01T06:00:00.000Z"
    write_document(products, str(tmp_path / "doc"))
    lines = [json.loads(line) for f in sorted((tmp_path / "doc").glob("*.json")) for line in f.read_text().splitlines()]
    assert lines == [{"ean": "A", "prices": {"b": 7.0, "x": 5.0}}, {"ean": "B", "prices": {"x": 1.0}}]


def concatenated(spark, root, version):
    """The document as a client gets it that reads the fragments one after the other."""
    data = b""
    for row in read_manifest(spark, root, version).orderBy("fragment").collect():
        part = open(f"{root}/fragments/{version}/{row['file']}", "rb").read()
        assert (row["begins"], row["length"]) == (len(data), len(part))
        data += part
    return json.loads(data)


def test_fragments_make_one_document(spark, tmp_path):
    keys = [f"p{n:04}" for n in range(500)] + ["é\"quoted\\", "line\nbreak", ",comma", "", "}}", '{"generatedAt"']
    rows = [(k, s, None, 1.25 + n, NOW, "s") for n, k in enumerate(keys) for s in ("x", "b")]
    rows += [("p0001", "x", None, 9.0, datetime(2026, 8, 1), "s")]
    header, products = prices_snapshot(observed(spark, *rows), now())
    root = str(tmp_path / "doc")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        version = publish_document(header, products, root, NOW)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert read_manifest(spark, root).count() > 1
    document = concatenated(spark, root, version)
    assert document.pop("products") == {r["ean"]: r["prices"] for r in products.collect()}
    assert document == header.first().asDict()
    assert list(document) == header.columns
    cells = {(r["ean"], r["store_id"]): float(r["price_text"]) for r in read_document_products(spark, root).collect()}
    assert cells == {(k, s): 1.25 + n for n, k in enumerate(keys) for s in ("x", "b")}
    assert read_document_head(spark, root, "generatedAt string").first()["generatedAt"] == header.first()["generatedAt"]


def test_document_without_products_and_unfinished_versions(spark, tmp_path):
    root = str(tmp_path / "doc")
    assert read_manifest(spark, root).count() == 0 and read_document_products(spark, root).count() == 0
    header, products = prices_snapshot(observed(spark, (None, "x", None, 1.0, NOW, "s")).where("ean = 'none'"), now())
    version = publish_document(header, products, root, NOW)
    assert concatenated(spark, root, version)["products"] == {}
    # Fragments of a run that died before its manifest.
    spark.range(1).selectExpr("'{' AS value").write.text(f"{root}/fragments/29990101T000000000000")
    assert {r["version"] for r in read_manifest(spark, root).collect()} == {version}
    header, products = prices_snapshot(observed(spark, ("A", "x", None, 1.0, NOW, "s"), (None, "x", None, 1.0, NOW, "s")), now())
    publish_document(header, products, root, datetime(2027, 1, 1))
    assert [tuple(r) for r in read_document_products(spark, root).collect()] == [("A", "x", "1.0")]
    assert concatenated(spark, root, version)["products"] == {}


def test_raw_texts_of_any_shape(spark):
    texts = ['{"a": 1, "b": {"c": [1.5, "x"]}}', '{"a": "t", "d": null}', "{}", "[1]", '"text"', "3", "{broken", "", None, '{"a": true}']
    rows = spark.createDataFrame([("s", t, 1) for t in texts] + [(None, '{"a": 2.5}', 1)], "source string, raw string, value int")
    got = {(r["source"], r["field"], r["kind"]): r["n"] for r in raw_fields(rows).collect()}
    assert got == {
        ("s", "a", "number"): 1, ("s", "a", "text"): 1, ("s", "a", "boolean"): 1, ("s", "b", "object"): 1, ("s", "d", "null"): 1,
        ("s", None, "array"): 1, ("s", None, "text"): 1, ("s", None, "number"): 1, ("s", None, "invalid"): 2, ("s", None, "missing"): 1,
        (None, "a", "number"): 1,
    }
    read = rows.select(raw_field(F.col("raw"), "$.a", "double").alias("a"), raw_field(F.col("raw"), "$.b.c[1]").alias("x")).collect()
    assert [r["a"] for r in read if r["a"] is not None] == [1.0, 1.0, 2.5] and [r["x"] for r in read if r["x"]] == ["x"]


CELLS = "ean string, store_id string, price double"


def test_a_merge_rewrites_only_the_parts_it_touches(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"), ("ean", "store_id"), ("store_id",), groups=64, spread=4)
    rows = [(f"p{n}", f"s{m}", 1.0) for n in range(50) for m in range(100)]
    assert table.merge(spark.createDataFrame(rows, CELLS)) == 1
    files = lambda: {str(f.relative_to(tmp_path)) for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    first = files()
    # One per cent of the cells, all of one store, and two that are new.
    update = [(f"p{n}", "s7", 2.0) for n in range(50)] + [("new", "s7", 3.0), (None, "s7", 4.0)]
    assert table.merge(spark.createDataFrame(update, CELLS)) == 2
    assert len(files() - first) <= 4 < len(first) / 10 and first <= files()
    wanted = {(e, s): p for e, s, p in rows} | {(e, s): p for e, s, p in update}
    assert {(r["ean"], r["store_id"]): r["price"] for r in table.read(spark).collect()} == wanted
    assert table.read(spark).count() == len(wanted)
    assert sorted(tuple(r) for r in table.read(spark, 1).collect()) == sorted(rows)
    # A missing key equals itself.
    table.merge(spark.createDataFrame([(None, "s7", 5.0), ("p1", None, 6.0)], CELLS))
    table.merge(spark.createDataFrame([("p1", None, 7.0)], CELLS))
    got = [tuple(r) for r in table.read(spark).where("ean IS NULL OR store_id IS NULL").collect()]
    assert sorted(got, key=repr) == [("p1", None, 7.0), (None, "s7", 5.0)]
    # A rule of one's own.
    table.merge(spark.createDataFrame([("p1", "s1", 9.0)], CELLS), lambda old, new: old.unionByName(new).groupBy("ean", "store_id").agg(F.min("price").alias("price")))
    assert table.read(spark).where("ean = 'p1' AND store_id = 's1'").first()["price"] == 1.0


def test_a_merge_that_died_and_one_without_rows(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"), ("ean", "store_id"))
    with pytest.raises(LookupError):
        table.read(spark)
    one = spark.createDataFrame([("A", "x", 1.0)], CELLS)
    table.merge(one)
    # Parts of a merge that died before its manifest.
    one.withColumn("price", F.lit(9.0)).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(str(tmp_path / "t" / "data" / "2-dead"))
    assert table.read(spark).first()["price"] == 1.0
    assert table.merge(one.where("false")) == 2 and table.read(spark, 2).count() == 1
    empty = VersionedTable(str(tmp_path / "e"), ("ean",))
    assert empty.merge(one.where("false")) == 1 and empty.read(spark).count() == 0
    assert empty.merge(one) == 2 and [tuple(r) for r in empty.read(spark).collect()] == [("A", "x", 1.0)]
    # A rule that drops everything it is shown.
    assert empty.merge(one, lambda old, new: new.where("false")) == 3 and empty.read(spark).count() == 0
    assert empty.merge(one) == 4 and empty.read(spark).count() == empty.read(spark, 2).count() == 1


@dataclass(frozen=True)
class Fixed:
    id: str
    rows: tuple
    name: str = "Fixed source"
    automatable: bool = True
    chains: tuple = ()

    def read(self, spark, run_at):
        if self.rows is None:
            raise OSError("file is gone")
        return Feed(observed(spark, *self.rows))


def test_ingest_run(spark, tmp_path):
    root = str(tmp_path)
    products = spark.createDataFrame([("A",), ("B",)], "ean string")
    stores = spark.createDataFrame([("x",), ("y",)], "store_id string")
    registry = Registry([
        Fixed("one", (("A", "x", "b1", 5.0, NOW, "one"), ("A", "x", "b2", 7.0, NOW, "one"), ("Z", "x", "b1", 1.0, NOW, "one"))),
        Fixed("two", (("B", "y", None, 9.0, NOW, "two"),)),
        Fixed("broken", None),
        Fixed("useless", (("A", "x", None, -1.0, NOW, "useless"),)),
    ])
    run = run_ingest(spark, registry, products, stores, root, NOW)
    assert read_history(spark, f"{root}/history").count() == 3
    header, cells = read_snapshot(spark, f"{root}/snapshot")
    assert {(r["ean"], r["store_id"]): r["price"] for r in cells.collect()} == {("A", "x"): 6.0, ("B", "y"): 9.0}
    assert header.first()["source"] == "one+two+broken+useless"
    assert {r["source"]: r["status"] for r in run.log.collect()} == {"one": "ok", "two": "ok", "broken": "failed", "useless": "failed"}
    assert {(r["source"], r["problem"]) for r in run.rejects.collect()} == {("one", "unknown_ean"), ("useless", "invalid_price")}
    assert read_runs(spark, root).where("started_at IS NOT NULL").count() == 4
    # The same run again changes nothing in the history.
    run_ingest(spark, registry, products, stores, root, datetime(2026, 9, 2))
    assert read_history(spark, f"{root}/history").count() == 3
    only = run_ingest(spark, registry, products, stores, root, datetime(2026, 9, 3), only="two", dry_run=True)
    assert only.snapshot_version is None and only.checked.count() == 1
    assert run_ingest(spark, Registry([Fixed("broken", None)]), products, stores, root, datetime(2026, 9, 4)) is None
    with pytest.raises(KeyError):
        registry.chosen("nothing")


def test_suggestions_of_all_sources(spark):
    a = spark.createDataFrame([("k", 3)], "clave string, veces bigint").withColumn("source", F.lit("a"))
    b = spark.createDataFrame([("m", 5), ("n", 1)], "clave string, veces bigint").withColumn("source", F.lit("b"))
    assert [r["clave"] for r in shown_suggestions(union_all([a, b]), 2).collect()] == ["m", "k"]


def test_survey_files_go_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("producto,precio,estado\nleche,10,QRO\n")
    (tmp_path / "b.csv").write_text("precio,producto\n20,pan\n")
    (tmp_path / "c.csv").write_text("precio,producto\n30,sal\n")
    rows = read_survey(spark, str(tmp_path)).select("producto", "precio", "estado").collect()
    assert sorted(tuple(r) for r in rows) == [("leche", "10", "QRO"), ("pan", "20", None), ("sal", "30", None)]


def test_a_long_typed_line_is_cut_in_one_pass(spark):
    plain, quoted = ",".join(["x"] * 20_000), ",".join(['"a, b"'] * 20_000)
    frame = spark.createDataFrame([(plain,), (quoted,)], "line string")
    got = frame.select(csv_fields(F.col("line")).alias("f")).collect()
    assert [len(r["f"]) for r in got] == [20_000, 20_000] and set(got[1]["f"]) == {"a, b"}


def test_snapshots_of_the_same_time_are_versions_of_their_own(spark, tmp_path):
    cells = spark.createDataFrame([("A", "x", 1.0, NOW, "s")], "ean string, store_id string, price double, captured_at timestamp_ntz, source string")
    first = write_snapshot(spark, str(tmp_path), cells, "a", "A", NOW, partial=False)
    second = write_snapshot(spark, str(tmp_path), cells.withColumn("ean", F.lit("B")), "b", "B", NOW, partial=True)
    header, found = read_snapshot(spark, str(tmp_path))
    assert first < second == header.first()["version"] and header.first()["source"] == "a+b"
    assert {r["ean"] for r in found.collect()} == {"A", "B"}


def test_the_four_sources_of_a_run(spark, tmp_path):
    """Each source reads its own files; one run takes them all, and one that is missing fails alone."""
    write = lambda name, content: (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
    write("survey.csv", SURVEY)
    write("terms.json", {"entradas": [{"ean": "A", "requiere": ["leche"], "excluye": []}]})
    (tmp_path / "typed").mkdir()
    (tmp_path / "typed" / "a.csv").write_text("ean,store_id,price\nA,heb,31\n,heb,5\n")
    spark.createDataFrame([(u, h) for u, h, _ in PAGES], "url string, html string").write.parquet(str(tmp_path / "pages"))
    write("page-mapping.json", {"entradas": [{"ean": "B", "producto": "One", "url": "u1"}]})
    body = json.dumps({"organic_results": [{"title": "fancy thing", "price": "7", "us_item_id": "9"}]})
    spark.createDataFrame([("C", "id", body)], "ean string, by string, body string").write.parquet(str(tmp_path / "responses"))
    spark.createDataFrame([("C", "Fancy thing", "pz", 1.0)], "ean string, name string, unit string, pack_amount double").write.parquet(str(tmp_path / "wanted"))
    write("ids.json", {"items": [{"ean": "C", "us_item_id": "9"}], "_sin_mapear": []})
    path = lambda name: str(tmp_path / name)
    registry = Registry([
        SurveySource(path("survey.csv"), path("terms.json")),
        ManualSource(path("typed")),
        PageSource(path("pages"), path("page-mapping.json"), "chedraui"),
        SearchSource(path("responses"), path("wanted"), path("ids.json"), "walmart"),
        SurveySource(path("nowhere"), path("terms.json"), newest_only=True, id="gone"),
    ])
    products = spark.createDataFrame([("A",), ("B",), ("C",)], "ean string")
    stores = spark.createDataFrame([(s,) for s in ("heb", "chedraui", "walmart", "aurrera", "soriana", "lacomer")], "store_id string")
    run = run_ingest(spark, registry, products, stores, path("run"), NOW)
    log = {r["source"]: (r["status"], r["prices_written"]) for r in run.log.collect()}
    assert log.pop("survey")[0] == "ok"
    assert log == {"manual": ("ok", 1), "pages": ("ok", 1), "search": ("ok", 1), "gone": ("failed", 0)}
    outcome = registry.read(spark, NOW, "manual")[0]
    assert [r["clave"] for r in outcome.feed.suggestions.collect()] == ["a.csv:3 incomplete_row"]


def test_survey_reads_files_of_every_name(spark, tmp_path):
    header = "producto,presentacion,marca,precio,fecha_registro,estado,cadena_comercial,nombre_comercial,municipio"
    for n, name in enumerate(("a.csv", "B.CSV", "c.Csv", "d.txt")):
        (tmp_path / name).write_text(f"{header}\np{n},1,m,{n},2025-01-01,q,c,n,m\n")
    with gzip.open(tmp_path / "e.csv.gz", "wt") as out:
        out.write("precio,producto\n4,p4\n")
    got = read_survey(spark, str(tmp_path)).select("producto", "precio").collect()
    assert sorted(map(tuple, got)) == [(f"p{n}", str(n)) for n in range(5)]


def folders_read(frame):
    """Rows of a table, and how many of its folders the scan that gave them has listed."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec"):
        plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan.plan()
    leaves = plan.collectLeaves()
    return rows, [leaves.apply(i).metrics().apply("numPartitions").value() for i in range(leaves.size())]


def test_the_newest_period_is_read_alone(spark, tmp_path):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    path, fields = str(tmp_path / "periods"), "product string, price double, period int"
    first = 2025 * 24
    publish_periods(spark.range(400).selectExpr("CAST(id AS STRING) AS product", "1.0D AS price", f"CAST({first} + id % 40 AS INT) AS period"), path)
    # 2025-07-10 lies in half month 12 of its year.
    rows, folders = folders_read(newest_period(spark, path, fields, at("2025-07-10")))
    assert {r["period"] for r in rows} == {first + 12} and len(rows) == 10 and folders == [1]
    # Published again, a period is replaced, and only that one; a row without a period is in no window.
    publish_periods(spark.createDataFrame([("new", 2.0, first + 12), ("lost", 3.0, None)], fields), path)
    rows, folders = folders_read(newest_period(spark, path, fields, at("2025-07-10")))
    assert [(r["product"], r["price"]) for r in rows] == [("new", 2.0)] and folders == [1]
    assert spark.read.schema(fields).parquet(path).count() == 400 - 10 + 2
    # No rows publish nothing; a window without a period has no rows.
    publish_periods(spark.createDataFrame([], fields), path)
    assert spark.read.schema(fields).parquet(path).count() == 400 - 10 + 2
    assert newest_period(spark, path, fields, at("2020-01-01")).count() == 0
    assert {r["period"] for r in newest_period(spark, path, fields, at("2027-01-01")).collect()} == {first + 39}


def test_typed_lines_are_numbered_where_they_are(spark, tmp_path):
    """Only a row per split and per file is moved, however small a table Spark would broadcast on its own."""
    for name in ("x.csv", "y.csv"):
        (tmp_path / name).write_text("# note\n\nean,Price\n" + "".join(f'"{name}, {i}",{i}\n' for i in range(2000)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert "SortMergeJoin" not in lines._jdf.queryExecution().sparkPlan().toString()
        rows = read_manual(spark, str(tmp_path))
        assert rows.where(F.concat(F.col("file"), F.lit(", "), F.col("line_no") - 4) == F.col("ean")).count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_run_consolidates_only_what_a_cell_keeps(spark, tmp_path, monkeypatch):
    from basketwise.plans import ingest

    seen, plain = [], ingest.consolidate
    monkeypatch.setattr(ingest, "consolidate", lambda rows: seen.append(rows.columns) or plain(rows))
    products, stores = spark.createDataFrame([("A",)], "ean string"), spark.createDataFrame([("x",)], "store_id string")
    registry = Registry([Fixed("one", (("A", "x", None, 5.0, NOW, "one"), ("A", "x", "b", 7.0, NOW, "one")))])
    run_ingest(spark, registry, products, stores, str(tmp_path / "run"), NOW)
    assert seen == [["ean", "store_id", "branch_id", "price", "captured_at", "source"]]
    assert [r["price"] for r in read_snapshot(spark, str(tmp_path / "run" / "snapshot"))[1].collect()] == [6.0]


def shuffle_files(spark):
    """Names of the shuffle files that the disk holds."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark, tmp_path):
    before, was = shuffle_files(spark), spark.conf.get(FREED, None)
    with shuffles_freed(spark):
        spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count().write.parquet(str(tmp_path / "t"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # they are removed in the background
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(FREED, None) == was


def test_a_run_frees_shuffles_and_keeps_one_copy_of_its_rows(spark, tmp_path):
    products, stores = spark.createDataFrame([("A",), ("B",)], "ean string"), spark.createDataFrame([("x",)], "store_id string")
    rows = tuple((ean, "x", f"b{n}", 5.0 + n, NOW, "one") for n in range(50) for ean in ("A", "B", "Z"))
    staged = []
    folders = lambda: {p.name for p in Path(run_folder(spark).removeprefix("file://")).glob("observed-*")}
    when_staged = lambda source: staged.append((source, spark.conf.get(FREED), len(folders() - kept)))
    kept, was = folders(), spark.conf.get(FREED, None)
    registry = Registry([Fixed("one", rows), Fixed("broken", None)])
    run = run_ingest(spark, registry, products, stores, str(tmp_path / "run"), NOW, when_staged=when_staged)
    assert staged == [("one", "true", 1)] and folders() == kept and spark.conf.get(FREED, None) == was
    assert {r["source"]: (r["prices_written"], r["n_rejected"]) for r in run.log.collect()} == {"one": (100, 50), "broken": (0, 0)}


def test_large_batches_go_in_slices_with_the_same_result(spark, tmp_path, monkeypatch):
    from basketwise.plans import ingest

    products = spark.createDataFrame([(f"P{n}",) for n in range(20)], "ean string")
    stores = spark.createDataFrame([("x",), ("y",)], "store_id string")
    rows = [(f"P{n % 22}", "xy"[n % 2], f"b{n % 3}" if n % 5 else None, 1.0 + n % 7, datetime(2025, 1 + n % 11, 1 + n % 2, 12), "one") for n in range(200)]
    rows += [(e, s, b, p + 1, t, o) for e, s, b, p, t, o in rows[::10]] + [("P1", "x", "b", 3.0, None, "one")]
    seen, plain = [], ingest.consolidate
    monkeypatch.setattr(session, "SLICES", 3)
    monkeypatch.setattr(ingest, "consolidate", lambda part: seen.append(part) or plain(part))
    found = []
    for name, least in (("whole", 1 << 20), ("slices", 8)):
        monkeypatch.setattr(session, "SLICE_ROWS", least)
        root = str(tmp_path / name)
        for day in (1, 2):  # the second run finds all of it in the history
            run_ingest(spark, Registry([Fixed("one", tuple(rows))]), products, stores, root, datetime(2026, 9, day))
        found.append([sorted(map(repr, part.drop("version").collect())) for part in (read_history(spark, f"{root}/history").where("ean <> 'P1'"), read_snapshot(spark, f"{root}/snapshot")[1])])
    assert len(seen) == 2 + 2 * session.SLICES
    assert found[0] == found[1] and len(found[0][0]) > 50
    # Every slice is in months that follow each other, and a row without one is in a slice of its own.
    dated = observed(spark, *rows).withColumn("captured_month", F.trunc("captured_at", "month"))
    spans = _spans(dated)
    assert spans[0] == (None, None) and 1 < len(spans[1:]) <= session.SLICES
    assert spans[1][0].month == 1 and spans[-1][1].month == 11 and all(a[1] < b[0] for a, b in zip(spans[1:], spans[2:]))


def test_keys_of_written_rows_are_known_as_before(spark, tmp_path):
    spark.createDataFrame([(k, n) for n, k in enumerate(["a", "a", "b", "c", None])], "ean string, n int").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for keys in (["a", "b"], ["a", "a", "b", "b", "b", None], [], ["a", "b", "c"], [None]):
        table = spark.createDataFrame([(k,) for k in keys], "ean string")
        want, got = (f(rows, table, "ean", "known") for f in (membership, membership_of_written))
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_typed_files_may_be_gzipped_where_the_source_says_so(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as out:
        out.write("# note\nean,store_id,price\nA,heb,31\n,heb,5\n")
    (tmp_path / "b.csv").write_text("ean,store_id,price\nB,heb,32\n")
    eans = lambda source: sorted(r["ean"] for r in source.read(spark, NOW).observations.collect())
    assert eans(ManualSource(str(tmp_path))) == ["B"]
    assert eans(ManualSource(str(tmp_path), packed=True)) == ["A", "B"]
    left_out = ManualSource(str(tmp_path), packed=True).read(spark, NOW).suggestions.collect()
    assert [r["clave"] for r in left_out] == ["a.csv.gz:4 incomplete_row"]


def test_only_folders_of_the_run_are_discarded(spark, tmp_path):
    with pytest.raises(ValueError):
        session.discard(spark, str(tmp_path))
    assert tmp_path.exists()
