"""Written lists, shared links and saved baskets."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from basketwise.functions.links import search_url
from basketwise.functions.numbers import number, price_in_text, round2
from basketwise.operators.baskets import first_items, merge_lines, numbered_lines, read_shared, rehydrate_saved, share
from basketwise.operators.shopping import store_list_frame, with_default_branch
from basketwise.plans.baskets import parse_lists
from basketwise.sources.dimensions import search_catalog, searchable

PRODUCTS = "position int, ean string, slug string, name string, category string, unit string, pack struct<amount: double, unit: string>, aliases array<string>"
CATALOG = [
    (0, "10000001", "leche-lala-1l", "Leche Lala Entera 1 Litro", "lacteos", "pz", (1000.0, "ml"), ["leche", "leche lala"]),
    (1, "10000002", "huevo-30", "Huevo Blanco San Juan (30 piezas)", "lacteos", "pqte", (30.0, "pz"), ["huevo", "huevos", "huevo san juan", "30 huevos"]),
    (2, "10000003", "queso-400", "Queso Panela FUD 400g", "lacteos", "pz", (400.0, "g"), ["queso panela", "panela"]),
    (3, "10000004", "atun-140", "Atún Dolores en Agua 140g", "despensa", "pz", (140.0, "g"), ["atun", "atun dolores", "lata de atun"]),
    (4, "10000005", "papel-12", "Papel Higiénico Pétalo 12 rollos", "hogar", "pqte", (12.0, "pz"), ["papel de bano"]),
    (5, "10000006", "detergente-1kg", "Detergente Ariel 1kg", "hogar", "pz", (1000.0, "g"), ["detergente", "detergente ariel"]),
    (6, "10000007", "cola-2-5", "Refresco Coca-Cola 2.5 Litros", "bebidas", "pz", (2500.0, "ml"), ["coca cola", "coca"]),
    (7, "10000008", "cafe-120", "Café Soluble Nescafé 120g", "despensa", "pz", (120.0, "g"), ["cafe", "nescafe"]),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, PRODUCTS)


GOLDEN = [
    ("2 leche lala", "10000001", 2), ("1 latas de atun dolores", "10000004", 1), ("3 latas de atun dolores", "10000004", 3),
    ("500g queso panela", "10000003", 2), ("1.5 l coca cola", "10000007", 1), ("5 l coca cola", "10000007", 2),
    ("1kg detergente ariel", "10000006", 1), ("2 kg detergente ariel", "10000006", 2), ("30 huevos", "10000002", 1),
    ("60 huevos", "10000002", 2), ("12 rollos papel de bano", "10000005", 1), ("1 cartera de huevo san juan", "10000002", 1),
    ("2 paquetes de papel de baño", "10000005", 2), ("papel de baño", "10000005", 1), ("2 CAFÉ NESCAFÉ", "10000008", 2),
    ("0 leche", "10000001", 1), ("1,5 l coca", "10000007", 1), ("500 g huevo", "10000002", 1), ("0.5 leche", "10000001", 0.5),
]


def test_quantities(spark, catalog):
    lists = spark.createDataFrame([(n, text + "\n") for n, (text, _, _) in enumerate(GOLDEN)], "basket_id int, text string")
    got = {r["basket_id"]: r for r in parse_lists(lists, catalog, searchable(catalog, "position")).collect()}
    for n, (text, ean, quantity) in enumerate(GOLDEN):
        assert (got[n]["ean"], got[n]["quantity"]) == (ean, quantity), text
    notes = {GOLDEN[n][0]: r["measure_note"] for n, r in got.items()}
    assert notes["500g queso panela"] == "pediste 500 g · cada presentación trae 400 g"
    assert notes["500 g huevo"] == "no se pudo convertir 500 g a presentaciones; se asumió 1"
    assert notes["2 leche lala"] is None


def test_lists_are_split_and_repeats_added(spark, catalog):
    lists = [
        ("lines", "2 leche lala\r\n\r\n1 atun\nLECHE\n"),
        ("commas", "leche, atun, cafe"),
        ("both", "leche, entera\natun"),
        ("custom", "2kg Zanahoria\n2kg Zanahoria"),
    ]
    rows = parse_lists(
        spark.createDataFrame(lists, "basket_id string, text string"), catalog, searchable(catalog, "position")
    ).collect()
    by_list = {}
    for r in rows:
        by_list.setdefault(r["basket_id"], []).append(r)
    assert {r["ean"]: r["quantity"] for r in by_list["lines"]} == {"10000001": 3, "10000004": 1}
    first = next(r for r in by_list["lines"] if r["ean"] == "10000001")
    assert (first["line"], first["raw_input"]) == (0, "2 leche lala")
    assert len(by_list["commas"]) == 3 and len(by_list["both"]) == 2
    custom = by_list["custom"]
    assert len(custom) == 2
    assert all((r["name"], r["unit"], r["quantity"], r["is_custom"]) == ("Zanahoria", "kg", 2, True) for r in custom)
    assert custom[0]["estimated_prices"]["aurrera"] == 32.9 and custom[0]["ean"] is None


def encoded(items):
    return base64.urlsafe_b64encode(json.dumps(items).encode()).decode().rstrip("=")


def test_shared_baskets_trust_only_the_catalog(spark, catalog):
    good = {"c": "leche-lala-1l", "e": "x", "n": "Gratis", "u": "pz", "q": 2, "x": False, "prices": {"heb": 1}}
    shared = [
        ("good", encoded([good, {"e": "10000003", "q": "3"}, {"n": "Flores" * 40, "u": "manojo", "q": 1.5, "x": True}])),
        ("bad quantities", encoded([{**good, "q": q} for q in (0, -5, 1e6, "muchas", None)])),
        ("too many", encoded([good] * 61)),
        ("most", encoded([good] * 60)),
        ("empty", encoded([])),
        ("unknown", encoded([{"c": "nada", "n": "Nada", "q": 1, "x": False}, {"c": "nada", "n": "Pan", "q": 1, "x": True}])),
        ("junk", "%%%not base64%%%"),
        ("not a list", encoded({"c": 1})),
        ("an object", encoded({"n": "Pan", "u": "pz", "q": 1, "x": True})),
    ]
    rows = read_shared(spark.createDataFrame(shared, "basket_id string, payload string"), catalog).collect()
    by_basket = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        by_basket.setdefault(r["basket_id"], []).append(r)
    assert set(by_basket) == {"good", "most", "unknown"}
    milk, cheese, flowers = by_basket["good"]
    assert (milk["ean"], milk["name"], milk["quantity"], milk["is_custom"]) == ("10000001", "Leche Lala Entera 1 Litro", 2, False)
    assert (cheese["catalog_id"], cheese["quantity"]) == ("queso-400", 3)
    assert flowers["is_custom"] and len(flowers["name"]) == 120 and flowers["unit"] == "manojo"
    assert len(by_basket["most"]) == 60
    assert [(r["name"], r["is_custom"]) for r in by_basket["unknown"]] == [("Pan", True)]


def test_share_keeps_at_most_sixty_items(spark, catalog):
    rows = [("b", n, "leche-lala-1l", "10000001", "Leche ñandú", "pz", 1.0 + n, False) for n in range(80)]
    basket = spark.createDataFrame(rows, "basket_id string, line int, catalog_id string, ean string, name string, unit string, quantity double, is_custom boolean")
    payload = share(basket, ["line"])
    text = payload.first()["payload"]
    assert not set(text) & set("+/=")
    items = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    assert len(items) == 60 and items[0]["n"] == "Leche ñandú" and items[59]["q"] == 60.0
    back = read_shared(payload, catalog).collect()
    assert sorted(r["quantity"] for r in back) == [1.0 + n for n in range(60)]
    assert first_items(basket, ["line"], 3).count() == 3
    # Only a link is cut; a basket keeps all its lines.
    assert sorted(r["position"] for r in numbered_lines(basket, ["line"]).collect()) == list(range(1, 81))


def test_a_payload_is_decoded_once(spark, catalog):
    payloads = spark.createDataFrame([("b", "eHh4"), ("c", None)], "basket_id string, payload string")
    read = read_shared(payloads, catalog)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("unbase64(") == 1
    assert read.count() == 0


def test_merge_keeps_the_first_line(spark):
    rows = [("b", "A", 2, 1.0, "late"), ("b", "A", 1, 2.0, "early"), ("b", None, 3, 1.0, "c"), ("b", None, 4, 1.0, "c")]
    frame = spark.createDataFrame(rows, "basket_id string, catalog_id string, line int, quantity double, note string")
    got = {(r["catalog_id"], r["line"]): (r["quantity"], r["note"]) for r in merge_lines(frame, ["note"], ["line"]).collect()}
    assert got == {("A", 1): (3.0, "early"), (None, 3): (1.0, "c"), (None, 4): (1.0, "c")}


def test_saved_baskets_are_hung_on_the_catalog(spark, catalog):
    rows = [
        ("b", 0, "leche-lala-1l", "old name", "x", "kg", 2.0, None, {"heb": 1.0}),
        ("b", 1, "gone", "Mine", "x", "kg", 1.0, None, {"heb": 2.0}),
        ("b", 2, None, "Own", "x", "kg", 1.0, {"heb": 3.0}, {"heb": 4.0}),
    ]
    schema = "basket_id string, line int, catalog_id string, name string, category string, unit string, quantity double, estimated_prices map<string,double>, prices map<string,double>"
    got = {r["line"]: r for r in rehydrate_saved(spark.createDataFrame(rows, schema), catalog).collect()}
    assert (got[0]["ean"], got[0]["name"], got[0]["estimated_prices"]) == ("10000001", "Leche Lala Entera 1 Litro", None)
    assert got[1]["is_custom"] and got[1]["estimated_prices"] == {"heb": 2.0}
    assert got[2]["estimated_prices"] == {"heb": 3.0}


def test_numbers(spark):
    rows = [("$ 1,234.50", 1234.5), ("-5", 5.0), ("0", None), ("n/a", None), ("1.2.3", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want double").select(price_in_text(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    texts = [("1e3", 1000.0), (" 7 ", 7.0), ("5d", None), ("abc", None), ("", None), ("-2.5", -2.5)]
    got = spark.createDataFrame(texts, "t string, want double").select(number(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    halves = spark.createDataFrame([(1.005, 1.0), (2.675, 2.68), (-0.125, -0.12), (0.125, 0.13)], "x double, want double")
    assert all(a == b for a, b in halves.select(round2(F.col("x")), "want").collect())


def test_links_and_lists(spark, catalog):
    url = spark.range(1).select(search_url(F.lit("https://shop/?q={query}"), F.lit("café & té")).alias("u")).first()["u"]
    assert url == "https://shop/?q=caf%C3%A9%20%26%20t%C3%A9"
    frame = spark.range(1).select(store_list_frame(F.lit("Shop"), F.lit("pickup")).alias("f")).first()["f"]
    assert (frame["title"], frame["mode"]) == ("Lista para Shop", "Modalidad deseada: Recoger en tienda")
    assert [r["ean"] for r in search_catalog(catalog, "despensa", "NESCAFE").collect()] == ["10000008"]
    assert search_catalog(catalog, "all", "café").count() == 1
    # The search does not fold accents.
    assert search_catalog(catalog, None, "higienico").count() == 0
    branches = spark.createDataFrame([("s", "b1", "One", 1), ("s", "b0", "Zero", 0), ("t", "c", "C", 0)], "store_id string, branch_id string, branch_name string, position int")
    stores = spark.createDataFrame([("s",), ("t",)], "store_id string")
    assert {r["store_id"]: r["branch_id"] for r in with_default_branch(stores, branches).collect()} == {"s": "b0", "t": "c"}
    picked = spark.createDataFrame([("s", "b1")], "store_id string, branch_id string")
    assert {r["store_id"]: r["branch_id"] for r in with_default_branch(stores, branches, picked).collect()} == {"s": "b1", "t": "c"}


def test_patterns_meet_a_written_line_once(spark):
    from basketwise.functions.units import NUMBER_START, with_custom_name, with_quantity

    frame = spark.createDataFrame([("2 kg de Pan", True), ("arroz", True), ("3 latas", True), ("2 kg de Pan", False), (None, True)], "written string, custom boolean")
    read = with_quantity(frame, "written")
    named = with_custom_name(frame, "written", F.col("custom"))
    for plan in (read, named):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count(NUMBER_START) == 1
    assert [r["term"] for r in read.collect()] == ["pan", "arroz", "3 latas", "pan", None]
    assert [r["custom_name"] for r in named.collect()] == ["Pan", "Arroz", "3 latas", None, None]


def test_lines_of_a_basket_are_grouped_by_numbers(spark, tmp_path):
    from basketwise.plans.bindings import basket_lines

    rows = [(1, 7, 2.0, 1), (1, 7, 3.0, 4), (1, None, 1.0, 2), (2, 7, 1.0, 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = basket_lines(spark, str(tmp_path))
    assert {(r["basket_id"], r["ean"], r["item_id"], r["quantity"], r["line"]) for r in got.collect()} == {
        (1, "7", "7", 5.0, (1 << 40) + 7), (1, None, None, 1.0, None), (2, "7", "7", 1.0, (1 << 40) + 7)
    }
    aggregates = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys" in x]
    assert aggregates and not any("cast" in x or "as string" in x for x in aggregates)
