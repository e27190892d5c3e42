"""Consolidation, validation, coverage, plausibility."""

from datetime import datetime

from pyspark.sql import functions as F

from basketwise.functions.dates import freshness_label, half_month_label, is_stale, survey_date
from basketwise.operators.consolidation import (
    consolidate,
    latest_prices,
    median_against_latest,
    median_prices,
    product_history,
    with_spread,
)
from basketwise.operators.coverage import (
    catalog_coverage,
    contract_metrics,
    contract_report,
    coverage_by_store,
    freshness,
    unpriced_products,
)
from basketwise.operators.id_match import ids_to_review, match_offers, match_telemetry, unmatched_products
from basketwise.operators.plausibility import with_plausibility
from basketwise.operators.validation import classify_cells, sanitise_issues, sanitised, valid_rows, with_problems
from basketwise.plans.views import register_views
from basketwise.sources.registry import moment
from basketwise.sources.survey import candidate_periods

OBS = "ean string, store_id string, branch_id string, price double, captured_at timestamp_ntz, source string"


def at(day, hour=12):
    return datetime(2025, 1, day, hour)


def observations(spark, *rows):
    return spark.createDataFrame([(e, s, b, p, t, "src") for e, s, b, p, t in rows], OBS)


def test_median_of_odd_and_even_groups(spark):
    rows = [("A", "x", "1", 10.0, at(1)), ("A", "x", "2", 11.0, at(2)), ("A", "x", "3", 30.0, at(3)),
            ("B", "x", "1", 10.0, at(1)), ("B", "x", "2", 10.25, at(2)), ("C", "x", "1", 3.0, at(1))]
    got = {r["ean"]: r for r in median_prices(observations(spark, *rows)).collect()}
    assert (got["A"]["price"], got["A"]["n_obs"], got["A"]["price_min"], got["A"]["price_max"]) == (11, 3, 10, 30)
    assert got["B"]["price"] == 10.13 and got["C"]["price"] == 3
    assert {r["ean"] for r in with_spread(median_prices(observations(spark, *rows))).collect()} == {"A", "B"}


def test_one_hot_group_has_an_exact_median(spark):
    hot = spark.range(20001).select(
        F.lit("A").alias("ean"), F.lit("x").alias("store_id"), F.col("id").cast("string").alias("branch_id"),
        (F.col("id") % 101 / 4 + 1).alias("price"), F.lit("2025-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit("s").alias("source"),
    )
    assert median_prices(hot).first()["price"] == hot.agg(F.median("price")).first()[0]


def test_representative_is_the_first_of_the_latest(spark):
    rows = [("A", "x", "b1", 10.0, at(3), 0), ("A", "x", "b2", 12.0, at(3), 1), ("A", "x", "b3", 20.0, at(1), 2), ("A", "x", "b4", 5.0, None, 3)]
    frame = spark.createDataFrame(
        [(*r[:5], "src", r[5]) for r in rows], OBS + ", seq int"
    )
    got = consolidate(frame, ties=(-F.col("seq"),)).first()
    assert (got["branch_id"], got["captured_at"], got["price"], got["n_obs"]) == ("b1", at(3), 11, 4)
    assert latest_prices(frame, ties=(-F.col("seq"),)).first()["price"] == 10


def test_latest_settles_equal_times(spark):
    rows = [("A", "x", "b1", 10.0, at(3)), ("A", "x", "b2", 12.0, at(3)), ("A", "y", "b1", 1.0, at(1)), ("A", "y", "b1", 2.0, at(2))]
    got = {r["store_id"]: r["price"] for r in latest_prices(observations(spark, *rows)).collect()}
    assert got == {"x": 12, "y": 2}
    compared = {r["store_id"]: r["difference"] for r in median_against_latest(observations(spark, *rows)).collect()}
    assert compared == {"x": 1, "y": 0.5}


def test_history_of_a_product(spark):
    rows = [("A", "x", "b", float(d), at(d)) for d in (1, 10, 20, 5)] + [("B", "x", "b", 1.0, at(20))]
    got = [r["price"] for r in product_history(observations(spark, *rows), "A", moment(datetime(2025, 1, 20, 12)), 10).collect()]
    assert got == [10, 20]
    assert product_history(observations(spark, *rows), "A", moment(datetime(2025, 1, 20, 12)), 0).count() == 1


def test_history_in_sql(spark):
    rows = [("A", "x", "b", float(d), at(d)) for d in (1, 10, 20, 5)] + [("B", "y", "b", 1.0, at(20))]
    register_views(spark, observations(spark, *rows), datetime(2025, 1, 20, 12))
    assert [r["price"] for r in spark.sql("SELECT * FROM price_history('A', 10) ORDER BY captured_at").collect()] == [10, 20]
    assert spark.sql("SELECT * FROM price_history('A')").count() == 4
    assert {(r["ean"], r["price"]) for r in spark.table("current_prices").collect()} == {("A", 20), ("B", 1)}


def dims(spark):
    products = spark.createDataFrame([("A", "Milk"), ("B", "Eggs")], "ean string, name string")
    stores = spark.createDataFrame([("aurrera",), ("walmart",)], "store_id string")
    return products, stores


def test_problems_of_observations(spark):
    products, stores = dims(spark)
    rows = [
        ("A", "walmart", 5.0, "2025-01-01", "s", []),
        ("A", "walmart", 100000.0, "", "s", []),
        ("X", "mars", -1.0, "someday", "", ["unknown_ean", "unknown_store", "invalid_price", "invalid_date", "missing_source"]),
        ("A", "walmart", 100000.01, None, None, ["price_too_high", "missing_source"]),
        ("A", "walmart", None, None, "s", ["invalid_price"]),
        ("A", "walmart", float("nan"), None, "s", ["invalid_price", "price_too_high"]),
    ]
    frame = spark.createDataFrame(rows, "ean string, store_id string, price double, captured_at string, source string, want array<string>")
    checked = with_problems(frame, products, stores)
    for r in checked.collect():
        # NaN sorts above every number; it is invalid either way.
        assert set(r["problems"]) - {"price_too_high"} == set(r["want"]) - {"price_too_high"}, r
    assert valid_rows(checked).count() == 2


def test_sanitised_document(spark):
    products, stores = dims(spark)
    cells = spark.createDataFrame(
        [("A", "aurrera", "29", 29.0), ("A", "mars", "5", 5.0), ("A", "walmart", "-3", -3.0), ("B", "walmart", "abc", None), ("Z", "aurrera", "1", 1.0), ("Z", "walmart", "1", 1.0)],
        "ean string, store_id string, price_text string, price double",
    )
    classified = classify_cells(cells, products, stores)
    assert [tuple(r) for r in sanitised(classified).select("ean", "store_id", "price").collect()] == [("A", "aurrera", 29.0)]
    issues = {(r["issue"], r["ean"], r["store_id"]) for r in sanitise_issues(classified).collect()}
    assert issues == {
        ("unknown_ean", "Z", None), ("unknown_store", "A", "mars"), ("invalid_price", "A", "walmart"), ("invalid_price", "B", "walmart"),
    }
    assert sanitise_issues(classified).count() == 4


def test_coverage_and_contract(spark):
    products, stores = dims(spark)
    prices = spark.createDataFrame([("A", "aurrera", 1.0)], "ean string, store_id string, price double")
    assert tuple(catalog_coverage(products, prices).first()) == (2, 1, 50, 1)
    assert {tuple(r) for r in coverage_by_store(stores, prices).collect()} == {("aurrera", 1), ("walmart", 0)}
    assert [r["ean"] for r in unpriced_products(products, prices).collect()] == ["B"]

    def report(generated, currency, cells):
        header = spark.createDataFrame([(generated, currency, "Label")], "generatedAt string, currency string, sourceLabel string")
        frame = spark.createDataFrame(cells, "ean string, store_id string, price double")
        metrics = contract_metrics(header, products, stores, classify_cells(frame, products, stores), moment(datetime(2025, 2, 1)))
        return {r["code"]: (r["level"], r["n"]) for r in contract_report(metrics).collect()}

    full = [("A", "aurrera", 1.0), ("B", "walmart", 2.0)]
    assert report("2025-01-31T06:00:00.000", "MXN", full) == {"verdict": ("accepted", 0)}
    assert report("2025-01-01", "", full[:1]) == {
        "stale": ("warning", 31), "missing_currency": ("warning", 1), "empty_stores": ("warning", 1),
        "unpriced_products": ("warning", 1), "verdict": ("accepted", 4),
    }
    bad = report("2025-03-01", "MXN", [("Z", "aurrera", 1.0), ("Z", "walmart", 1.0)])
    assert bad["future_date"][0] == "error" and bad["invalid_cells"] == ("error", 1) and bad["no_usable_price"][0] == "error"
    assert bad["verdict"][0] == "rejected"
    assert report("nonsense", "MXN", full)["invalid_date"][0] == "error" and report(None, "MXN", full)["missing_date"][0] == "error"


def test_dates_and_freshness(spark):
    as_of = moment(datetime(2026, 9, 1))
    rows = [("2025/11/03", datetime(2025, 11, 3, 12)), ("el 2025-11-03 10:00", datetime(2025, 11, 3, 12)), ("3/11/2025", datetime(2026, 9, 1)), (None, datetime(2026, 9, 1)), ("2025-06-31", datetime(2025, 7, 1, 12))]
    got = spark.createDataFrame(rows, "t string, want timestamp_ntz").select(survey_date(F.col("t"), as_of).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    ages = [(0, "hoy", False), (1, "ayer", False), (5, "hace 5 días", False), (14, "hace 14 días", False), (15, "hace 15 días", True), (40, "hace 1 mes", True), (60, "hace 2 meses", True)]
    frame = spark.createDataFrame(ages, "d int, label string, stale boolean").withColumn("t", as_of - F.make_dt_interval("d"))
    for r in frame.select("*", freshness_label(F.col("t"), as_of).alias("got"), is_stale(F.col("t"), as_of).alias("s")).collect():
        assert (r["got"], r["s"]) == (r["label"], r["stale"])
    none = spark.range(1).select(freshness_label(F.lit(None).cast("timestamp_ntz"), as_of), is_stale(F.lit(None).cast("timestamp_ntz"), as_of)).first()
    assert tuple(none) == ("sin fecha", True)
    newest = freshness(observations(spark, ("A", "x", "b", 1.0, at(1)), ("A", "x", "b", 1.0, at(9))), ["ean"], moment(datetime(2025, 3, 1, 12))).first()
    assert (newest["age_days"], newest["is_old"]) == (51, True)


def test_periods_cross_the_year(spark):
    labels = [r["label"] for r in candidate_periods(spark, moment(datetime(2026, 1, 20)), 5).orderBy(F.desc("period")).collect()]
    assert labels == ["01-2026_02", "01-2026_01", "12-2025_02", "12-2025_01", "11-2025_02"]
    assert spark.range(1).select(half_month_label(F.lit(2025 * 24 + 20))).first()[0] == "11-2025_01"


PRODUCTS = {
    "milk": ("Leche Lala Entera 1 Litro", "pz", 1000.0),
    "eggs": ("Huevo Blanco San Juan (Cartera 30 piezas)", "pqte", 30.0),
    "cheese": ("Queso Panela FUD en Bloque 400g", "pz", 400.0),
    "cream": ("Crema Ácida Lala 450ml", "pz", 450.0),
    "rice": ("Arroz Súper Extra Verde Valle 900g", "pz", 900.0),
    "soap": ("Detergente en Polvo Ariel Doble Poder 1kg", "pz", 1000.0),
    "cola": ("Refresco Coca-Cola Original 2.5 Litros", "pz", 2500.0),
    "mayo": ("Mayonesa McCormick con Limón 390g", "pz", 390.0),
}
TITLES = [
    ("milk", "Leche Lala UHT entera 1 l", True), ("cheese", "Queso panela FUD 23 en bloque 400 g", True),
    ("milk", "Leche Lala deslactosada 1 l", False), ("milk", "Leche Lala entera 6 pack 1 l", False),
    ("milk", "Leche Alpura entera 1 l", False), ("milk", "", False), ("milk", None, False),
    ("cream", "Crema Lala ácida 426 ml", False), ("cream", "Crema Lala ácida 450 ml", True),
    ("rice", "Arroz Verde Valle Súper Extra 1 kg", False), ("rice", "Arroz Verde Valle 900 g", False),
    ("rice", "Arroz Verde Valle Súper Extra 900 g", True), ("eggs", "Huevo San Juan blanco 18 piezas", False),
    ("eggs", "Huevo San Juan blanco 30 piezas", True), ("soap", "Detergente Ariel polvo doble poder 4 kg", False),
    ("soap", "Detergente Ariel en polvo doble poder 1 kg", True), ("cola", "Refresco Coca Cola 2.5 l", True),
    ("cola", "Refresco Pepsi 2.5 l", False), ("mayo", "Mayonesa McCormick 390 g", False), ("mayo", "Mayonesa McCormick limón 390 g c/u", False),
]


def test_plausible_titles(spark):
    rows = [(title, *PRODUCTS[key], want) for key, title, want in TITLES]
    frame = spark.createDataFrame(rows, "title string, name string, unit string, pack double, want boolean")
    got = with_plausibility(frame, F.col("title"), F.col("name"), F.col("unit"), F.col("pack"), "got").collect()
    assert [(r["name"], r["title"]) for r in got if r["got"] != r["want"]] == []


def test_id_first_then_name(spark):
    products = spark.createDataFrame(
        [("1", *PRODUCTS["milk"], "M"), ("2", *PRODUCTS["cheese"], "old"), ("3", *PRODUCTS["cream"], None), ("4", *PRODUCTS["rice"], "R"), ("5", *PRODUCTS["eggs"], None)],
        "ean string, name string, unit string, pack_amount double, mapped_id string",
    )
    offer = "ean string, position int, offer struct<title: string, price: double, us_item_id: string>"
    by_id = spark.createDataFrame(
        [("1", 0, ("Leche Lala entera 1 l", 30.0, "M")), ("2", 0, ("Queso Manchego 400 g", 50.0, "old")), ("2", 1, ("Queso Panela FUD 400 g", 51.0, "old"))], offer
    )
    by_name = spark.createDataFrame(
        [("1", 0, ("Leche Lala entera 1 l", 29.0, "other")), ("2", 0, ("Queso crema", 9.0, "n0")), ("2", 3, ("Queso Panela FUD bloque 400 g", 52.0, "n3")),
         ("2", 5, ("Queso Panela FUD bloque 400 g", 53.0, "n5")), ("3", 0, ("Crema Lala ácida 450 ml", 20.0, "c")), ("4", 0, ("Frijol", 1.0, "f")), ("5", 1, ("Huevo San Juan 30 piezas", 70.0, None))], offer
    )
    matches = match_offers(products, by_id, by_name)
    got = {r["ean"]: (r["matched_by"], r["offer"]["price"] if r["offer"] else None) for r in matches.collect()}
    assert got == {"1": ("direct_id", 30), "2": ("name_search", 52), "3": ("name_search", 20), "4": (None, None), "5": ("name_search", 70)}
    assert {(r["ean"], r["old_id"], r["new_id"]) for r in ids_to_review(matches).collect()} == {("2", "old", "n3"), ("3", None, "c")}
    assert tuple(match_telemetry(matches).first()) == (5, 4, 1, 4, 7, 2)
    assert [r["clave"] for r in unmatched_products(matches).collect()] == ["Arroz Súper Extra Verde Valle 900g (4)"]


def test_medians_by_sorted_prices_agree_with_a_plain_median(spark):
    """Prices are sorted, not held as one value per product; unknown ones count as observations only."""
    import statistics

    amounts = {"A": [1.0, 1.0, 1.0, 5.0], "B": [2.0, None, 4.0], "C": [None, None], "D": [3.0, 1.0, 2.0, 2.0, 9.0], "E": [0.01, 0.04, 0.02, 0.03]}
    frame = observations(spark, *[(e, "x", "1", p, at(1)) for e, found in amounts.items() for p in found])
    plan = median_prices(frame)
    assert "percentile" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r["ean"]: (r["price"], r["n_obs"]) for r in plan.collect()}
    known = {e: [p for p in found if p is not None] for e, found in amounts.items()}
    cut = lambda x: int(x * 100 + 0.5) / 100
    assert got == {e: (cut(statistics.median(p)) if p else None, len(amounts[e])) for e, p in known.items()}
    assert {r["ean"]: r["price"] for r in consolidate(frame).collect()} == {e: p for e, (p, _) in got.items()}


def test_texts_of_an_offer_are_read_once_for_all_rules(spark):
    columns = "ean string, offer struct<title: string, price: double, us_item_id: string>, name string, unit string, pack_amount double"
    rows = [("A", ("Leche Lala 1 l", 2.0, "u"), "Leche Lala 1 l", "pz", 1.0), ("B", ("pan", 2.0, "u"), "Leche Lala 1 l", "pz", 1.0), ("C", (None, 2.0, "u"), None, "pz", 1.0)]
    from basketwise.operators.id_match import _plausible

    kept = _plausible(spark.createDataFrame(rows, columns))
    assert [r["ean"] for r in kept.collect()] == ["A"] and kept.columns == [c.split()[0] for c in columns.split(", ") if c.split()[0] in kept.columns]
    # Both texts are folded once each, whatever the number of rules.
    assert kept._jdf.queryExecution().executedPlan().toString().count("translate(") <= 20
