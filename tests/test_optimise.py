"""Basket optimisation: known totals, and rules that hold for any basket."""

import random

import pytest
from pyspark.sql import functions as F

from basketwise.model import Store
from basketwise.operators import optimise as o
from basketwise.operators.shopping import checklist_progress, message_lines, shopping_plan, store_bars

STORES = [Store(i, i.title()) for i in ("aurrera", "chedraui", "walmart", "soriana", "lacomer", "heb")]
LINES = "basket_id string, line bigint, item_id string, ean string, quantity double, is_custom boolean, estimated_prices map<string,double>"


def prices(spark, table):
    rows = [(ean, store, float(p)) for ean, by_store in table.items() for store, p in by_store.items()]
    return spark.createDataFrame(rows, "ean string, store_id string, price double")


def lines(spark, *rows):
    full = [(r[0], n, r[1], None if len(r) > 3 else r[1], float(r[2]), len(r) > 3, r[3] if len(r) > 3 else None) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, LINES)


def costs(spark, table, *rows, enabled=None):
    items, found = o.optimise(lines(spark, *rows), prices(spark, table), STORES, enabled)
    return items, {r["basket_id"]: r for r in found.collect()}


MILK = {"aurrera": 29, "walmart": 30, "heb": 35}
EGGS = {"aurrera": 64, "walmart": 60, "heb": 62}


def test_split_takes_each_item_where_it_is_cheapest(spark):
    items, got = costs(spark, {"A": MILK, "B": EGGS}, ("x", "A", 1), ("x", "B", 1), ("y", "A", 3))
    assert got["x"]["split_total"] == 89 and got["y"]["split_total"] == 87
    groups = [(g["store_id"], -g["cost"]) for g in got["x"]["groups"]]
    assert groups == [("walmart", 60.0), ("aurrera", 29.0)]
    split = {(r["basket_id"], r["item_id"]): (r["store_id"], r["unit_price"], r["n_offers"]) for r in o.cheapest_split(items).collect()}
    assert split[("x", "A")] == ("aurrera", 29.0, 3) and split[("x", "B")] == ("walmart", 60.0, 3)


def test_incomplete_store_does_not_win(spark):
    items, got = costs(spark, {"A": {"aurrera": 29, "walmart": 30}, "B": {"walmart": 60}}, ("x", "A", 1), ("x", "B", 1))
    assert got["x"]["best"]["store_id"] == "walmart" and got["x"]["best"]["total"] == 90
    ranking = {s["store_id"]: s for s in got["x"]["stores"]}
    assert ranking["aurrera"]["incomplete"] and ranking["aurrera"]["n_missing"] == 1
    missing = {(r["item_id"], r["store_id"]) for r in o.missing_items(items).collect()}
    assert ("B", "aurrera") in missing and ("B", "walmart") not in missing


def test_unpriced_items_and_states(spark):
    items, got = costs(spark, {"A": {"aurrera": 29}}, ("x", "A", 1), ("x", "B", 2), ("y", "B", 1))
    assert (got["x"]["n_items"], got["x"]["n_priced"], got["x"]["total_units"], got["x"]["split_total"]) == (2, 1, 3, 29)
    assert got["y"]["status"] == "no-prices"
    assert [r["basket_id"] for r in o.best_pair(items).collect()] == ["x"]
    assert {(r["basket_id"], r["item_id"]) for r in o.unpriced_items(items).collect()} == {("x", "B"), ("y", "B")}
    assert costs(spark, {"A": MILK}, ("x", "A", 1), enabled=["unknown"])[1]["x"]["status"] == "no-stores"
    assert costs(spark, {"A": MILK}, ("x", "A", 1), enabled=[])[1]["x"]["status"] == "ok"
    # Full coverage is measured over what anyone sells.
    assert got["x"]["any_store_covers_all"]


def test_enabled_stores_limit_and_order(spark):
    _, got = costs(spark, {"A": MILK}, ("x", "A", 1), enabled=["walmart", "heb"])
    assert got["x"]["split_total"] == 30 and got["x"]["groups"][0]["store_id"] == "walmart"
    same = {"A": {"aurrera": 5, "heb": 5}}
    assert costs(spark, same, ("x", "A", 1))[1]["x"]["best"]["store_id"] == "aurrera"
    assert costs(spark, same, ("x", "A", 1), enabled=["heb", "aurrera"])[1]["x"]["best"]["store_id"] == "heb"
    assert o.best_pair(costs(spark, same, ("x", "A", 1), enabled=["heb"])[0]).isEmpty()


def test_best_pair_prefers_coverage(spark):
    table = {"A": {"aurrera": 10, "chedraui": 11}, "B": {"walmart": 60, "soriana": 58}}
    items, _ = costs(spark, table, ("x", "A", 1), ("x", "B", 1))
    pair = o.best_pair(items).first()
    assert (pair["store_1"], pair["store_2"], pair["coverage"], pair["total"]) == ("aurrera", "soriana", 2, 68)


def test_custom_items_use_their_own_prices(spark):
    _, got = costs(spark, {"A": MILK}, ("x", "z", 2, {"aurrera": 30.0, "walmart": 40.0}))
    assert got["x"]["split_total"] == 60 and got["x"]["groups"][0]["store_id"] == "aurrera"


def test_savings_against_the_dearest_complete_store(spark):
    table = {"A": {"aurrera": 29, "walmart": 30, "heb": 40}, "B": {"aurrera": 64, "walmart": 60, "heb": 80}}
    items, _ = costs(spark, table, ("x", "A", 1), ("x", "B", 1))
    s = o.savings(o.basket_costs(items)).first()
    assert (s["baseline_store"], s["baseline_total"], s["baseline_is_complete"]) == ("heb", 120, True)
    assert (s["savings_vs_worst"], s["savings_pct"], s["savings_vs_best"]) == (31, 26, 1)


def test_savings_may_be_negative_without_a_complete_store(spark):
    items, _ = costs(spark, {"A": {"aurrera": 10}, "B": {"heb": 8}}, ("x", "A", 1), ("x", "B", 1))
    s = o.savings(o.basket_costs(items)).first()
    assert (s["baseline_store"], s["baseline_is_complete"], s["savings_vs_worst"]) == ("aurrera", False, -8)


def test_bad_prices_do_not_count(spark):
    table = spark.createDataFrame(
        [("A", "aurrera", -3.0), ("A", "walmart", float("nan")), ("A", "heb", 7.0), ("A", "soriana", 0.0), ("A", "mars", 1.0)],
        "ean string, store_id string, price double",
    )
    items, found = o.optimise(lines(spark, ("x", "A", 1)), table, STORES)
    row = found.first()
    assert row["split_total"] == 7 and items.rows.first()["n_offers"] == 1


def random_case(spark, seed, baskets=25, products=12):
    rng = random.Random(seed)
    table = {
        str(p): {s.id: rng.choice([5, 5.5, 6, 7.25, 9.99, 12]) for s in STORES if rng.random() < 0.6}
        for p in range(products)
    }
    rows = [
        (f"b{b}", str(p), rng.choice([1, 2, 3, 0.5]))
        for b in range(baskets)
        for p in rng.sample(range(products), rng.randint(1, 6))
    ]
    return table, rows


def brute_pair(table, rows, basket):
    mine = [(p, q) for b, p, q in rows if b == basket and table[p]]
    best = None
    for i, first in enumerate(STORES):
        for second in STORES[i + 1:]:
            total, covered = 0, 0
            for p, q in mine:
                known = [table[p][s.id] for s in (first, second) if s.id in table[p]]
                if known:
                    covered += 1
                    total += int(round(min(known) * 100) * q + 0.5)
            key = (-covered, total)
            if best is None or key < best[0]:
                best = (key, first.id, second.id)
    return best


def test_pairs_agree_with_brute_force(spark):
    table, rows = random_case(spark, 5)
    items, _ = o.optimise(lines(spark, *rows), prices(spark, table), STORES)
    got = {r["basket_id"]: r for r in o.best_pair(items).collect()}
    for basket in {b for b, _, _ in rows}:
        want = brute_pair(table, rows, basket)
        if basket not in got:
            assert want is None or want[0][0] == 0
            continue
        row = got[basket]
        assert (row["store_1"], row["store_2"]) == want[1:], basket
        assert (row["coverage"], row["total"]) == (-want[0][0], want[0][1] / 100)


@pytest.mark.parametrize("n_stores", [2, 13, 60])
def test_any_number_of_stores(spark, n_stores):
    """Stores without a price, all alike, and one that only a single item is sold in."""
    many = [Store(f"s{n:03}", f"S{n}") for n in range(n_stores)]
    table = {"A": {s.id: 5.0 for s in many[1:]}, "B": {many[-1].id: 7.0}, "C": {many[0].id: 1.0}}
    basket = lines(spark, ("x", "A", 1), ("x", "B", 2), ("x", "C", 1), ("y", "A", 1), ("z", "B", 1))
    items, found = o.optimise(basket, prices(spark, table), many)
    pairs = {r["basket_id"]: (r["store_1"], r["store_2"], r["coverage"], r["total"]) for r in o.best_pair(items).collect()}
    first, last = many[0].id, many[-1].id
    assert pairs["x"] == (first, last, 3, 20.0)
    assert pairs["y"] == (first, many[1].id, 1, 5.0) and pairs["z"] == (first, last, 1, 7.0)
    assert {r["basket_id"]: r["split_total"] for r in found.collect()} == {"x": 20.0, "y": 5.0, "z": 7.0}


def test_ties_go_to_the_store_a_basket_asks_for_first(spark):
    rows = lines(spark, ("x", "A", 1), ("y", "A", 1)).withColumn(
        "enabled", F.when(F.col("basket_id") == "x", F.array(F.lit("heb"), F.lit("aurrera"))).otherwise(F.array(F.lit("aurrera"), F.lit("heb")))
    )
    items, found = o.optimise(rows, prices(spark, {"A": {"aurrera": 5, "heb": 5, "walmart": 1}}), STORES)
    assert {r["basket_id"]: r["store_id"] for r in o.cheapest_split(items).collect()} == {"x": "heb", "y": "aurrera"}
    best = {r["basket_id"]: [s["store_id"] for s in r["stores"]] for r in found.collect()}
    assert best == {"x": ["heb", "aurrera"], "y": ["aurrera", "heb"]}
    pairs = {r["basket_id"]: (r["store_1"], r["store_2"]) for r in o.best_pair(items).collect()}
    assert pairs == {"x": ("heb", "aurrera"), "y": ("aurrera", "heb")}


def test_lines_without_the_custom_flag_are_catalog_lines(spark):
    rows = lines(spark, ("x", "A", 1), ("x", "B", 1)).withColumn("is_custom", F.lit(None).cast("boolean"))
    assert o.price_items(rows, prices(spark, {"A": MILK}), STORES).rows.count() == 2


def test_pairs_stay_within_the_stores_of_a_basket(spark):
    asked = spark.createDataFrame([("x", ["heb", "soriana", "mars"]), ("y", ["mars"]), ("z", None)], "basket_id string, asked array<string>")
    allowed = o.requested_stores(asked, "asked", STORES)
    assert {r["basket_id"]: r["status"] for r in allowed.collect()} == {"x": "ok", "y": "no-stores", "z": "ok"}
    rows = lines(spark, ("x", "A", 1), ("y", "A", 1), ("z", "A", 1)).join(allowed.select("basket_id", "enabled"), "basket_id")
    items, found = o.optimise(rows, prices(spark, {"A": MILK}), STORES)
    got = {r["basket_id"]: r for r in found.collect()}
    assert got["x"]["split_total"] == 35 and got["y"]["status"] == "no-stores" and got["z"]["split_total"] == 29
    pair = {r["basket_id"]: r for r in o.best_pair(items).collect()}
    assert {pair["x"]["store_1"], pair["x"]["store_2"]} == {"soriana", "heb"} and "y" not in pair


def test_rules_that_hold_for_any_basket(spark):
    table, rows = random_case(spark, 11, baskets=60)
    items, found = o.optimise(lines(spark, *rows), prices(spark, table), STORES)
    pairs = o.best_pair(items).select("basket_id", F.col("total").alias("pair_total"))
    found = found.join(pairs, "basket_id", "left")
    for r in found.where(F.col("status") == "ok").collect():
        for s in r["stores"]:
            assert s["coverage"] + s["n_missing"] == r["n_priced"]
        if r["any_store_covers_all"]:
            assert r["split_total"] <= r["pair_total"] + 0.02 <= r["best"]["total"] + 0.04
            assert r["savings_vs_worst"] >= 0


def test_plan_assigns_items_under_each_strategy(spark):
    table = {"A": {"aurrera": 10, "walmart": 12}, "B": {"walmart": 60, "soriana": 58}}
    items, found = o.optimise(lines(spark, ("x", "A", 1), ("x", "B", 2)), prices(spark, table), STORES)
    plan = shopping_plan(items, found, o.best_pair(items))
    got = {(r["strategy"], r["item_id"]): (r["store_id"], r["subtotal"]) for r in plan.collect()}
    assert got == {
        ("split", "A"): ("aurrera", 10.0), ("split", "B"): ("soriana", 116.0),
        ("two-stores", "A"): ("aurrera", 10.0), ("two-stores", "B"): ("soriana", 116.0),
        ("single", "A"): ("walmart", 12.0), ("single", "B"): ("walmart", 120.0),
    }
    one, costs_one = o.optimise(lines(spark, ("x", "A", 1)), prices(spark, table), STORES, ["walmart"])
    assert {r["store_id"] for r in shopping_plan(one, costs_one, o.best_pair(one), "split").collect()} == {"walmart"}
    bars = {r["store_id"]: r for r in store_bars(found).collect()}
    assert bars["walmart"]["width_pct"] == 100 and bars["aurrera"]["width_pct"] == 15 and bars["walmart"]["is_best"]
    ticked = plan.where("strategy = 'split' AND item_id = 'A'").select("basket_id", "item_id", "store_id")
    done = {r["store_id"]: r["pct_done"] for r in checklist_progress(plan.where("strategy = 'split'"), ticked).collect()}
    assert done == {"aurrera": 100, "soriana": 0}


def test_message_reads_dearest_store_first(spark):
    table = {"A": {"aurrera": 10, "walmart": 12}, "B": {"walmart": 60, "soriana": 58.5}}
    items, found = o.optimise(lines(spark, ("x", "A", 1), ("x", "B", 2), ("x", "C", 1)), prices(spark, table), STORES)
    names = spark.createDataFrame([("A", "Milk", "pz"), ("B", "Rice", "kg"), ("C", "Salt", "pz")], "ean string, name string, unit string")
    stores = spark.createDataFrame([(s.id, s.name, "Centro") for s in STORES], "store_id string, name string, branch_name string")
    text = [r["text"] for r in message_lines(items, found, names, stores, F.lit("hoy")).orderBy("section", "rank", "line").collect()]
    assert text == [
        "💰 *Total Optimizado:* $127.00 MXN",
        "🎉 *Ahorro Estimado:* $5.00 MXN (4%)",
        "📍 *Soriana* — Centro (Subtotal: $117.00):",
        "  • Rice (2 kg) -> $117.00",
        "📍 *Aurrera* — Centro (Subtotal: $10.00):",
        "  • Milk (1 pz) -> $10.00",
        "⚠️ *Sin precio (revisar en tienda):* Salt",
        "_Precios de referencia actualizados hoy._",
    ]


def test_pairs_are_priced_only_where_they_can_still_win(spark):
    """Forty stores with complete price lists: all pairs cover the most, few are priced, and the best is among them."""
    rng = random.Random(11)
    stores = [Store(f"s{k:02d}", f"S{k}") for k in range(40)]
    level = [1 + rng.gauss(0, 0.05) for _ in stores]
    table = {}
    for e in range(30):
        base = rng.uniform(10, 100)
        table[f"e{e}"] = {s.id: round(base * f * (1 + rng.gauss(0, 0.1)), 2) for s, f in zip(stores, level, strict=True)}
    rows = [(f"b{b}", f"e{e}", rng.choice([1, 2, 0.5])) for b in range(12) for e in rng.sample(range(30), 12)]
    items = o.price_items(lines(spark, *rows), prices(spark, table), stores)
    assert o.priced_pairs(items).count() < 0.05 * 12 * 780
    bought = {}
    for b, e, q in rows:
        bought.setdefault(b, []).append((e, q))
    cents = lambda p, q: int(round(p * 100) * q + 0.5)
    for r in o.best_pair(items).collect():
        totals = {
            (i, j): sum(cents(min(table[e][stores[i].id], table[e][stores[j].id]), q) for e, q in bought[r["basket_id"]])
            for i in range(40)
            for j in range(i + 1, 40)
        }
        least = min(totals, key=lambda p: (totals[p], p))
        assert (r["pair_first"], r["pair_second"], r["total"]) == (*least, totals[least] / 100)


def test_bounds_hold_for_any_basket(spark):
    """No pair costs less than its bound, whatever prices are missing and whatever the quantities."""
    rng = random.Random(3)
    table = {f"e{e}": {s.id: rng.choice([1, 5, 9.99, 20]) for s in STORES if rng.random() < 0.6} for e in range(20)}
    rows = [(f"b{b}", f"e{rng.randrange(22)}", rng.choice([0, 1, 2.5, 7, -1])) for b in range(40) for _ in range(rng.randrange(1, 9))]
    items = o.price_items(lines(spark, *rows), prices(spark, table), STORES)
    pair_lines = o._pair_lines(items)
    pairs = o._bounded_pairs(pair_lines, len(STORES)).select("basket_id", F.explode("pairs").alias("p"))
    totals = o._pair_totals(pair_lines, pairs).join(pairs.select("basket_id", "p.first", "p.second", "p.bound"), ["basket_id", "first", "second"])
    assert totals.count() > 40 and totals.where("bound > 2 * total").count() == 0


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("n_stores", [3, 5])
def test_pairs_in_a_row_agree_with_pairs_by_bounds(spark, monkeypatch, n_stores, own):
    """Few stores need no bounds; both ways give the same pair, also with missing prices, ties and lists of a basket's own."""
    table, rows = random_case(spark, 7 + n_stores, baskets=40)
    basket = lines(spark, *rows)
    if own:
        number = F.substring("basket_id", 2, 9).cast("int")
        asked = F.when(number % 4 == 0, F.lit("heb")).otherwise("walmart")
        turned = F.array(asked, F.lit("aurrera"), F.lit("mars"), F.lit("chedraui"), asked)
        basket = basket.withColumn("enabled", F.when(number % 5 == 0, F.array(F.lit("aurrera"))).otherwise(turned))
    items = o.price_items(basket, prices(spark, table), STORES[:n_stores])
    fast = sorted(map(tuple, o.best_pair(items).collect()))
    monkeypatch.setattr(o, "FIRST_PAIRS", 1)
    assert fast == sorted(map(tuple, o.best_pair(items).collect())) and fast


def test_lines_of_a_plan_are_exchanged_once(spark):
    """Totals and pairs leave the tasks as one row per basket; only the plan itself moves lines."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, rows = random_case(spark, 3)
        items, found = o.optimise(lines(spark, *rows), prices(spark, table), STORES[:5], keep=True)
        pairs = o.best_pair(items)
        moved = lambda frame: frame._jdf.queryExecution().sparkPlan().toString()
        planned = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert "Join" not in moved(pairs) and planned(pairs) == 1
        assert "partial_count" in pairs._jdf.queryExecution().executedPlan().toString()
        # One exchange of the lines, one of the choices, a row per basket.
        assert planned(shopping_plan(items, found, pairs)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_kept_items_are_priced_once(spark):
    table, rows = random_case(spark, 5)
    items, found = o.optimise(lines(spark, *rows), prices(spark, table), STORES[:5], keep_items=True)
    plain, expected = o.optimise(lines(spark, *rows), prices(spark, table), STORES[:5])
    for frame in (items.rows, found):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert items.rows.count() == plain.rows.count()
