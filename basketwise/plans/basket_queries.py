"""Queries over baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.functions.numbers import from_cents
from basketwise.operators.baskets import merge_lines, numbered_lines, read_shared, rehydrate_saved, share
from basketwise.operators.consolidation import median_prices
from basketwise.operators.optimise import (
    Items,
    basket_summary,
    best_pair,
    cheapest_split,
    missing_items,
    optimise,
    price_comparison,
    requested_stores,
    savings,
    split_groups,
    store_ranking,
    unpriced_items,
)
from basketwise.operators.shopping import (
    checklist_progress,
    message_lines,
    plan_lines,
    shopping_plan,
    store_bars,
    with_default_branch,
)
from basketwise.plans.bindings import (
    ITEMS,
    MEDIANS,
    OBS,
    basket_lines,
    branches,
    chain_list,
    chains,
    observations,
    products,
    table,
)
from basketwise.plans.catalogue import query
from basketwise.session import materialise

_CTES = f"{OBS}, {MEDIANS}, {ITEMS}"
for _name in ("medians", "offers", "priced", "basket_size", "singles", "ranked"):
    _CTES = _CTES.replace(f"{_name} AS (", f"{_name} AS MATERIALIZED (")
BASKETS = f"WITH {_CTES}"


def _optimised(
    spark: SparkSession, folder: str, enabled: list[str] | None = None, keep: bool = False
) -> tuple[Items, DataFrame]:
    prices = median_prices(observations(spark, folder))
    return optimise(basket_lines(spark, folder), prices, chain_list(spark, folder), enabled, keep)


@query(
    "basket_lines",
    """WITH r AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS rn,
        sum(l_quantity) OVER (PARTITION BY l_orderkey, l_partkey) AS quantity FROM lineitem),
    m AS (SELECT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS ean, quantity,
        CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS first_branch FROM r WHERE rn = 1)
    SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY line, ean) AS position FROM m""",
)
def merged_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("basket_id"),
        F.col("l_partkey").cast("string").alias("catalog_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_suppkey").alias("first_branch"),
    )
    merged = merge_lines(lines, ["first_branch"], ["line", "first_branch"]).withColumnRenamed("catalog_id", "ean")
    return numbered_lines(merged, ["line", "ean"]).withColumn("position", F.col("position").cast("bigint"))


@query(
    "single_store_totals",
    f"{BASKETS} SELECT basket_id, store_id, total, coverage, n_missing, is_complete FROM ranked",
)
def single_store_totals(spark: SparkSession, folder: str) -> DataFrame:
    ranking = store_ranking(_optimised(spark, folder)[1])
    return ranking.select("basket_id", "store_id", "total", "coverage", "n_missing", "is_complete")


@query(
    "missing_items",
    f"""{BASKETS} SELECT p.basket_id, p.ean AS item_id, s.store_id FROM priced p CROSS JOIN stores s
    WHERE NOT EXISTS (SELECT 1 FROM medians m WHERE m.ean = p.ean AND m.store_id = s.store_id)""",
)
def items_missing_per_store(spark: SparkSession, folder: str) -> DataFrame:
    return missing_items(_optimised(spark, folder)[0])


@query(
    "store_ranking",
    f"""{BASKETS} SELECT basket_id, store_id, total, rank, rank = 1 AS is_best,
      store_id = arg_max(store_id, (is_complete, total, -rank)) OVER (PARTITION BY basket_id) AS is_worst FROM ranked""",
)
def ranking(spark: SparkSession, folder: str) -> DataFrame:
    return store_ranking(_optimised(spark, folder)[1]).select(
        "basket_id", "store_id", "total", "rank", "is_best", "is_worst"
    )


@query(
    "cheapest_split",
    f"""{BASKETS} SELECT basket_id, ean AS item_id, quantity, best_store AS store_id, best_price AS unit_price,
      floor(floor(best_price * 100 + 0.5) * quantity + 0.5) / 100 AS subtotal, n_offers FROM priced""",
)
def split(spark: SparkSession, folder: str) -> DataFrame:
    return cheapest_split(_optimised(spark, folder)[0]).drop("line")


@query(
    "split_groups",
    f"""{BASKETS}, g AS (
      SELECT basket_id, best_store AS store_id, count(*) AS n_items,
        floor(sum(floor(best_price * 100 + 0.5) * quantity) + 0.5) / 100 AS subtotal,
        min((first_line, CAST(ean AS BIGINT))) AS first_item
      FROM priced GROUP BY basket_id, best_store)
    SELECT basket_id, store_id, n_items, subtotal,
      row_number() OVER (PARTITION BY basket_id ORDER BY subtotal DESC, first_item) AS rank FROM g""",
)
def groups_of_split(spark: SparkSession, folder: str) -> DataFrame:
    return split_groups(_optimised(spark, folder)[1])


PAIRS = """
pairs AS (
  SELECT a.store_id AS store_1, b.store_id AS store_2, row_number() OVER (ORDER BY a.pos, b.pos) AS pair_no
  FROM stores a JOIN stores b ON a.pos < b.pos
),
pair_items AS (
  SELECT p.basket_id, p.ean, p.quantity, pairs.pair_no, min(o.price) AS price
  FROM priced p CROSS JOIN pairs
  JOIN medians o ON o.ean = p.ean AND (o.store_id = pairs.store_1 OR o.store_id = pairs.store_2)
  GROUP BY ALL
),
pair_totals AS (
  SELECT basket_id, pair_no, count(*) AS coverage,
         sum(floor(floor(price * 100 + 0.5) * quantity + 0.5)) / 100 AS total
  FROM pair_items GROUP BY ALL
),
best_pairs AS (
  SELECT basket_id, store_1, store_2, coverage, n_priced - coverage AS n_missing, total
  FROM pair_totals JOIN pairs USING (pair_no) JOIN basket_size USING (basket_id)
  QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY coverage DESC, total, pair_no) = 1
)"""


@query("best_pair", f"{BASKETS}, {PAIRS} SELECT * FROM best_pairs")
def pair(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = _optimised(spark, folder)
    return best_pair(items).drop("pair_first", "pair_second")


SAVINGS = """
SELECT basket_id, split_total, b.store_id AS best_store, b.total AS best_total,
  w.store_id AS baseline_store, w.total AS baseline_total, w.is_complete AS baseline_is_complete,
  floor((w.total - split_total) * 100 + 0.5) / 100 AS savings_vs_worst,
  floor((b.total - split_total) * 100 + 0.5) / 100 AS savings_vs_best,
  CASE WHEN w.total > 0 THEN CAST(floor(floor((w.total - split_total) * 100 + 0.5) / 100 / w.total * 100 + 0.5) AS BIGINT)
       ELSE 0 END AS savings_pct
FROM basket_size JOIN ends USING (basket_id)"""


@query("basket_savings", f"{BASKETS} {SAVINGS}")
def basket_savings(spark: SparkSession, folder: str) -> DataFrame:
    return savings(_optimised(spark, folder)[1])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest split, best store, best pair and savings of every basket."""
    items, costs = _optimised(spark, folder)
    pairs = best_pair(items).select("basket_id", "store_1", "store_2", F.col("total").alias("pair_total"))
    return costs.where(F.col("status") == "ok").join(pairs, "basket_id", "left").select(
        "basket_id",
        "split_total",
        F.col("n_split_stores").alias("n_stores"),
        F.col("best.store_id").alias("best_single_store"),
        F.col("best.total").alias("best_single_total"),
        F.col("store_1").alias("pair_store_1"),
        F.col("store_2").alias("pair_store_2"),
        "pair_total",
        F.col("savings_vs_worst").alias("savings"),
        "savings_pct",
    )


SUMMARY = """
SELECT basket_id, CASE WHEN coalesce(n_priced, 0) = 0 THEN 'no-prices' ELSE 'ok' END AS status,
  n_items, coalesce(n_priced, 0) AS n_priced, total_units, coalesce(covers, false) AS any_store_covers_all,
  coalesce(n_split, 0) AS n_split_stores
FROM (SELECT basket_id, count(*) AS n_items, sum(quantity) AS total_units FROM items GROUP BY basket_id)
LEFT JOIN (SELECT basket_id, count(*) AS n_priced, count(DISTINCT best_store) AS n_split FROM priced GROUP BY basket_id) USING (basket_id)
LEFT JOIN (SELECT basket_id, bool_or(is_complete) AS covers FROM ranked GROUP BY basket_id) USING (basket_id)"""


@query("basket_summary", f"{BASKETS} {SUMMARY}")
def summary(spark: SparkSession, folder: str) -> DataFrame:
    return basket_summary(_optimised(spark, folder)[1])


@query(
    "unpriced_items",
    f"""{BASKETS} SELECT basket_id, ean AS item_id, quantity FROM items
    WHERE ean NOT IN (SELECT ean FROM medians WHERE store_id = 'europe')""",
)
def items_without_price(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = _optimised(spark, folder, ["europe", "atlantis"])
    return unpriced_items(items).select("basket_id", "item_id", "quantity")


# What each priority class of orders asks for: store ids, unknown ones among them.
REQUESTS = {
    "1-URGENT": ["asia"],
    "2-HIGH": ["europe", "africa", "atlantis", "america"],
    "3-MEDIUM": [],
    "4-NOT SPECIFIED": ["atlantis"],
}


@query(
    "enabled_store_subset",
    f"""{BASKETS},
    asked AS (SELECT o_orderkey AS basket_id, CASE o_orderpriority WHEN '1-URGENT' THEN ['asia']
        WHEN '2-HIGH' THEN ['europe', 'africa', 'atlantis', 'america'] WHEN '3-MEDIUM' THEN []
        WHEN '4-NOT SPECIFIED' THEN ['atlantis'] END AS requested FROM orders),
    may AS (SELECT basket_id, s.store_id FROM asked JOIN stores s
        ON coalesce(len(requested), 0) = 0 OR list_contains(requested, s.store_id)),
    usable AS (SELECT i.basket_id, i.ean, i.quantity, min(m.price) AS best, count(*) AS n,
        arg_min(m.store_id, (floor(m.price * 100 + 0.5), CASE WHEN len(requested) > 0 THEN list_position(requested, m.store_id) ELSE s.pos END)) AS best_store
        FROM items i JOIN may ON may.basket_id = i.basket_id JOIN asked ON asked.basket_id = i.basket_id
        JOIN medians m ON m.ean = i.ean AND m.store_id = may.store_id JOIN stores s ON s.store_id = m.store_id GROUP BY ALL)
    SELECT i.basket_id, any_value(coalesce(n_may, 0)) AS n_stores,
      CASE WHEN any_value(n_may) IS NULL THEN 'no-stores' WHEN count(u.ean) = 0 THEN 'no-prices' ELSE 'ok' END AS status,
      count(u.ean) AS n_priced, floor(sum(floor(best * 100 + 0.5) * i.quantity) + 0.5) / 100 AS split_total,
      CAST(coalesce(sum(CAST(i.ean AS BIGINT) * (ascii(best_store) + length(best_store))), 0) AS BIGINT) AS split_stores
    FROM items i JOIN asked USING (basket_id)
    LEFT JOIN (SELECT basket_id, count(*) AS n_may FROM may GROUP BY basket_id) k USING (basket_id)
    LEFT JOIN usable u ON u.basket_id = i.basket_id AND u.ean = i.ean
    GROUP BY i.basket_id""",
)
def per_basket_stores(spark: SparkSession, folder: str) -> DataFrame:
    requested = F.lit(None).cast("array<string>")
    for priority, ids in REQUESTS.items():
        asked = F.array(*[F.lit(i) for i in ids]).cast("array<string>")
        requested = F.when(F.col("o_orderpriority") == priority, asked).otherwise(requested)
    asked = table(spark, folder, "orders").select(F.col("o_orderkey").alias("basket_id"), requested.alias("requested"))
    stores = chain_list(spark, folder)
    allowed = requested_stores(asked, "requested", stores).select("basket_id", "enabled")
    lines = basket_lines(spark, folder).join(allowed, "basket_id")
    items, costs = optimise(lines, median_prices(observations(spark, folder)), stores, keep_items=True)
    # Which store every item is bought in, as one number per basket.
    sign = F.ascii("store_id") + F.length("store_id")
    bought = cheapest_split(items).groupBy("basket_id").agg(F.sum(F.col("item_id").cast("bigint") * sign).alias("split_stores"))
    return costs.join(bought, "basket_id", "left").select(
        "basket_id", F.size("stores").cast("bigint").alias("n_stores"), "status", "n_priced", "split_total",
        F.coalesce("split_stores", F.lit(0)).alias("split_stores"),
    )


@query(
    "store_bars",
    f"""{BASKETS} SELECT ranked.basket_id, ranked.store_id, ranked.total,
      greatest(15, CAST(floor(ranked.total / greatest(max(ranked.total) OVER (PARTITION BY ranked.basket_id), split_total) * 100 + 0.5) AS BIGINT)) AS width_pct,
      floor((ranked.total - split_total) * 100 + 0.5) / 100 AS difference, rank = 1 AS is_best
    FROM ranked JOIN basket_size USING (basket_id)""",
)
def bars(spark: SparkSession, folder: str) -> DataFrame:
    return store_bars(_optimised(spark, folder)[1])


PLAN = f"""{PAIRS},
pair_plan AS (
  SELECT p.basket_id, 'two-stores' AS strategy, p.ean, p.quantity,
    CASE WHEN b.price IS NULL OR a.price <= b.price THEN bp.store_1 ELSE bp.store_2 END AS store_id,
    CASE WHEN b.price IS NULL OR a.price <= b.price THEN a.price ELSE b.price END AS price
  FROM priced p JOIN best_pairs bp USING (basket_id)
  LEFT JOIN medians a ON a.ean = p.ean AND a.store_id = bp.store_1
  LEFT JOIN medians b ON b.ean = p.ean AND b.store_id = bp.store_2
  WHERE a.price IS NOT NULL OR b.price IS NOT NULL
),
plan AS (
  SELECT basket_id, 'split' AS strategy, ean, quantity, best_store AS store_id, best_price AS price FROM priced
  UNION ALL BY NAME SELECT * FROM pair_plan
  UNION ALL BY NAME SELECT o.basket_id, 'single' AS strategy, o.ean, o.quantity, o.store_id, o.price
    FROM offers o JOIN ranked r ON r.basket_id = o.basket_id AND r.store_id = o.store_id AND r.rank = 1
)"""


@query(
    "shopping_plan",
    f"""{BASKETS}, {PLAN},
    first_branch AS (SELECT store_id, arg_min(branch_id, CAST(branch_id AS BIGINT)) AS branch_id FROM
      (SELECT lower(r_name) AS store_id, CAST(s_suppkey AS VARCHAR) AS branch_id FROM supplier
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY store_id)
    SELECT basket_id, strategy, plan.store_id, ean AS item_id, quantity, price AS unit_price,
      floor(floor(price * 100 + 0.5) * quantity + 0.5) / 100 AS subtotal, branch_id
    FROM plan LEFT JOIN first_branch USING (store_id)""",
)
def plan(spark: SparkSession, folder: str) -> DataFrame:
    items, costs = _optimised(spark, folder, keep=True)
    rows = branches(spark, folder).select(
        "store_id",
        F.col("s_suppkey").cast("string").alias("branch_id"),
        F.col("s_name").alias("branch_name"),
        F.col("s_suppkey").alias("position"),
    )
    return with_default_branch(shopping_plan(items, costs, best_pair(items)), rows).drop("line", "branch_name")


@query(
    "plan_totals",
    f"""{BASKETS}, {PLAN}
    SELECT basket_id, strategy, count(*) AS n_items, count(DISTINCT store_id) AS n_stores,
      sum(floor(floor(price * 100 + 0.5) * quantity + 0.5)) / 100 AS total
    FROM plan GROUP BY ALL""",
)
def plan_totals(spark: SparkSession, folder: str) -> DataFrame:
    items, costs = _optimised(spark, folder, keep=True)
    per_store = shopping_plan(items, costs, best_pair(items)).groupBy("basket_id", "strategy", "store_id").agg(
        F.count("*").alias("n"), F.sum(F.floor(F.col("subtotal") * 100 + F.lit(0.5)).cast("double")).alias("cents")
    )
    return per_store.groupBy("basket_id", "strategy").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_stores"), from_cents(F.sum("cents")).alias("total")
    )


@query(
    "plan_text",
    f"""{BASKETS} SELECT basket_id, best_store AS store_id, ean AS item_id,
      '- ' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' pz ' || p_name ||
        CASE WHEN regexp_matches(ean, '^[0-9]{{8,14}}$') THEN ' | EAN ' || ean ELSE '' END AS text,
      'https://' || replace(best_store, ' ', '-') || '.example/s?q=' || replace(p_name, ' ', '%20') AS url
    FROM priced JOIN part ON CAST(p_partkey AS VARCHAR) = ean""",
)
def plan_text(spark: SparkSession, folder: str) -> DataFrame:
    chosen = cheapest_split(_optimised(spark, folder)[0])
    return plan_lines(chosen, products(spark, folder), chains(spark, folder)).drop("line")


@query(
    "plan_message",
    f"""{BASKETS.replace("FROM items JOIN medians USING (ean) JOIN stores USING (store_id)", "FROM items JOIN medians USING (ean) JOIN stores USING (store_id) WHERE store_id IN ('africa', 'asia')")
    .replace("FROM region)", "FROM region WHERE r_name IN ('AFRICA', 'ASIA'))")},
    savings AS ({SAVINGS}),
    g AS (
      SELECT basket_id, best_store AS store_id, floor(sum(floor(best_price * 100 + 0.5) * quantity) + 0.5) / 100 AS subtotal,
        row_number() OVER (PARTITION BY basket_id ORDER BY floor(sum(floor(best_price * 100 + 0.5) * quantity) + 0.5) DESC,
          min((first_line, CAST(ean AS BIGINT)))) AS rank
      FROM priced GROUP BY basket_id, best_store)
    SELECT basket_id, 0 AS section, 0::BIGINT AS rank, printf('💰 *Total Optimizado:* $%.2f MXN', split_total) AS text FROM savings
    UNION ALL SELECT basket_id, 1, 0, printf('🎉 *Ahorro Estimado:* $%.2f MXN (%d%%)', savings_vs_worst, savings_pct) FROM savings
    UNION ALL SELECT basket_id, 4, 0, '_Precios de referencia actualizados hoy._' FROM savings
    UNION ALL SELECT basket_id, 2, rank, printf('📍 *%s* — %s (Subtotal: $%.2f):', upper(store_id), 'Centro ' || store_id, subtotal) FROM g
    UNION ALL SELECT p.basket_id, 2, rank, printf('  • %s (%s) -> $%.2f', p_name, CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' pz',
        floor(floor(best_price * 100 + 0.5) * quantity + 0.5) / 100)
      FROM priced p JOIN g ON g.basket_id = p.basket_id AND g.store_id = p.best_store JOIN part ON CAST(p_partkey AS VARCHAR) = ean
    UNION ALL SELECT basket_id, 3, 0, '⚠️ *Sin precio (revisar en tienda):* ' || p_name FROM items JOIN part ON CAST(p_partkey AS VARCHAR) = ean
      WHERE ean NOT IN (SELECT ean FROM medians WHERE store_id IN ('africa', 'asia')) AND basket_id IN (SELECT basket_id FROM savings)""",
)
def plan_message(spark: SparkSession, folder: str) -> DataFrame:
    items, costs = _optimised(spark, folder, ["africa", "asia"], keep=True)
    stores = chains(spark, folder).select(
        "store_id", "name", F.concat(F.lit("Centro "), "store_id").alias("branch_name")
    )
    lines = message_lines(items, costs, products(spark, folder), stores, F.lit("hoy"))
    return lines.drop("line")


@query(
    "price_comparison",
    f"""WITH {OBS}, {MEDIANS}, s AS (SELECT lower(r_name) AS store_id, r_regionkey AS pos FROM region)
    SELECT ean AS item_id, store_id, price, count(*) OVER (PARTITION BY ean) AS n_offers,
      row_number() OVER (PARTITION BY ean ORDER BY price, pos) AS rank,
      row_number() OVER (PARTITION BY ean ORDER BY price, pos) = 1 AS is_best
    FROM medians JOIN s USING (store_id)""",
)
def comparison(spark: SparkSession, folder: str) -> DataFrame:
    cards = products(spark, folder).select(
        F.lit("catalog").alias("basket_id"),
        F.col("position").alias("line"),
        F.col("ean").alias("item_id"),
        "ean",
        F.lit(1.0).alias("quantity"),
    )
    items, _ = optimise(cards, median_prices(observations(spark, folder)), chain_list(spark, folder))
    return price_comparison(items).drop("basket_id")


@query(
    "checklist_progress",
    f"""{BASKETS}, done AS (
      SELECT l_orderkey AS basket_id, CAST(l_partkey AS VARCHAR) AS ean FROM lineitem
      GROUP BY ALL HAVING bool_or(l_linestatus = 'F'))
    SELECT p.basket_id, best_store AS store_id, count(*) AS n_items, count(d.ean) AS n_done,
      CAST(floor(count(d.ean) / count(*) * 100 + 0.5) AS BIGINT) AS pct_done
    FROM priced p LEFT JOIN done d ON d.basket_id = p.basket_id AND d.ean = p.ean GROUP BY ALL""",
)
def progress(spark: SparkSession, folder: str) -> DataFrame:
    plan_rows = materialise(cheapest_split(_optimised(spark, folder)[0]), "split-plan")
    ticked = (
        table(spark, folder, "lineitem")
        .where(F.col("l_linestatus") == "F")
        .select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").cast("string").alias("item_id"))
        .distinct()
    )
    # A tick belongs to the store the item is bought in.
    checked = plan_rows.join(ticked, ["basket_id", "item_id"], "left_semi").select("basket_id", "item_id", "store_id")
    return checklist_progress(plan_rows, checked)


SHARED = """
m AS (SELECT l_orderkey AS basket_id, l_partkey, sum(l_quantity) * 25 AS quantity, min(l_linenumber) AS line
      FROM lineitem GROUP BY ALL),
kept AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY line, l_partkey) <= 60)
SELECT basket_id, row_number() OVER (PARTITION BY basket_id ORDER BY line, l_partkey) AS position,
  CASE WHEN p_size % 3 = 2 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS ean,
  CASE WHEN p_size % 3 = 2 THEN 'Item ' || p_name ELSE p_name END AS name,
  CASE WHEN p_size % 3 = 2 THEN 'despensa' ELSE p_type END AS category,
  quantity, p_size % 3 = 2 AS is_custom
FROM kept JOIN part ON p_partkey = l_partkey QUALIFY quantity <= 999"""


@query("basket_payload_roundtrip", f"WITH {SHARED}")
def payload_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    catalog = products(spark, folder)
    kind = F.col("pack.amount") % 3
    merged = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("position")
    ).agg((F.sum("l_quantity") * 25).alias("quantity"), F.min("l_linenumber").alias("line"))
    # A third of the products travel by id, a third by key and a third as custom lines.
    lines = merged.join(catalog, "position").select(
        "basket_id",
        "line",
        "position",
        "quantity",
        F.when(kind == 0, F.col("slug")).alias("catalog_id"),
        F.when(kind != 2, F.col("ean")).alias("ean"),
        F.when(kind == 2, F.concat(F.lit("Item "), "name")).otherwise(F.lit("a name the link made up")).alias("name"),
        "unit",
        (kind == 2).alias("is_custom"),
    )
    shared = share(lines.withColumnRenamed("position", "product_no"), ["line", "product_no"])
    return read_shared(shared, catalog).select(
        "basket_id", F.col("position").cast("bigint").alias("position"), "ean", "name", "category", "quantity", "is_custom"
    )


@query(
    "saved_baskets",
    """WITH m AS (SELECT l_orderkey AS basket_id, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
    SELECT basket_id, l_partkey AS line, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS ean,
      CASE WHEN p_size % 4 = 0 THEN 'saved name' ELSE p_name END AS name,
      CASE WHEN p_size % 4 = 0 THEN 'despensa' ELSE p_type END AS category,
      quantity, p_size % 4 = 0 AS is_custom, CASE WHEN p_size % 4 = 0 THEN p_retailprice END AS own_price
    FROM m JOIN part ON p_partkey = l_partkey""",
)
def saved_baskets(spark: SparkSession, folder: str) -> DataFrame:
    catalog = products(spark, folder)
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("position"), "p_retailprice")
    merged = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("position")
    ).agg(F.sum("l_quantity").alias("quantity"))
    # A quarter of the products are no longer in the catalog, half of those by id.
    gone = F.col("pack.amount") % 4 == 0
    lost_id = F.when(F.col("pack.amount") % 8 == 0, F.lit("gone"))
    saved = merged.join(catalog, "position").join(part, "position").select(
        "basket_id",
        F.col("position").alias("line"),
        F.when(gone, lost_id).otherwise(F.col("slug")).alias("catalog_id"),
        F.lit("saved name").alias("name"),
        F.lit("despensa").alias("category"),
        F.lit("kg").alias("unit"),
        "quantity",
        F.lit(None).cast("map<string,double>").alias("estimated_prices"),
        F.create_map(F.lit("asia"), F.col("p_retailprice")).alias("prices"),
    )
    own = F.try_element_at("estimated_prices", F.lit("asia"))
    return rehydrate_saved(saved, catalog).select(
        "basket_id", "line", "ean", "name", "category", "quantity", "is_custom", own.alias("own_price")
    )
