"""From an optimised basket to what to buy where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.fixed import (
    BAR_FLOOR_PERCENT,
    FULFILLMENT,
    LIST_FOOTER,
    PLAN_FRESHNESS,
    PLAN_ITEM,
    PLAN_SAVINGS,
    PLAN_STORE,
    PLAN_TOTAL,
    PLAN_UNPRICED,
)
from basketwise.functions.links import list_line, quantity_text, search_url
from basketwise.functions.numbers import from_cents, percent, round2
from basketwise.operators.optimise import Items, cheapest_split, split_groups, unpriced_items
from basketwise.session import materialise

STRATEGIES = ("split", "two-stores", "single")


def shopping_plan(items: Items, costs: DataFrame, pairs: DataFrame, pair_fallback: str = "single") -> DataFrame:
    """Items assigned to a store under each strategy; ``pairs`` comes from ``best_pair``.

    Where a basket has no pair, two-stores falls back to the strategy named.
    """
    singles = costs.where(F.col("status") == "ok").select("basket_id", F.col("best.position").alias("single_position"))
    choices = singles.join(pairs.select("basket_id", "pair_first", "pair_second"), "basket_id", "left")
    # Written, so that a basket that holds a large part of the lines can be split below.
    choices = materialise(choices, "plan-choices")
    prices = F.array(*items.prices).cast("array<double>")
    first = F.get("prices", F.col("pair_first"))
    second = F.get("prices", F.col("pair_second"))
    use_first = second.isNull() | (first <= second)
    pair_position = F.when(use_first, F.col("pair_first")).otherwise(F.col("pair_second"))
    fallback = {"single": F.col("single_position"), "split": F.col("best_position")}[pair_fallback]
    two = F.when(F.col("pair_first").isNull(), fallback).otherwise(pair_position)
    assigned = F.array(
        *[
            F.struct(F.lit(name).alias("strategy"), position.alias("position"))
            for name, position in zip(STRATEGIES, (F.col("best_position"), two, F.col("single_position")))
        ]
    )
    rows = items.rows.withColumn("prices", prices).join(choices, "basket_id")
    own = [F.col("enabled")] if items.own_stores else []
    spelled = rows.select("basket_id", "line", "item_id", "quantity", "prices", *own, F.inline(assigned))
    price = F.get("prices", F.col("position"))
    return spelled.where(price.isNotNull()).select(
        "basket_id",
        "strategy",
        F.get(items.store_ids(), F.col("position")).alias("store_id"),
        "line",
        "item_id",
        "quantity",
        (price / 100).alias("unit_price"),
        from_cents(price * F.col("quantity")).alias("subtotal"),
    )


def store_bars(costs: DataFrame, strategy: str = "split", pairs: DataFrame | None = None) -> DataFrame:
    """Store totals against the highest one, and against the cheapest split.

    The strategy two-stores needs the ``pairs`` of ``best_pair``.
    """
    pair_total = F.lit(None).cast("double")
    if pairs is not None:
        costs = costs.join(pairs.select("basket_id", F.col("total").alias("pair_total")), "basket_id", "left")
        pair_total = F.col("pair_total")
    active = {
        "split": F.col("split_total"),
        "two-stores": F.coalesce(pair_total, "best.total"),
        "single": F.col("best.total"),
    }[strategy]
    highest = F.greatest(F.array_max(F.transform("stores", lambda s: s["total"])), active)
    rows = costs.where(F.col("status") == "ok").select(
        "basket_id", "best", "split_total", highest.alias("highest"), F.explode("stores").alias("s")
    )
    width = percent(F.col("s.total"), F.col("highest"))
    return rows.select(
        "basket_id",
        "s.store_id",
        "s.total",
        F.greatest(F.lit(BAR_FLOOR_PERCENT), width).cast("bigint").alias("width_pct"),
        round2(F.col("s.total") - F.col("split_total")).alias("difference"),
        (F.col("s.store_id") == F.col("best.store_id")).alias("is_best"),
    )


def checklist_progress(plan: DataFrame, checked: DataFrame) -> DataFrame:
    """Items ticked off per basket and store of a plan."""
    marks = checked.select("basket_id", "item_id", "store_id").distinct().withColumn("done", F.lit(True))
    joined = plan.join(marks, ["basket_id", "item_id", "store_id"], "left")
    return (
        joined.groupBy("basket_id", "store_id")
        .agg(F.count("*").alias("n_items"), F.count("done").alias("n_done"))
        .withColumn("pct_done", percent(F.col("n_done"), F.col("n_items")))
    )


def with_default_branch(rows: DataFrame, branches: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Adds the branch of every store: the one chosen, else its first.

    ``branches`` has store_id, branch_id, branch_name and position; ``chosen`` store_id
    and branch_id.
    """
    first = branches.groupBy("store_id").agg(
        F.min_by(F.struct("branch_id", "branch_name"), "position").alias("branch")
    )
    if chosen is not None:
        picked = branches.join(chosen.select("store_id", "branch_id"), ["store_id", "branch_id"]).select(
            "store_id", F.struct("branch_id", "branch_name").alias("picked")
        )
        first = first.join(picked, "store_id", "left").select(
            "store_id", F.coalesce("picked", "branch").alias("branch")
        )
    return rows.join(first, "store_id", "left").select(*rows.columns, "branch.branch_id", "branch.branch_name")


def plan_lines(plan: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Text line and search link of every planned item.

    The message of a basket is its lines in (store rank, line) order. It stays a set of
    rows, so a basket of any size is never gathered in one task. ``stores`` has store_id
    and search_url_template, ``products`` ean, name and unit.
    """
    named = plan.join(products.select(F.col("ean").alias("item_id"), "name", "unit"), "item_id").join(
        stores.select("store_id", "search_url_template"), "store_id", "left"
    )
    return named.select(
        "basket_id",
        "store_id",
        "line",
        "item_id",
        list_line(F.col("quantity"), F.col("unit"), F.col("name"), F.col("item_id")).alias("text"),
        search_url(F.col("search_url_template"), F.col("name")).alias("url"),
    )


def store_list_frame(store_name: Column, fulfillment: Column) -> Column:
    """Lines above and below the items of a store list."""
    mode = F.when(fulfillment == "pickup", FULFILLMENT["pickup"]).otherwise(FULFILLMENT["delivery"])
    return F.struct(
        F.concat(F.lit("Lista para "), store_name).alias("title"),
        F.concat(F.lit("Modalidad deseada: "), mode).alias("mode"),
        F.lit(LIST_FOOTER).alias("footer"),
    )


def message_lines(
    items: Items, costs: DataFrame, products: DataFrame, stores: DataFrame, freshness: Column
) -> DataFrame:
    """Lines of the message that tells a basket's cheapest split.

    Lines read in (section, rank, line) order: totals, then each store with its items,
    dearest store first, then items without a price, then how fresh the prices are. They
    stay rows, so no basket is gathered in one task. ``products`` has ean, name and
    unit, ``stores`` store_id, name and branch_name.
    """
    zero = F.lit(0).cast("bigint")
    usable = costs.where(F.col("status") == "ok")
    totals = usable.select(
        "basket_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("section"), zero.alias("rank"), zero.alias("line"),
                    F.format_string(PLAN_TOTAL, "split_total").alias("text"),
                ),
                F.struct(
                    F.lit(1).alias("section"), zero.alias("rank"), zero.alias("line"),
                    F.format_string(PLAN_SAVINGS, "savings_vs_worst", "savings_pct").alias("text"),
                ),
                F.struct(
                    F.lit(4).alias("section"), zero.alias("rank"), zero.alias("line"),
                    F.format_string(PLAN_FRESHNESS, freshness).alias("text"),
                ),
            )
        ),
    )
    groups = split_groups(costs)
    headings = groups.join(stores, "store_id").select(
        "basket_id",
        F.lit(2).alias("section"),
        "rank",
        zero.alias("line"),
        F.format_string(PLAN_STORE, "name", "branch_name", "subtotal").alias("text"),
    )
    named = products.select(F.col("ean").alias("item_id"), "name", "unit")
    bought = cheapest_split(items).join(named, "item_id").join(
        groups.select("basket_id", "store_id", "rank"), ["basket_id", "store_id"]
    )
    entries = bought.select(
        "basket_id",
        F.lit(2).alias("section"),
        "rank",
        # Headings have line 0, so items start above it.
        (F.col("line") + 1).alias("line"),
        F.format_string(PLAN_ITEM, "name", quantity_text(F.col("quantity"), F.col("unit")), "subtotal").alias("text"),
    )
    unpriced = (
        unpriced_items(items)
        .join(usable.select("basket_id"), "basket_id", "left_semi")
        .join(named, "item_id")
        .select(
            "basket_id", F.lit(3).alias("section"), zero.alias("rank"), "line",
            F.format_string(PLAN_UNPRICED, "name").alias("text"),
        )
    )
    return totals.unionByName(headings).unionByName(entries).unionByName(unpriced)
