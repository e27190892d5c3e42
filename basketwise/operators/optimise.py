"""What a basket costs per store, split over stores, and over the best two stores.

A missing price means that nobody knows it, never zero.

Stores are a short list fixed before the query is built, so the price of an item in
every store sits in one row (one column per store). All totals of a basket then come
out of a single aggregation over its items: partial sums leave each task as one row per
basket, and one shuffle of these rows serves the store totals, the split and the savings
together. No list of items is collected, so a basket may be of any size. Pairs of stores
are decided apart, by the sets of stores that sell an item and by bounds of their totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.functions.numbers import cents, from_cents, is_usable
from basketwise.model import Store
from basketwise.session import materialise


def enabled_stores(stores: list[Store], enabled: list[str] | None) -> list[Store]:
    """Stores to consider, in the order asked for; nothing asked for means all.

    Unknown ids are ignored, so a list of only unknown ids leaves no store.
    """
    if not enabled:
        return list(stores)
    known = {s.id: s for s in stores}
    return [known[i] for i in dict.fromkeys(enabled) if i in known]


def requested_stores(baskets: DataFrame, requested: str, stores: list[Store]) -> DataFrame:
    """Adds the stores each basket may use and whether it is left with any."""
    known = F.array(*[F.lit(s.id) for s in stores])
    asked = F.coalesce(requested, F.array().cast("array<string>"))
    usable = F.when(F.size(asked) == 0, known).otherwise(F.array_intersect(asked, known))
    return baskets.withColumn("enabled", usable).withColumn(
        "status", F.when(F.size("enabled") == 0, F.lit("no-stores")).otherwise(F.lit("ok"))
    )


def _text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def price_rows(prices: DataFrame, stores: list[Store]) -> DataFrame:
    """One row per product with its usable price, in cents, in every store: p0, p1, ..."""
    usable = prices.where(is_usable(F.col("price")) & F.col("store_id").isin([s.id for s in stores]))
    columns = [
        F.expr(f"max(CASE WHEN store_id = {_text(s.id)} THEN cents END) AS p{i}") for i, s in enumerate(stores)
    ]
    return usable.select("ean", "store_id", cents(F.col("price")).alias("cents")).groupBy("ean").agg(*columns)


@dataclass(frozen=True)
class Items:
    """Basket items with their prices, and the stores those prices belong to.

    Where baskets ask for stores of their own, position n is the n-th store the basket asks
    for, so that ties go to the store asked for first; otherwise it is the n-th store.
    """

    rows: DataFrame
    stores: list[Store]

    @property
    def prices(self) -> list[Column]:
        return [F.col(p) for p in self.names]

    @property
    def names(self) -> list[str]:
        return [f"p{i}" for i in range(len(self.stores))]

    @property
    def own_stores(self) -> bool:
        return "enabled" in self.rows.columns

    def store_ids(self) -> Column:
        """Stores by position; needs the column enabled where baskets have stores of their own."""
        return F.col("enabled") if self.own_stores else F.array(*[F.lit(s.id) for s in self.stores])

    def sql_id(self, position: int) -> str:
        return f"get(enabled, {position})" if self.own_stores else _text(self.stores[position].id)


def price_items(
    lines: DataFrame, prices: DataFrame, stores: list[Store], enabled: list[str] | None = None
) -> Items:
    """Basket items with one price column per enabled store.

    ``lines`` has basket_id, line, item_id, ean and quantity, and optionally is_custom
    with estimated_prices (store -> price), and optionally an ``enabled`` list of store
    ids per basket. Catalog items take the price of their key, custom items their own.
    Custom items do not take part in the join, so their missing keys do not pile up in
    one task; a line without the flag is a catalog item. Product prices are written first: their real size decides whether they are
    broadcast, and if not, adaptive execution can split a product that most baskets hold,
    which it does only between plain shuffled inputs.
    """
    chosen = enabled_stores(stores, enabled)
    has_custom = "is_custom" in lines.columns
    custom = F.coalesce(F.col("is_custom"), F.lit(False)) if has_custom else F.lit(False)
    catalog_lines = lines.where(~custom) if has_custom else lines
    rows = catalog_lines
    if chosen:
        rows = rows.join(materialise(price_rows(prices, chosen), "price-rows"), "ean", "left")
    if has_custom:
        own = {}
        for i, store in enumerate(chosen):
            value = F.try_element_at("estimated_prices", F.lit(store.id))
            own[f"p{i}"] = F.when(is_usable(value), cents(value))
        rows = rows.unionByName(lines.where(custom).withColumns(own))
    if "enabled" in lines.columns and chosen:
        rows = _in_order_asked(rows, chosen)
    names = [f"p{i}" for i in range(len(chosen))]
    offered = " + ".join(f"int({p} IS NOT NULL)" for p in names) or "0"
    # least() passes over missing prices; the first store at that price wins ties.
    best = f"least({', '.join(names)})" if len(names) > 1 else (names[0] if names else "CAST(NULL AS DOUBLE)")
    first = " ".join(f"WHEN {p} = best_cents THEN {i}" for i, p in enumerate(names)) or "WHEN false THEN 0"
    return Items(
        rows.selectExpr(
            "*", f"{offered} AS n_offers", f"{best} AS best_cents", f"CASE {first} END AS best_position"
        ),
        chosen,
    )


def _in_order_asked(rows: DataFrame, chosen: list[Store]) -> DataFrame:
    """Moves the prices to the positions of the stores a basket asks for, and drops the others.

    A basket may repeat a store or ask for one that is not enabled at all.
    """
    known = F.array(*[F.lit(s.id) for s in chosen])
    every = F.array(*[F.col(f"p{i}") for i in range(len(chosen))])
    asked = rows.withColumns({"enabled": F.array_intersect("enabled", known), "_every": every})
    place = {
        f"p{i}": F.get("_every", F.array_position(known, F.get("enabled", F.lit(i))).cast("int") - 1)
        for i in range(len(chosen))
    }
    return asked.withColumns(place).drop("_every")


def unpriced_items(items: Items) -> DataFrame:
    """Items that no enabled store has a price for."""
    return items.rows.where(F.col("n_offers") == 0)


def _store_id(items: Items, position: Column) -> Column:
    return F.get(items.store_ids(), position)


def cheapest_split(items: Items) -> DataFrame:
    """Every priced item at its cheapest store; the earlier store wins ties."""
    return items.rows.where(F.col("n_offers") > 0).select(
        "basket_id",
        "line",
        "item_id",
        "quantity",
        _store_id(items, F.col("best_position")).alias("store_id"),
        (F.col("best_cents") / 100).alias("unit_price"),
        from_cents(F.col("best_cents") * F.col("quantity")).alias("subtotal"),
        F.col("n_offers").cast("bigint").alias("n_offers"),
    )


def price_comparison(items: Items) -> DataFrame:
    """Offers of every item from cheap to dear; ties keep store order."""
    offers = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(p.isNotNull(), F.struct(p.alias("cents"), F.lit(i).alias("position")))
                    for i, p in enumerate(items.prices)
                ]
            )
        )
    )
    ranked = items.rows.select("basket_id", "item_id", "n_offers", F.posexplode(offers).alias("rank", "offer"))
    return ranked.select(
        "basket_id",
        "item_id",
        (F.col("rank") + 1).cast("bigint").alias("rank"),
        _store_id(items, F.col("offer.position")).alias("store_id"),
        (F.col("offer.cents") / 100).alias("price"),
        F.col("n_offers").cast("bigint").alias("n_offers"),
        (F.col("rank") == 0).alias("is_best"),
    )


# Subtotal of a line in whole cents, for a price in cents.
LINE_CENTS = "CAST(floor({price} * quantity + 0.5D) AS DOUBLE)"
# Cents, possibly fractional, rounded once to money.
MONEY = "floor({cents} + 0.5D) / 100.0D"


#: Prices of a line, by their rank among its offers, against which the stores of a pair are measured.
REFERENCES = (0.1, 0.25, 0.5)
#: Pairs of a basket that are priced first, those of the lowest bounds. Up to this number, all pairs of
#: five stores, every pair is a column of one aggregation.
FIRST_PAIRS = 10


def _pair_lines(items: Items) -> DataFrame:
    """(basket_id, quantity, prices) of the priced items, with the list of stores where baskets have their own."""
    return items.rows.where("n_offers > 0").select(
        "basket_id", "quantity", F.array(*items.prices).alias("prices"), *([F.col("enabled")] if items.own_stores else [])
    )


def _measured(lines: DataFrame, n_stores: int) -> DataFrame:
    """Adds to every line what each store has at least to do with the subtotal of a pair, per reference: c0_0, c0_1, ...

    For any reference m, min(a, b) >= (min(a, m) - m / 2) + (min(b, m) - m / 2), and 0 does for a store
    without a price: the cheaper of two prices is bounded by a sum of what each store alone tells. Twice
    these amounts are kept, in whole cents.
    """
    cents_of = "floor({} * quantity + 0.5D)"
    rows = lines.withColumn("_sorted", F.array_sort(F.array_compact("prices")))
    rows = rows.withColumns(
        {f"_m{r}": F.expr(cents_of.format(f"get(_sorted, CAST(floor({share}D * size(_sorted)) AS INT))")) for r, share in enumerate(REFERENCES)}
        | {"_most": F.expr(cents_of.format("get(_sorted, size(_sorted) - 1)"))}
    )
    own = {f"_a{i}": F.expr(cents_of.format(f"get(prices, {i})")) for i in range(n_stores)}
    # Of a negative quantity the dearest price gives the lowest subtotal.
    part = "CASE WHEN quantity < 0 THEN _most WHEN _a{i} IS NOT NULL THEN 2 * least(_a{i}, _m{r}) - _m{r} ELSE 0 END"
    parts = {f"c{r}_{i}": F.expr(part.format(r=r, i=i)) for r in range(len(REFERENCES)) for i in range(n_stores)}
    return rows.withColumns(own).withColumns(parts).drop("_sorted", "_most", *(f"_m{r}" for r in range(len(REFERENCES))), *own)


def _bounded_pairs(lines: DataFrame, n_stores: int) -> DataFrame:
    """(basket_id, pairs) with the pairs (bound, first, second, coverage) of positions that cover most items, lowest bounds first.

    Items are counted by the set of stores that sell them, so a basket has as many sets as
    its items differ in, never its items. Only stores with prices in the basket come in
    question, and the first one without, which stands for a second store that adds nothing.
    No pair costs less than its bound, in half cents.
    """
    own = ["enabled"] if "enabled" in lines.columns else []
    sells = F.filter(F.transform("prices", lambda p, i: F.when(p.isNotNull(), i)), lambda i: i.isNotNull())
    names = [[f"c{r}_{i}" for i in range(n_stores)] for r in range(len(REFERENCES))]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for row in names for c in row]
    counted = _measured(lines, n_stores).withColumn("sells", sells).groupBy("basket_id", "sells", *own).agg(F.count("*").alias("n"), *sums)
    size = F.size("enabled") if own else F.lit(n_stores)
    baskets = counted.groupBy("basket_id").agg(
        F.collect_list(F.struct("sells", "n")).alias("sets"),
        F.array_distinct(F.flatten(F.collect_list("sells"))).alias("sellers"),
        F.max(size).alias("n_stores"),
        *(F.sum(c).alias(c) for row in names for c in row),
    )
    baskets = baskets.select("basket_id", "sets", "sellers", "n_stores", F.array(*(F.array(*row) for row in names)).alias("parts"))
    idle = F.array_except(F.sequence(F.lit(0), F.col("n_stores") - 1), "sellers")
    candidates = F.array_sort(F.concat("sellers", F.slice(idle, 1, 1)))

    def coverage(i: Column, j: Column) -> Column:
        def add(total: Column, s: Column) -> Column:
            either = F.array_contains(s["sells"], i) | F.array_contains(s["sells"], j)
            return total + F.when(either, s["n"]).otherwise(F.lit(0))

        return F.aggregate("sets", F.lit(0).cast("bigint"), add)

    def pair(i: Column, j: Column) -> Column:
        bound = F.array_max(F.transform("parts", lambda row: F.get(row, i) + F.get(row, j)))
        return F.struct(bound.alias("bound"), i.alias("first"), j.alias("second"), coverage(i, j).alias("coverage"))

    later = lambda i: F.filter("candidates", lambda j: j > i)
    pairs = F.flatten(F.transform("candidates", lambda i: F.transform(later(i), lambda j: pair(i, j))))
    widest = F.filter("pairs", lambda p: p["coverage"] == F.col("most"))
    every = baskets.withColumn("candidates", candidates).withColumn("pairs", pairs)
    most = every.withColumn("most", F.array_max(F.transform("pairs", lambda p: p["coverage"])))
    return most.select("basket_id", F.array_sort(widest).alias("pairs"))


def _pair_totals(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals in cents of pairs (basket_id, p); lines are summed in the tasks before they are shuffled."""
    wide = pairs.select("basket_id", "p.first", "p.second", "p.coverage")
    priced = lines.join(wide, "basket_id").withColumn("cheaper", F.expr("least(get(prices, first), get(prices, second))"))
    return priced.groupBy("basket_id", "first", "second", "coverage").agg(
        F.count("*").alias("n_priced"),
        F.coalesce(F.expr(f"sum({LINE_CENTS.format(price='cheaper')})"), F.lit(0.0)).alias("total"),
        *([F.any_value("enabled").alias("enabled")] if "enabled" in lines.columns else []),
    )


def priced_pairs(items: Items) -> DataFrame:
    """The pairs of every basket that could be its best one, with their totals; the best one is among them.

    Of the pairs that cover most items those of the lowest bounds are priced first, then those
    whose bounds do not exceed the least total found so far.
    """
    n = len(items.stores)
    lines = materialise(_pair_lines(items), "pair-lines")
    pairs = materialise(_bounded_pairs(lines, n), "pairs")
    first = pairs.select("basket_id", F.explode(F.slice("pairs", 1, FIRST_PAIRS)).alias("p"))
    totals = materialise(_pair_totals(lines, first), "pair-totals")
    least = totals.groupBy("basket_id").agg(F.min("total").alias("least"))
    more = pairs.where(F.size("pairs") > FIRST_PAIRS).join(least, "basket_id")
    left = F.filter(F.slice("pairs", FIRST_PAIRS + 1, F.size("pairs")), lambda p: p["bound"] <= 2 * F.col("least"))
    again = more.select("basket_id", F.explode(left).alias("p"))
    return totals.unionByName(_pair_totals(lines, again))


def _pairs_in_a_row(items: Items) -> DataFrame:
    """The best pair of every basket where the stores have so few pairs that each is a column.

    The totals of all pairs come out of one aggregation, so partial sums leave each task as
    one row per basket and no line is shuffled.
    """
    n = len(items.stores)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    sums = [f"count(coalesce(p{i}, p{j})) AS n_{i}_{j}" for i, j in pairs]
    # least() passes over missing prices.
    cheaper = "sum({}) AS sum_{}_{}"
    sums += [cheaper.format(LINE_CENTS.format(price=f"least(p{i}, p{j})"), i, j) for i, j in pairs]
    own = ["any_value(enabled) AS enabled"] if items.own_stores else []
    totals = items.rows.where("n_offers > 0").groupBy("basket_id").agg(*map(F.expr, ["count(*) AS n_priced", *sums, *own]))
    structs = [
        _when(
            f"size(enabled) > {j}" if items.own_stores else None,
            f"named_struct('uncovered', -n_{i}_{j}, 'total', coalesce(sum_{i}_{j}, 0.0D), 'first', {i}, 'second', {j})",
        )
        for i, j in pairs
    ] or ["CAST(NULL AS STRUCT<uncovered: BIGINT, total: DOUBLE, first: INT, second: INT>)"]
    best = totals.select("basket_id", "n_priced", *(["enabled"] if own else []), F.expr(f"array_min(array({', '.join(structs)}))").alias("best"))
    return best.where("best IS NOT NULL").selectExpr(
        "basket_id", "best.total", "best.first", "best.second", "-best.uncovered AS coverage", "n_priced", *(["enabled"] if own else [])
    )


def best_pair(items: Items) -> DataFrame:
    """Pair of stores that covers most items, then costs least, then comes first."""
    n = len(items.stores)
    if n * (n - 1) // 2 <= FIRST_PAIRS:
        chosen = _pairs_in_a_row(items)
    else:
        best = F.min(F.struct("total", "first", "second", "coverage", "n_priced", *(["enabled"] if items.own_stores else [])))
        chosen = priced_pairs(items).groupBy("basket_id").agg(best.alias("best")).select("basket_id", "best.*")
    return chosen.select(
        "basket_id",
        _store_id(items, F.col("first")).alias("store_1"),
        _store_id(items, F.col("second")).alias("store_2"),
        "coverage",
        (F.col("n_priced") - F.col("coverage")).alias("n_missing"),
        (F.col("total") / 100).alias("total"),
        F.col("first").alias("pair_first"),
        F.col("second").alias("pair_second"),
    )


def basket_costs(items: Items) -> DataFrame:
    """One row per basket: items, store totals in rank order, split and savings."""
    aggregates = [
        "count(*) AS n_items",
        "count_if(n_offers > 0) AS n_priced",
        "sum(quantity) AS total_units",
        "sum(best_cents * quantity) AS split_sum",
    ]
    for i in range(len(items.stores)):
        aggregates += [
            f"count(p{i}) AS n_{i}",
            f"sum(p{i} * quantity) AS sum_{i}",
            f"count_if(best_position = {i}) AS split_n_{i}",
            f"sum(CASE WHEN best_position = {i} THEN best_cents * quantity END) AS split_sum_{i}",
            f"min(CASE WHEN best_position = {i} THEN line END) AS split_line_{i}",
        ]
    if items.own_stores:
        aggregates.append("any_value(enabled) AS enabled")
    costs = items.rows.groupBy("basket_id").agg(*[F.expr(a) for a in aggregates])
    if not items.stores:
        return costs.selectExpr("basket_id", "n_items", "n_priced", "total_units", "'no-stores' AS status")
    return _decide(costs, items)


def _when(condition: str | None, value: str) -> str:
    return value if condition is None else f"CASE WHEN {condition} THEN {value} END"


def _ranked_stores(items: Items, allowed: list[str | None]) -> str:
    """Complete stores first, then by coverage, then by total, then in store order."""
    structs = [
        _when(
            allowed[i],
            f"named_struct('incomplete', n_{i} < n_priced, 'uncovered', -n_{i}, "
            f"'total', {MONEY.format(cents=f'coalesce(sum_{i}, 0.0D)')}, 'position', {i}, "
            f"'store_id', {items.sql_id(i)}, 'coverage', n_{i}, 'n_missing', n_priced - n_{i})",
        )
        for i in range(len(items.stores))
    ]
    return f"sort_array(array_compact(array({', '.join(structs)})))"


def _ranked_groups(items: Items) -> str:
    """Dearest group of the split first, then the one whose first item comes first."""
    structs = [
        _when(
            f"split_n_{i} > 0",
            f"named_struct('cost', -({MONEY.format(cents=f'split_sum_{i}')}), 'first_line', split_line_{i}, "
            f"'store_id', {items.sql_id(i)}, 'n_items', split_n_{i})",
        )
        for i in range(len(items.stores))
    ]
    return f"sort_array(array_compact(array({', '.join(structs)})))"


def _decide(costs: DataFrame, items: Items) -> DataFrame:
    """Ranks the stores and the split groups of a basket within its row."""
    allowed = [f"size(enabled) > {i}" if items.own_stores else None for i in range(len(items.stores))]
    ranked = costs.selectExpr(
        "basket_id",
        "n_items",
        "n_priced",
        "total_units",
        f"{MONEY.format(cents='split_sum')} AS split_total",
        f"{_ranked_stores(items, allowed)} AS stores",
        f"{_ranked_groups(items)} AS groups",
    )
    compared = ranked.selectExpr(
        "*",
        "get(stores, 0) AS best",
        "exists(stores, s -> NOT s.incomplete) AS any_store_covers_all",
    ).selectExpr(
        "*",
        # Incomplete stores are compared only where none is complete.
        "filter(stores, s -> NOT s.incomplete OR NOT any_store_covers_all) AS comparable",
    )
    # The highest total; the better ranked store wins ties.
    dearest = "array_max(transform(comparable, (s, n) -> struct(s.total AS total, -n AS order)))"
    measured = compared.selectExpr("*", f"get(comparable, -({dearest}).order) AS worst").selectExpr(
        "*", "floor((worst.total - split_total) * 100 + 0.5D) / 100.0D AS savings_vs_worst"
    )
    return measured.selectExpr(
        "basket_id",
        "n_items",
        "n_priced",
        "total_units",
        "CASE WHEN size(stores) = 0 THEN 'no-stores' WHEN n_priced = 0 THEN 'no-prices' ELSE 'ok' END AS status",
        "any_store_covers_all",
        "stores",
        "groups",
        "best",
        "worst",
        "split_total",
        "CAST(size(groups) AS BIGINT) AS n_split_stores",
        "savings_vs_worst",
        "floor((best.total - split_total) * 100 + 0.5D) / 100.0D AS savings_vs_best",
        "CAST(CASE WHEN worst.total > 0 THEN floor(savings_vs_worst / worst.total * 100 + 0.5D) ELSE 0 END AS BIGINT)"
        " AS savings_pct",
    )


def _priced(costs: DataFrame) -> DataFrame:
    return costs.where(F.col("status") == "ok")


def store_ranking(costs: DataFrame) -> DataFrame:
    """Stores of every basket: complete ones first, then by coverage, then by total."""
    ranked = _priced(costs).select("basket_id", "best", "worst", F.posexplode("stores").alias("rank", "s"))
    return ranked.select(
        "basket_id",
        "s.store_id",
        "s.total",
        "s.coverage",
        "s.n_missing",
        (~F.col("s.incomplete")).alias("is_complete"),
        (F.col("rank") + 1).cast("bigint").alias("rank"),
        (F.col("s.store_id") == F.col("best.store_id")).alias("is_best"),
        (F.col("s.store_id") == F.col("worst.store_id")).alias("is_worst"),
    )


def missing_items(items: Items) -> DataFrame:
    """Priced items that a store lacks, one row per store and item."""
    ids = [F.get(F.col("enabled"), F.lit(i)) if items.own_stores else F.lit(s.id) for i, s in enumerate(items.stores)]
    lacking = F.array_compact(F.array(*[F.when(p.isNull(), s) for p, s in zip(items.prices, ids)]))
    priced = items.rows.where(F.col("n_offers") > 0)
    return priced.select("basket_id", "item_id", F.explode(lacking).alias("store_id"))


def split_groups(costs: DataFrame) -> DataFrame:
    """Stores of the cheapest split, dearest group first."""
    ranked = _priced(costs).select("basket_id", F.posexplode("groups").alias("rank", "g"))
    return ranked.select(
        "basket_id",
        "g.store_id",
        "g.n_items",
        (-F.col("g.cost")).alias("subtotal"),
        (F.col("rank") + 1).cast("bigint").alias("rank"),
    )


def savings(costs: DataFrame) -> DataFrame:
    """What the cheapest split saves, and the store it is measured against."""
    return _priced(costs).select(
        "basket_id",
        "split_total",
        F.col("best.store_id").alias("best_store"),
        F.col("best.total").alias("best_total"),
        F.col("worst.store_id").alias("baseline_store"),
        F.col("worst.total").alias("baseline_total"),
        (~F.col("worst.incomplete")).alias("baseline_is_complete"),
        "savings_vs_worst",
        "savings_vs_best",
        "savings_pct",
    )


def basket_summary(costs: DataFrame) -> DataFrame:
    """Size and state of every basket."""
    return costs.select(
        "basket_id", "status", "n_items", "n_priced", "total_units", "any_store_covers_all", "n_split_stores"
    )


def optimise(
    lines: DataFrame,
    prices: DataFrame,
    stores: list[Store],
    enabled: list[str] | None = None,
    keep: bool = False,
    keep_items: bool = False,
) -> tuple[Items, DataFrame]:
    """Items with prices, and the costs of every basket.

    With ``keep`` both are written to the shared folder first, for callers that derive
    several tables from them; with ``keep_items`` only the items, so that they are priced once.
    """
    items = price_items(lines, prices, stores, enabled)
    if not (keep or keep_items):
        return items, basket_costs(items)
    kept = Items(materialise(items.rows, "basket-items"), items.stores)
    costs = basket_costs(kept)
    return kept, materialise(costs, "basket-costs") if keep else costs
