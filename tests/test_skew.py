"""One product, basket or text that holds a third of all rows."""

import contextlib

import pytest
from pyspark.sql import functions as F

from basketwise.model import Store
from basketwise.operators.matching import match_terms, text_runs
from basketwise.operators.optimise import basket_costs, best_pair, optimise, price_items
from basketwise.operators.shopping import shopping_plan

STORES = [Store("a", "A"), Store("b", "B")]
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        with contextlib.suppress(Exception):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def baskets(spark, rows=60000):
    """Product 0 and basket 0 hold a third of the lines each."""
    n = F.col("id")
    return spark.range(0, rows, 1, 8).select(
        F.when(n % 3 == 1, F.lit(0)).otherwise(n).alias("basket_id"),
        n.alias("line"),
        F.when(n % 3 == 0, F.lit("0")).otherwise((n % 5000).cast("string")).alias("item_id"),
        F.when(n % 3 == 0, F.lit("0")).otherwise((n % 5000).cast("string")).alias("ean"),
        F.lit(2.0).alias("quantity"),
    )


def prices(spark):
    n = F.col("id")
    both = F.inline(F.array(*[F.struct(F.lit(s.id).alias("store_id"), (n % 7 + i + 1.0).alias("price")) for i, s in enumerate(STORES)]))
    return spark.range(5000).select(n.cast("string").alias("ean"), both)


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_hot_product_is_split(spark, small_partitions):
    items = price_items(baskets(spark), prices(spark), STORES)
    assert "skew=true" in final_plan(items.rows)
    assert items.rows.where(F.col("n_offers") == 2).count() == 60000
    total = basket_costs(items).agg(F.sum("n_items"), F.sum("split_total")).first()
    assert total[0] == 60000
    assert total[1] == items.rows.agg(F.sum(F.col("best_cents") * 2) / 100).first()[0]


def test_a_hot_basket_is_split_in_its_plan(spark, small_partitions):
    items, costs = optimise(baskets(spark), prices(spark), STORES, keep=True)
    plan = shopping_plan(items, costs, best_pair(items))
    assert "skew=true" in final_plan(plan)
    assert plan.count() == 3 * 60000


def test_a_hot_text_is_matched_once(spark, small_partitions):
    rows = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("leche lala")).otherwise(F.concat(F.lit("pan "), "id")).alias("text")
    )
    mapping = spark.createDataFrame([(0, "M", ["leche"], []), (1, "P", ["pan 1"], ["9"])], "entry_no int, ean string, requiere array<string>, excluye array<string>")
    got = {r["matched_ean"]: r["count"] for r in match_terms(rows, "text", mapping).groupBy("matched_ean").count().collect()}
    want = sum(1 for i in range(30000) if i % 3 and "pan 1" in f"pan {i}" and "9" not in f"pan {i}")
    assert got["M"] == 10000 and got["P"] == want


def test_long_texts_are_spelled_out_whole(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(5000)) + "needle at the very end"
    frame = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    got = {r["run"] for r in text_runs(frame, ["id"], "text", [2, 3]).collect()}
    assert got == {text[i:i + n] for n in (2, 3) for i in range(len(text) - n + 1)}
