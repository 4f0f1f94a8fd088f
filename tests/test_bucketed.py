"""Merges and joins on bucketed tables: results, and what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from stocklens.operators.merge import backfill_totals, insert_missing, upsert
from stocklens.plans import orders as order_plans
from stocklens.plans.revenue import revenue_by_day_and_category
from stocklens.sinks import bucketed
from stocklens.sources.shop import shop_tables

BUCKETS = 6


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Small test tables would be broadcast by their size; the plans of large ones are looked at."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def target(spark):
    rows = spark.range(0, 3000, 1, 5).select(F.col("id").alias("k"), F.lit("x").alias("a"), F.col("id").alias("b"))
    name = bucketed.write_bucketed(rows, ["k"], BUCKETS)
    yield name, rows
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def planned(df):
    """The plan as it is before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def shuffled(df):
    """The columns of each shuffle in the plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", planned(df))


def test_layout_is_read_back(spark, target):
    assert bucketed.layout_of(spark, target[0]) == (["k"], BUCKETS)


def test_a_merge_shuffles_the_source_only(spark, target, rows):
    name, plain = target
    source = spark.createDataFrame([(5, None, 50), (9000, "z", 30)], "k BIGINT, a STRING, b BIGINT")
    merged = bucketed.merged(spark, name, source, ["b"])
    assert len(shuffled(merged)) == 1 and "Bucketed: true" in planned(merged)
    assert rows(merged) == rows(upsert(plain, source, ["k"], ["b"]))
    new = bucketed.upsert_into(spark, name, source, ["b"])
    assert bucketed.layout_of(spark, new) == (["k"], BUCKETS)
    assert rows(spark.table(new)) == rows(merged)
    # The new table was written where the rows lay: a file for each bucket, and it merges as the first one did.
    files = {r[0] for r in spark.table(new).select(F.input_file_name()).distinct().collect()}
    assert len(files) == BUCKETS
    again = bucketed.upsert_into(spark, new, source)
    assert spark.table(again).where("k = 5").collect()[0][1:] == (None, 50)
    for table in (new, again):
        spark.sql(f"DROP TABLE {table}")


def test_insert_missing_leaves_the_target(spark, target, rows):
    name, plain = target
    source = spark.createDataFrame([(5, "no", 1), (7000, "y", 2), (7000, "w", 3)], "k BIGINT, a STRING, b BIGINT")
    found = bucketed.insert_missing_into(spark, name, source, order=["b"])
    assert rows(found) == rows(insert_missing(plain, source, ["k"], order=["b"]))
    assert len(shuffled(found)) == 1 and "Bucketed: true" in planned(found)


def test_a_repeated_source_key_is_still_an_error(spark, target):
    twice = spark.createDataFrame([(5, "a", 1), (5, "b", 2)], "k BIGINT, a STRING, b BIGINT")
    with pytest.raises(Exception, match="more than once"):
        bucketed.upsert_into(spark, target[0], twice)


@pytest.fixture(scope="module")
def shop(spark, folder):
    tables = shop_tables(spark, folder)
    names = ["customer_orders", "customer_order_items", "customer_order_audit_notes"]
    made = {n: bucketed.write_bucketed(tables[n], ["customer_order_id"], BUCKETS) for n in names}
    yield tables, {n: spark.table(t) for n, t in made.items()}
    for t in made.values():
        spark.sql(f"DROP TABLE {t}")


def test_totals_of_lines_need_no_shuffle(shop, rows):
    tables, stored = shop
    found = backfill_totals(stored["customer_orders"], stored["customer_order_items"])
    assert shuffled(found) == []
    assert rows(found) == rows(backfill_totals(tables["customer_orders"], tables["customer_order_items"]))


def test_status_changes_shuffle_the_commands(spark, shop, rows):
    tables, stored = shop
    after = order_plans.apply_status_changes(stored["customer_orders"], tables["status_commands"], "2024-02-01")
    # Twice the commands: to find the last of each order, and into the buckets.
    assert len(shuffled(after.orders)) == 2 and "Bucketed: true" in planned(after.orders)
    assert all(f", {n}" in keys for keys, n in zip(shuffled(after.orders), (BUCKETS, 4), strict=True))
    plain = order_plans.apply_status_changes(tables["customer_orders"], tables["status_commands"], "2024-02-01")
    assert rows(after.orders) == rows(plain.orders)


def test_revenue_joins_orders_lines_and_notes_in_place(shop, rows):
    tables, stored = shop
    catalog = tables["product_catalog"].select("product_id", F.lit("all").alias("category_name"))
    found = revenue_by_day_and_category({**stored, "product_catalog": F.broadcast(catalog)})
    assert all("customer_order_id" not in keys for keys in shuffled(found)) and len(shuffled(found)) == 1
    assert rows(found) == rows(revenue_by_day_and_category({**tables, "product_catalog": catalog}))
