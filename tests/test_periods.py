"""Facts by period: pruning, appending and refreshing."""

import datetime
import os
import re

import pytest
from pyspark.sql import functions as F

from stocklens.plans import revenue
from stocklens.sinks.periods import PERIOD, period_of, read_periods, touched, within, write_periods

UNIT = "month"


@pytest.fixture
def shop(spark):
    orders = spark.range(1, 241).select(
        F.col("id").alias("customer_order_id"),
        F.expr("TIMESTAMP '2021-01-05 10:00:00' + make_interval(0, 0, 0, CAST(id * 3 AS INT))").alias("created_at"),
    )
    items = spark.range(0, 720).select(
        (F.col("id") % 240 + 1).alias("customer_order_id"),
        (F.col("id") % 11).alias("product_id"),
        (F.col("id") % 7 + 1).cast("decimal(14,3)").alias("ordered_quantity"),
        F.lit("2.50").cast("decimal(14,2)").alias("sale_price"),
    )
    notes = spark.range(0, 400).select((F.col("id") % 250 + 1).alias("customer_order_id"))
    catalog = spark.range(0, 11).select(
        F.col("id").alias("product_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("category_name")
    )
    facts = {"customer_orders": orders, "customer_order_items": items, "customer_order_audit_notes": notes}
    return facts, catalog


def files_read(df):
    """Files and folders of each scan, as they are once dynamic filters are known."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", plan), plan


def test_a_bounded_report_reads_its_months(spark, shop, tmp_path, rows):
    facts, catalog = shop
    path = str(tmp_path)
    revenue.add_facts(spark, path, facts, UNIT)
    bounds = ("2021-04-10T00:00:00Z", "2021-06-20T12:00:00Z")
    found = revenue.revenue_from_periods(spark, path, catalog, *bounds, UNIT)
    expected = revenue.revenue_by_day({**facts, "product_catalog": catalog}, *bounds)
    assert rows(found) == rows(expected) and found.count() > 20
    filters, _ = files_read(found)
    stored = [f for f in filters if "period" in f]
    assert len(stored) >= 3 and all("2021-04-01" in f and "2021-06-01" in f for f in stored)
    lines = within(revenue.facts(spark, path, catalog)["customer_order_items"], *bounds, UNIT)
    assert {re.search("period=([0-9-]+)", f)[1] for f in lines.inputFiles()} >= {"2021-04-01"}
    months = lines.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert {re.search("period=([0-9-]+)", r.f)[1] for r in months} == {"2021-04-01", "2021-05-01", "2021-06-01"}


def test_lines_are_pruned_by_the_orders_that_are_left(spark, shop, tmp_path):
    facts, catalog = shop
    revenue.add_facts(spark, str(tmp_path), facts, UNIT)
    tables = revenue.facts(spark, str(tmp_path), catalog)
    few = {**tables, "customer_orders": tables["customer_orders"].where("customer_order_id IN (17, 18)")}
    found = revenue.revenue_by_day_and_category(few)
    _, plan = files_read(found)
    assert "dynamicpruning" in plan
    assert found.agg(F.sum("order_count")).first()[0] > 0


def test_refresh_works_on_touched_months_only(spark, shop, tmp_path, rows):
    facts, catalog = shop
    path = str(tmp_path)
    late = (F.col("customer_order_id").between(40, 50)) & (F.col("product_id") > 4)
    items = facts["customer_order_items"]
    revenue.refresh_periods(spark, path, catalog, revenue.add_facts(spark, path, {**facts, "customer_order_items": items.where(~late)}, UNIT), UNIT)
    before = rows(revenue.stored_daily(spark, path).drop(PERIOD))
    stamps = {f: os.stat(f).st_mtime_ns for f in data_files(f"{path}/daily")}
    none = {name: facts[name].where("false") for name in ("customer_orders", "customer_order_audit_notes")}
    months = revenue.add_facts(spark, path, {**none, "customer_order_items": items.where(late)}, UNIT)
    assert months == [datetime.date(2021, 5, 1), datetime.date(2021, 6, 1)]
    read = revenue.facts(spark, path, catalog, months)["customer_order_items"]
    assert touched(read) == months
    revenue.refresh_periods(spark, path, catalog, months, UNIT)
    whole = rows(revenue.revenue_aggregate({**facts, "product_catalog": catalog}))
    assert rows(revenue.stored_daily(spark, path).drop(PERIOD)) == whole and before != whole
    for file in data_files(f"{path}/daily"):
        assert (file in stamps) == ("period=2021-05" not in file and "period=2021-06" not in file)
    revenue.refresh_periods(spark, path, catalog, [], UNIT)
    assert rows(revenue.stored_daily(spark, path).drop(PERIOD)) == whole


def data_files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_nothing_stored_yet(spark, shop, tmp_path):
    _, catalog = shop
    assert revenue.stored_daily(spark, str(tmp_path / "none")).count() == 0
    report = revenue.revenue_from_periods(spark, str(tmp_path / "none"), catalog, "2021-01-01", "2022-01-01")
    assert report.count() == 0


def test_a_hot_period_is_several_sorted_files(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 4).select(
        (F.col("id") * 7919 % 400_000).alias("k"),
        F.when(F.col("id") % 100 == 0, F.lit("2021-02-03")).otherwise(F.lit("2021-01-02")).cast("timestamp").alias("ts"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        write_periods(rows.withColumn(PERIOD, period_of(F.col("ts"), "day")), str(tmp_path / "t"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = data_files(str(tmp_path / "t"))
    assert sum("2021-01-02" in f for f in files) > 3
    for file in files:
        keys = [r.k for r in spark.read.parquet(file).collect()]
        assert keys == sorted(keys)
    stored = read_periods(spark, str(tmp_path / "t"), "k BIGINT, ts TIMESTAMP")
    assert stored.count() == 400_000 and within(stored, "2021-02-01", None, "day").count() == 4000
