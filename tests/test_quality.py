"""Checks that come with the scan of another job."""

import pytest
from pyspark.sql import functions as F

from stocklens.operators import quality
from stocklens.sources.shop import shop_tables


def test_counts_come_with_the_job_that_reads_the_rows(spark, folder, tmp_path):
    orders = shop_tables(spark, folder)["customer_orders"].withColumns(
        {
            "status": F.expr("CASE WHEN customer_order_id % 10 = 3 THEN 'lost' ELSE status END"),
            "created_at": F.expr("CASE WHEN customer_order_id % 20 <> 1 THEN created_at END"),
        }
    )
    rows, counts = quality.watched(orders, "customer_orders")
    rows.write.parquet(str(tmp_path / "o"))
    stored = spark.read.parquet(str(tmp_path / "o"))
    found = counts()
    assert found[("domain", "status")] == stored.where("status = 'lost'").count() > 0
    assert found[("not_null", "created_at")] == stored.where("created_at IS NULL").count() > 0
    assert {k: n for k, n in found.items() if n} == {k: found[k] for k in [("domain", "status"), ("not_null", "created_at")]}
    assert stored.count() == orders.count()


def test_a_table_is_scanned_once_for_all_that_its_rows_decide(spark, folder):
    movements = shop_tables(spark, folder)["inventory_movements"]
    found = quality.violations({"inventory_movements": movements})
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {(r.check_kind, r.subject) for r in found.collect()} == {
        ("not_null", c) for c in ("product_id", "warehouse_id", "movement_type", "quantity", "moved_at")
    } | {("domain", "movement_type")}


def test_no_rows_no_violations(spark, folder):
    tables = {n: shop_tables(spark, folder)[n].where("false") for n in ("customers", "customer_orders")}
    found = quality.violations(tables).collect()
    assert found and {r.violations for r in found} == {0}


@pytest.mark.parametrize("status", [None, "new"])
def test_null_is_in_every_domain(spark, status):
    df = spark.createDataFrame([(1, status)], "customer_order_id BIGINT, old_status STRING")
    found = {(r.check_kind, r.subject): r.violations for r in quality.violations({"order_status_events": df}).collect()}
    assert found[("domain", "old_status")] == 0 and ("unique", "order_status_event_id") not in found
