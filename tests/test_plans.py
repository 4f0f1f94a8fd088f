"""Shape of the physical plans."""

from pyspark.sql import functions as F

from stocklens.plans.revenue import revenue_by_day_and_category
from stocklens.plans.turnover import turnover
from stocklens.registry import QUERIES
from stocklens.session import configure, work_dir
from stocklens.sources.shop import shop_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(turnover(shop_tables(spark, folder), "1996-01-01", "1997-01-01"))
    scans = [line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in s and "LessThan(l_shipdate" in s for s in scans)
    assert all("l_extendedprice" not in s and "l_orderkey" not in s for s in scans)
    orders = plan(revenue_by_day_and_category(shop_tables(spark, folder), "1996-01-01", "1997-01-01"))
    assert "GreaterThanOrEqual(o_orderdate" in orders and "o_totalprice" not in orders


def test_ranks_are_limited_before_the_shuffle(spark, folder):
    text = plan(turnover(shop_tables(spark, folder), "1990-01-01", "2100-01-01"))
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)


def test_no_window_over_everything(spark, folder):
    for name in QUERIES:
        if name.startswith(("turnover", "current_m", "created_orders", "status_changes_events", "counter", "latency")):
            text = plan(QUERIES[name](spark, folder))
            for line in text.splitlines():
                if " Window [" in line:
                    assert "specifiedwindowframe" in line and not line.rstrip().endswith("[], []")
                    partition = line.split("windowspecdefinition(")[1]
                    assert not partition.startswith(("_chunk", "specified"))


def test_hot_order_is_split_by_the_skew_join(spark):
    """A third of all lines belong to one order; its partition is read in pieces."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    configure(spark)
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("customer_order_id"),
            F.col("id").alias("customer_order_item_id"),
            (F.col("id") % 4).alias("product_id"),
            F.lit(1).cast("decimal(14,3)").alias("ordered_quantity"),
            (F.col("id") % 97).cast("decimal(14,2)").alias("sale_price"),
        )
        tables = {
            "customer_order_items": lines,
            "customer_orders": lines.select("customer_order_id").distinct().withColumn(
                "created_at", F.lit("2021-01-01").cast("timestamp")
            ),
            "product_catalog": spark.range(4).select(
                F.col("id").alias("product_id"), F.lit("x").alias("category_name")
            ),
            "customer_order_audit_notes": spark.range(0).select(
                F.col("id").alias("customer_order_id"), F.col("id").alias("audit_note_id")
            ),
        }
        df = revenue_by_day_and_category(tables)
        (row,) = df.collect()
        assert row.order_count == lines.select("customer_order_id").distinct().count()
        assert row.revenue == lines.agg(F.sum("sale_price")).first()[0]
        assert "skewed" in plan(df) or "isSkew" in plan(df) or "skew=true" in plan(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shared_folder_comes_from_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
