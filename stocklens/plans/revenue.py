"""Revenue by day and category, computed directly or from a stored aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions.scalars import between, day, instant
from stocklens.operators.ranking import top_by
from stocklens.plans.turnover import DEFAULT_FROM, DEFAULT_TO, product_catalog
from stocklens.sinks.periods import PERIOD, period_of, read_periods, touched, within, write_periods
from stocklens.sinks.versioned import publish, read_version, refresh

# What the report needs of each fact, in the layout by period of the order.
FACTS = {
    "customer_orders": "customer_order_id BIGINT, created_at TIMESTAMP",
    "customer_order_items": "customer_order_id BIGINT, product_id BIGINT, ordered_quantity DECIMAL(14,3), "
    "sale_price DECIMAL(14,2)",
    "customer_order_audit_notes": "customer_order_id BIGINT",
}
DAILY = "sales_day DATE, category_name STRING, order_count BIGINT, revenue DECIMAL(18,2), audit_note_count BIGINT"


def note_counts(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Audit notes per order, reduced before they meet the orders."""
    return notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("audit_note_count"))


def revenue_by_day_and_category(
    tables: dict[str, DataFrame], start: object | None = None, end: object | None = None
) -> DataFrame:
    """Orders, revenue and audit notes per day and category; unsorted, complete.

    An order counts its notes in every category it touches. Orders and lines
    meet in one shuffle on the order id, which also serves the grouping per
    order and the notes; a hot order is split by the skew join. Tables by
    period are joined on their period, too.
    """
    orders = tables["customer_orders"].where(between(F.col("created_at"), start, end))
    keys = ["customer_order_id", *([PERIOD] if PERIOD in orders.columns else [])]
    lines = tables["customer_order_items"].join(
        product_catalog(tables).select("product_id", "category_name"), "product_id"
    )
    per_order = (
        orders.select(*keys, day(F.col("created_at")).alias("sales_day"))
        .join(lines, keys)
        .groupBy(*keys, "sales_day", "category_name")
        .agg(F.sum(F.col("ordered_quantity") * F.col("sale_price")).alias("order_revenue"))
    )
    # Rows are unique per order, day and category here, so counting rows is
    # counting distinct orders, without the shuffle a distinct count needs.
    return (
        per_order.join(note_counts(tables["customer_order_audit_notes"], keys), keys, "left")
        .groupBy("sales_day", "category_name")
        .agg(
            F.count("customer_order_id").alias("order_count"),
            F.sum("order_revenue").cast("decimal(38,5)").alias("revenue"),
            F.sum(F.coalesce("audit_note_count", F.lit(0))).alias("audit_note_count"),
        )
    )


def newest_days(rows: DataFrame, limit: int) -> DataFrame:
    return top_by(rows, [F.desc("sales_day"), F.desc("revenue"), F.asc("category_name")], limit)


def revenue_by_day(
    tables: dict[str, DataFrame], start: object = DEFAULT_FROM, end: object = DEFAULT_TO, limit: int = 100
) -> DataFrame:
    """Newest days first, greatest revenue first within a day."""
    return newest_days(revenue_by_day_and_category(tables, start, end), limit)


def revenue_aggregate(tables: dict[str, DataFrame]) -> DataFrame:
    """Content of the stored aggregate: all days, revenue rounded to cents."""
    rows = revenue_by_day_and_category(tables)
    return rows.withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))


def build_revenue_aggregate(tables: dict[str, DataFrame], path: str) -> int:
    return publish(revenue_aggregate(tables), path)


def refresh_revenue_aggregate(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> int | None:
    """Rebuild beside the version in use, then switch; skipped if it was never built."""
    return refresh(path, spark, lambda: revenue_aggregate(tables))


def stored_revenue_by_day(
    spark: SparkSession, path: str, start: object = DEFAULT_FROM, end: object = DEFAULT_TO, limit: int = 100
) -> DataFrame:
    """The report from the stored aggregate. Whole days: the first bound's day is
    included and the second one's is not, whatever their time of day."""
    stored = read_version(spark, path)
    days = (F.col("sales_day") >= day(instant(start))) & (F.col("sales_day") < day(instant(end)))
    return newest_days(stored.where(days), limit)


def add_facts(spark: SparkSession, path: str, new: dict[str, DataFrame], unit: str = "day") -> list:
    """Append new orders, lines and notes to the facts by period below ``path``; returns the periods they touch.

    A line or note lies in the period of its order, which may be new itself or
    stored; lines and notes of unknown orders are no part of the report and
    are left out.
    """
    orders = new["customer_orders"].withColumn(PERIOD, period_of(F.col("created_at"), unit))
    stored = read_periods(spark, f"{path}/customer_orders", FACTS["customer_orders"])
    periods = orders.select("customer_order_id", PERIOD).unionByName(stored.select("customer_order_id", PERIOD))
    added = []
    for name, columns in FACTS.items():
        fields = [part.split()[0] for part in columns.split(", ")]
        rows = orders if name == "customer_orders" else new[name].join(periods, "customer_order_id")
        added.append((name, rows.select(*fields, PERIOD)))
    days = touched(*[rows for _, rows in added])
    # Orders last, so that those of this call are not looked up twice.
    for name, rows in reversed(added):
        write_periods(rows, f"{path}/{name}", ["customer_order_id"])
    return days


def facts(spark: SparkSession, path: str, catalog: DataFrame, periods: list | None = None) -> dict[str, DataFrame]:
    """The stored facts, of the given periods only if there are any given, beside the product catalog."""
    tables = {name: read_periods(spark, f"{path}/{name}", columns) for name, columns in FACTS.items()}
    if periods is not None:
        tables = {name: df.where(F.col(PERIOD).isin(periods)) for name, df in tables.items()}
    return {**tables, "product_catalog": catalog}


def revenue_from_periods(
    spark: SparkSession, path: str, catalog: DataFrame, start: object, end: object, unit: str = "day", limit: int = 100
) -> DataFrame:
    """The report from the facts by period; only the folders of the range are read, of lines and notes, too."""
    tables = facts(spark, path, catalog)
    bounded = {name: within(tables[name], start, end, unit) for name in FACTS}
    return newest_days(revenue_by_day_and_category({**tables, **bounded}, start, end), limit)


def refresh_periods(spark: SparkSession, path: str, catalog: DataFrame, periods: list, unit: str = "day") -> None:
    """Work the stored daily aggregate out again for the given periods; all others are neither read nor written."""
    if not periods:
        return
    rows = revenue_aggregate(facts(spark, path, catalog, periods))
    rows = rows.withColumn(PERIOD, period_of(F.col("sales_day"), unit))
    write_periods(rows, f"{path}/daily", ["sales_day", "category_name"], mode="overwrite")


def stored_daily(spark: SparkSession, path: str) -> DataFrame:
    return read_periods(spark, f"{path}/daily", DAILY)
