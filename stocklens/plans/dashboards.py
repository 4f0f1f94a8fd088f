"""Dashboard numbers over the current stock movements. Missing bounds do not restrict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.scalars import between, day, location_label
from stocklens.operators.ranking import top_by


def total_quantity(current: DataFrame, start: object | None = None, end: object | None = None) -> DataFrame:
    """One row; 0 when nothing moved."""
    rows = current.where(between(F.col("moved_at"), start, end))
    zero = F.lit(0).cast("decimal(24,3)")
    return rows.agg(F.coalesce(F.sum("quantity"), zero).alias("total_moved_quantity"))


def daily_by_type(current: DataFrame, start: object | None = None, end: object | None = None) -> DataFrame:
    rows = current.where(between(F.col("moved_at"), start, end))
    return (
        rows.groupBy(day(F.col("moved_at")).alias("movement_day"), "movement_type")
        .agg(F.sum("quantity").alias("total_quantity"))
        .orderBy("movement_day", "movement_type")
    )


def top_locations(
    current: DataFrame, start: object | None = None, end: object | None = None, n: int = 10
) -> DataFrame:
    rows = current.where(between(F.col("moved_at"), start, end))
    totals = rows.groupBy("warehouse_id").agg(F.sum("quantity").alias("total_quantity"))
    best = top_by(totals, [F.desc("total_quantity"), F.asc("warehouse_id")], n)
    return best.select(location_label(F.col("warehouse_id")).alias("warehouse_name"), "total_quantity")


def type_share(current: DataFrame) -> DataFrame:
    """Quantity per movement type and its share of the whole."""
    totals = current.groupBy("movement_type").agg(F.sum("quantity").alias("_sum"))
    whole = totals.agg(F.sum("_sum").alias("_all"))
    amount = F.col("_sum").cast("double")
    return (
        totals.crossJoin(F.broadcast(whole))
        .select(
            "movement_type",
            amount.alias("total_quantity"),
            F.try_divide(amount, F.col("_all").cast("double")).alias("share"),
        )
        .orderBy(F.desc("total_quantity"), "movement_type")
    )


def movement_by_id(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Current rows of the given movement ids."""
    return current.join(ids.select("inventory_movement_id"), "inventory_movement_id", "left_semi")
