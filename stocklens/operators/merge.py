"""Keyed merges. Each gives the new table content; writing it is the caller's step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def single_rows(source: DataFrame, keys: list[str]) -> DataFrame:
    """``source`` unchanged, or an error at run time if a key comes twice."""
    fields = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), F.first(F.struct(F.lit(True).alias("_there"), *fields)).alias("_row")
    )
    message = F.concat(F.lit("key occurs more than once in the source: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_copies") == 1, F.col("_row")).otherwise(F.raise_error(message))
    return one.select(*keys, checked.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in fields])


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update: list[str] | None = None,
) -> DataFrame:
    """Insert the source rows; where the key exists, overwrite the ``update`` columns.

    An overwriting NULL counts: presence of the source row decides, not the
    value. A key that comes twice in the source is an error. A target in
    buckets of the keys stays where it is; see ``sinks.bucketed``.
    """
    fields = [c for c in target.columns if c not in keys]
    given = [c for c in source.columns if c not in keys]
    update = given if update is None else update
    old = target.select(*keys, F.struct(F.lit(True).alias("_there"), *fields).alias("_old"))
    new = single_rows(source, keys).select(*keys, F.struct(F.lit(True).alias("_there"), *given).alias("_new"))

    def merged(name: str) -> Column:
        kind = target.schema[name].dataType
        before = F.col("_old")[name]
        after = F.col("_new")[name].cast(kind) if name in given else F.lit(None).cast(kind)
        overwrite = F.col("_new").isNotNull() if name in update else F.col("_old").isNull()
        return F.when(overwrite, after).otherwise(before).alias(name)

    both = old.join(new, keys, "full")
    columns = [F.col(c) if c in keys else merged(c) for c in target.columns]
    return both.select(*columns)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Add the source rows whose key is absent; of equal source keys the first by ``order`` is kept.

    Rows equal in ``order``, or all if there is none, go by their other columns
    as the target has them.
    """
    absent = source.join(target.select(*keys), keys, "left_anti")
    fields = [c for c in target.columns if c not in keys]
    if not fields:
        return target.unionByName(absent.select(*target.columns).distinct())
    place = F.struct(*[F.col(c).alias(f"_order_{c}") for c in order or []], *fields)
    first = absent.groupBy(*keys).agg(F.min(place).alias("_first"))
    return target.unionByName(first.select(*keys, *[F.col("_first")[c].alias(c) for c in fields]))


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys), keys, "left_anti")


def evolve(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to ``schema``, adding its new columns as NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def item_totals(items: DataFrame) -> DataFrame:
    """Amount and number of lines per order."""
    return items.groupBy("customer_order_id").agg(
        F.sum(F.col("ordered_quantity") * F.col("sale_price")).cast("decimal(14,2)").alias("total_amount"),
        F.count(F.lit(1)).cast("int").alias("items_count"),
    )


def backfill_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Fill the denormalized totals of orders from their lines.

    Orders with lines get fresh totals and their creation time as the last
    status change; for the others only missing values are filled.
    """
    totals = item_totals(items).select(
        "customer_order_id", F.col("total_amount").alias("_amount"), F.col("items_count").alias("_count")
    )
    has_lines = F.col("_count").isNotNull()
    return (
        orders.join(totals, "customer_order_id", "left")
        .withColumns(
            {
                "total_amount": F.when(has_lines, F.coalesce("_amount", F.lit(0)))
                .otherwise(F.coalesce("total_amount", F.lit(0)))
                .cast("decimal(14,2)"),
                "items_count": F.coalesce("_count", "items_count", F.lit(0)).cast("int"),
                "last_status_changed_at": F.when(has_lines, F.col("created_at")).otherwise(
                    F.coalesce("last_status_changed_at", "created_at")
                ),
            }
        )
        .select(*orders.columns)
    )
