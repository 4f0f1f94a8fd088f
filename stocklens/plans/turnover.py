"""Stock turnover: the products that move most at the busiest locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.scalars import between
from stocklens.operators.ranking import BROADCAST_ROWS, dense_top_per_group, top_keys

# Bounds and threshold used when a caller gives none.
DEFAULT_FROM = "2020-01-01T00:00:00Z"
DEFAULT_TO = "2100-01-01T00:00:00Z"
DEFAULT_MIN_QUANTITY = 1


def product_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Products with the names of their brand and category."""
    if "product_catalog" in tables:
        return tables["product_catalog"]
    return (
        tables["products"]
        .join(tables["brands"], "brand_id")
        .join(tables["product_categories"], "category_id")
        .select("product_id", "product_name", "brand_name", "category_name")
    )


def turnover(
    tables: dict[str, DataFrame],
    start: object = DEFAULT_FROM,
    end: object = DEFAULT_TO,
    min_quantity: float = DEFAULT_MIN_QUANTITY,
    top_locations: int | None = 100,
    top_products: int = 10,
) -> DataFrame:
    """Per location, the products with the greatest moved quantity.

    Receipts, shipments and corrections all count as positive: this is
    turnover, not stock on hand. Only the ``top_locations`` busiest locations
    are looked at (None: all). Products with equal quantity share a rank.

    The busiest locations are found from two narrow columns and sent to the
    tasks of the second scan, so only their rows are grouped. Names are joined
    to the few rows that remain.
    """
    moves = tables["inventory_movements"].where(between(F.col("moved_at"), start, end))
    locations = tables["warehouses"].select("warehouse_id", "warehouse_name")
    if top_locations is not None:
        busiest = top_keys(moves, "warehouse_id", "quantity", top_locations)
        locations = busiest.select("warehouse_id").join(locations, "warehouse_id")
        # At most top_locations rows, whatever the size of the tables.
        if top_locations <= BROADCAST_ROWS:
            locations = F.broadcast(locations)
    quantity = F.col("quantity")
    kind = F.col("movement_type")
    nothing = F.lit(0).cast("decimal(14,3)")

    def moved(*kinds: str):
        return F.sum(F.when(kind.isin(*kinds), quantity).otherwise(nothing)).cast("decimal(24,3)")

    products = tables["product_catalog" if "product_catalog" in tables else "products"]
    totals = (
        moves.join(locations.select("warehouse_id"), "warehouse_id", "left_semi")
        .groupBy("warehouse_id", "product_id")
        .agg(
            moved("receipt").alias("received_quantity"),
            moved("shipment").alias("shipped_quantity"),
            moved("write_off", "adjustment").alias("adjusted_quantity"),
        )
        .join(products.select("product_id"), "product_id", "left_semi")
        .withColumn(
            "total_quantity",
            (F.col("received_quantity") + F.col("shipped_quantity") + F.col("adjusted_quantity")).cast("decimal(26,3)"),
        )
        .where(F.col("total_quantity") >= F.lit(min_quantity))
    )
    # Every ranked row belongs to a known location, so their number limits the groups.
    groups = top_locations if top_locations is not None else locations.count()
    ranked = dense_top_per_group(
        totals, "warehouse_id", "total_quantity", top_products, "product_rank", max_groups=groups
    )
    return (
        ranked.join(locations, "warehouse_id")
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "warehouse_id",
            "warehouse_name",
            "product_id",
            "product_name",
            "received_quantity",
            "shipped_quantity",
            "adjusted_quantity",
            "total_quantity",
            "product_rank",
        )
        .orderBy("warehouse_name", "product_rank", "product_name", "product_id")
    )
