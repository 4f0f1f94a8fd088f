"""Order documents: header, customer, audit summary and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklens.plans.turnover import product_catalog

# Lines of a long order that are sorted together.
CHUNK_LINES = 100_000

HEADER = [
    "customer_order_id",
    "customer_id",
    "full_name",
    "delivery_address",
    "created_at",
    "status",
    "delivery_priority",
    "total_amount",
    "items_count",
    "audit_note_count",
    "last_audit_note",
]
ITEM = [
    "customer_order_item_id",
    "product_id",
    "product_name",
    "brand_name",
    "category_name",
    "ordered_quantity",
    "sale_price",
]


def audit_summary(notes: DataFrame) -> DataFrame:
    """Number of notes and the newest note text per order."""
    return notes.groupBy("customer_order_id").agg(
        F.count(F.lit(1)).alias("audit_note_count"),
        F.max_by("note_text", F.struct("created_at", "audit_note_id")).alias("last_audit_note"),
    )


def chosen(df: DataFrame, order_ids: DataFrame | None) -> DataFrame:
    if order_ids is None:
        return df
    return df.join(order_ids.select("customer_order_id"), "customer_order_id", "left_semi")


def order_headers(tables: dict[str, DataFrame], order_ids: DataFrame | None = None) -> DataFrame:
    """One row per order with its customer and audit summary."""
    return (
        chosen(tables["customer_orders"], order_ids)
        .join(tables["customers"].select("customer_id", "full_name"), "customer_id")
        .join(audit_summary(tables["customer_order_audit_notes"]), "customer_order_id", "left")
        .withColumn("audit_note_count", F.coalesce("audit_note_count", F.lit(0)))
        .select(*HEADER)
    )


def named_items(tables: dict[str, DataFrame], order_ids: DataFrame | None = None) -> DataFrame:
    items = chosen(tables["customer_order_items"], order_ids)
    return items.join(product_catalog(tables), "product_id").select("customer_order_id", *ITEM)


def order_lines(tables: dict[str, DataFrame], order_ids: DataFrame | None = None) -> DataFrame:
    """One row per order line with the order's header repeated.

    ``order_ids`` (column ``customer_order_id``) restricts the orders. Orders
    without lines give no row; orders without notes count 0.
    """
    return order_headers(tables, order_ids).join(named_items(tables, order_ids), "customer_order_id")


def in_parts(lines: DataFrame, long: DataFrame, lines_per_part: int) -> DataFrame:
    """The lines of the ``long`` orders with the ``part`` their place among the order's lines falls into.

    An order's range of line ids is cut into as many chunks as its number of
    lines asks for. Places are counted inside a chunk, and one row per chunk
    says how many lines come before it, so no order is sorted as a whole.
    """
    width = F.expr(f"(_most - _least) div (1 + _lines div {CHUNK_LINES}) + 1")
    chunk = F.expr("(customer_order_item_id - _least) div _width")
    rows = lines.join(long.withColumn("_width", width), "customer_order_id").withColumn("_chunk", chunk)
    key = ["customer_order_id", "_chunk"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("customer_order_id").orderBy("_chunk")) - F.col("_size")
    starts = sizes.select(*key, before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.struct(*ITEM))) - 1
    placed = rows.withColumn("_place", place).join(starts, key)
    part = F.floor((F.col("_before") + F.col("_place")) / lines_per_part).cast("int")
    return placed.select(*lines.columns, part.alias("part"))


def order_documents(
    tables: dict[str, DataFrame], order_ids: DataFrame | None = None, lines_per_part: int = 10_000
) -> DataFrame:
    """One document per order with its lines as an array sorted by line id.

    An order with more than ``lines_per_part`` lines comes in several parts of
    that many lines, the last one of the rest, each with the full header; no
    line is left out and no task builds an unlimited array. Lines are gathered
    before they meet the headers, so a header moves once per document.
    """
    items = named_items(tables, order_ids)
    line_id = F.col("customer_order_item_id")
    sizes = chosen(tables["customer_order_items"], order_ids).groupBy("customer_order_id")
    sizes = sizes.agg(F.count(F.lit(1)).alias("_lines"), F.min(line_id).alias("_least"), F.max(line_id).alias("_most"))
    long = sizes.where(F.col("_lines") > lines_per_part)
    gathered = F.array_sort(F.collect_list(F.struct(*ITEM))).alias("items")
    whole = items.join(long.select("customer_order_id"), "customer_order_id", "left_anti").groupBy("customer_order_id")
    parts = in_parts(items, long, lines_per_part).groupBy("customer_order_id", "part")
    documents = whole.agg(F.lit(0).alias("part"), gathered).unionByName(parts.agg(gathered))
    return order_headers(tables, order_ids).join(documents, "customer_order_id").select(*HEADER, "part", "items")


def order_responses(documents: DataFrame) -> DataFrame:
    """Each document (part) as JSON text: ``{"order": …, "items": […]}``.

    Decimals and times (UTC) are strings; a missing amount or count reads as 0.
    """
    order = F.struct(
        F.col("customer_order_id").alias("order_id"),
        "customer_id",
        F.col("full_name").alias("customer_name"),
        "delivery_address",
        F.concat(F.col("created_at").cast("string"), F.lit("+00")).alias("created_at"),
        "status",
        "delivery_priority",
        F.coalesce(F.col("total_amount").cast("string"), F.lit("0")).alias("total_amount"),
        F.coalesce("items_count", F.lit(0)).alias("items_count"),
        "audit_note_count",
        "last_audit_note",
    )
    items = F.transform(
        "items",
        lambda i: F.struct(
            i["customer_order_item_id"].alias("order_item_id"),
            i["product_id"].alias("product_id"),
            i["product_name"].alias("product_name"),
            i["brand_name"].alias("brand_name"),
            i["category_name"].alias("category_name"),
            i["ordered_quantity"].cast("string").alias("ordered_quantity"),
            i["sale_price"].cast("string").alias("sale_price"),
        ),
    )
    body = F.to_json(F.struct(order.alias("order"), items.alias("items")), {"ignoreNullFields": "false"})
    return documents.select("customer_order_id", "part", body.alias("body"))
