"""Synthetic shop tables of any size.

Rows are computed from integer series where they are used: apart from the
stock movements, which are joined from shipments and receipts, no table needs
a shuffle. ``n`` is the seed count, ``as_of`` the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens import schemas
from stocklens.functions.scalars import cyclic, days_before, instant, padded_phone
from stocklens.operators.merge import insert_missing, upsert
from stocklens.operators.ordered import assign_ids, next_id
from stocklens.schemas import SEED_HISTORY
from stocklens.sinks.versioned import publish, read_if_there, read_version
from stocklens.sources.series import grid, inline_rows, series

# Category names, cycles and first ids of the generated rows.
CATEGORIES = ["Electronics", "Home", "Books", "Office", "Sports", "Clothing", "Beauty", "Food"]
POSITIONS = ["manager", "operator", "picker", "accountant"]
UNITS = ["pcs", "kg", "box"]
SUPPLIER_ORDER_CYCLE = ["placed", "partially_received", "received", "draft"]
CUSTOMER_ORDER_CYCLE = ["new", "confirmed", "picking", "shipped", "delivered"]
SHIPMENT_CYCLE = ["created", "dispatched", "delivered"]
SUPPLIER_ORDER_BASE = 300_000
SUPPLIER_ORDER_ITEM_BASE = 310_000
RECEIPT_BASE = 320_000
RECEIPT_ITEM_BASE = 330_000
CUSTOMER_ORDER_BASE = 400_000
CUSTOMER_ORDER_ITEM_BASE = 410_000
SHIPMENT_BASE = 500_000
SHIPMENT_ITEM_BASE = 510_000
RECEIPT_MOVEMENT_BASE = 530_000
SHIPMENT_MOVEMENT_BASE = 540_000


def pick(n: Column, values: list[str]) -> Column:
    """The value at place ``n mod len(values)``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def quantity(value: Column) -> Column:
    return value.cast("decimal(14,3)")


def money(value: Column) -> Column:
    return value.cast("decimal(14,2)")


def sizes(n: int) -> dict[str, int]:
    """Rows of the tables that other tables cycle through."""
    return {
        "product_categories": len(CATEGORIES),
        "brands": max(10, 2 * n),
        "warehouses": max(3, n // 2),
        "suppliers": 2 * n,
        "employees": max(5, n),
        "customers": 5 * n,
        "products": 10 * n,
    }


def categories(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    named = inline_rows(spark, CATEGORIES, "category_name")
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category_name"))
    return named.select(place.alias("category_id"), "category_name")


def brands(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, sizes(n)["brands"]).select(
        i.alias("brand_id"), F.format_string("Brand %d", i).alias("brand_name")
    )


def locations(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, sizes(n)["warehouses"]).select(
        i.alias("warehouse_id"),
        F.format_string("Warehouse %d", i).alias("warehouse_name"),
        F.format_string("City %d", cyclic(i, 5)).alias("city"),
    )


def suppliers(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, sizes(n)["suppliers"]).select(
        i.alias("supplier_id"),
        F.format_string("Supplier %d", i).alias("supplier_name"),
        F.format_string("supplier%d@example.com", i).alias("email"),
        padded_phone("+100000", i).alias("phone"),
    )


def employees(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, sizes(n)["employees"]).select(
        i.alias("employee_id"),
        F.format_string("Employee %d", i).alias("full_name"),
        F.format_string("employee%d@example.com", i).alias("email"),
        pick(i, POSITIONS).alias("position_name"),
        F.date_sub(F.to_date(instant(as_of)), (i % 700).cast("int")).alias("hired_at"),
    )


def customers(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, sizes(n)["customers"]).select(
        i.alias("customer_id"),
        F.format_string("Customer %d", i).alias("full_name"),
        F.format_string("customer%d@example.com", i).alias("email"),
        padded_phone("+200000", i).alias("phone"),
        days_before(instant(as_of), (i % 365).cast("int")).alias("created_at"),
    )


def products(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, sizes(n)["products"]).select(
        i.alias("product_id"),
        cyclic(i, sizes(n)["product_categories"]).alias("category_id"),
        cyclic(i, sizes(n)["brands"]).alias("brand_id"),
        F.format_string("Product %d", i).alias("product_name"),
        pick(i, UNITS).alias("unit_of_measure"),
    )


def supplier_orders(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, 2 * n).select(
        (i + SUPPLIER_ORDER_BASE).alias("supplier_order_id"),
        cyclic(i, sizes(n)["suppliers"]).alias("supplier_id"),
        cyclic(i, sizes(n)["employees"]).alias("created_by_employee_id"),
        F.date_sub(F.to_date(instant(as_of)), (i % 45).cast("int")).alias("order_date"),
        pick(i, SUPPLIER_ORDER_CYCLE).alias("status"),
    )


def line_number(per_order: int) -> Column:
    return (F.col("order_n") - 1) * per_order + F.col("line_n")


def line_product(n: int) -> Column:
    return cyclic(F.col("order_n") + F.col("line_n") - 1, sizes(n)["products"])


def supplier_order_items(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    order, line = F.col("order_n"), F.col("line_n")
    return grid(spark, 2 * n, 2).select(
        (line_number(2) + SUPPLIER_ORDER_ITEM_BASE).alias("supplier_order_item_id"),
        (order + SUPPLIER_ORDER_BASE).alias("supplier_order_id"),
        line_product(n).alias("product_id"),
        quantity(line + order % 5 + 1).alias("ordered_quantity"),
        money(order % 80 + 10).alias("unit_price"),
    )


def goods_receipts(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, 2 * n).select(
        (i + RECEIPT_BASE).alias("goods_receipt_id"),
        (i + SUPPLIER_ORDER_BASE).alias("supplier_order_id"),
        cyclic(i, sizes(n)["warehouses"]).alias("warehouse_id"),
        cyclic(i, sizes(n)["employees"]).alias("accepted_by_employee_id"),
        days_before(instant(as_of), (i % 20).cast("int")).alias("received_at"),
    )


def goods_receipt_items(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    order, line = F.col("order_n"), F.col("line_n")
    return grid(spark, 2 * n, 2).select(
        (line_number(2) + RECEIPT_ITEM_BASE).alias("goods_receipt_item_id"),
        (order + RECEIPT_BASE).alias("goods_receipt_id"),
        (line_number(2) + SUPPLIER_ORDER_ITEM_BASE).alias("supplier_order_item_id"),
        quantity(line + order % 5 + 1).alias("received_quantity"),
        money(order % 90 + 12).alias("unit_cost"),
        F.date_add(F.to_date(instant(as_of)), (order % 365).cast("int")).alias("expiration_date"),
    )


def customer_orders(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, 5 * n).select(
        (i + CUSTOMER_ORDER_BASE).alias("customer_order_id"),
        cyclic(i, sizes(n)["customers"]).alias("customer_id"),
        F.format_string("Street %d, Building %d", cyclic(i, 70), cyclic(i, 30)).alias("delivery_address"),
        days_before(instant(as_of), (i % 25).cast("int")).alias("created_at"),
        pick(i, CUSTOMER_ORDER_CYCLE).alias("status"),
    )


def customer_order_items(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    order, line = F.col("order_n"), F.col("line_n")
    return grid(spark, 5 * n, 4).select(
        (line_number(4) + CUSTOMER_ORDER_ITEM_BASE).alias("customer_order_item_id"),
        (order + CUSTOMER_ORDER_BASE).alias("customer_order_id"),
        line_product(n).alias("product_id"),
        quantity(line + 1).alias("ordered_quantity"),
        money((order + line) % 120 + 20).alias("sale_price"),
    )


def shipments(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    i = F.col("n")
    return series(spark, 5 * n).select(
        (i + SHIPMENT_BASE).alias("shipment_id"),
        (i + CUSTOMER_ORDER_BASE).alias("customer_order_id"),
        cyclic(i, sizes(n)["warehouses"]).alias("warehouse_id"),
        cyclic(i, sizes(n)["employees"]).alias("shipped_by_employee_id"),
        days_before(instant(as_of), (i % 10).cast("int")).alias("shipped_at"),
        pick(i, SHIPMENT_CYCLE).alias("status"),
    )


def shipment_items(spark: SparkSession, n: int, as_of: object) -> DataFrame:
    order, line = F.col("order_n"), F.col("line_n")
    return grid(spark, 5 * n, 2).select(
        (line_number(2) + SHIPMENT_ITEM_BASE).alias("shipment_item_id"),
        (order + SHIPMENT_BASE).alias("shipment_id"),
        (line_number(4) + CUSTOMER_ORDER_ITEM_BASE).alias("customer_order_item_id"),
        quantity(line + 1).alias("shipped_quantity"),
    )


def shipped_movements(tables: dict[str, DataFrame]) -> DataFrame:
    """Movements of the shipped lines, without ids."""
    return (
        tables["shipment_items"]
        .join(tables["shipments"].drop("customer_order_id", "status"), "shipment_id")
        .join(tables["customer_order_items"].select("customer_order_item_id", "product_id"), "customer_order_item_id")
        .select(
            F.col("shipment_item_id").alias("source_id"),
            "product_id",
            "warehouse_id",
            F.lit("shipment").alias("movement_type"),
            F.col("shipped_quantity").alias("quantity"),
            F.col("shipped_at").alias("moved_at"),
            F.col("shipped_by_employee_id").alias("employee_id"),
        )
    )


def received_movements(tables: dict[str, DataFrame]) -> DataFrame:
    """Movements of the received lines, without ids."""
    return (
        tables["goods_receipt_items"]
        .join(tables["goods_receipts"].drop("supplier_order_id"), "goods_receipt_id")
        .join(tables["supplier_order_items"].select("supplier_order_item_id", "product_id"), "supplier_order_item_id")
        .select(
            F.col("goods_receipt_item_id").alias("source_id"),
            "product_id",
            "warehouse_id",
            F.lit("receipt").alias("movement_type"),
            F.col("received_quantity").alias("quantity"),
            F.col("received_at").alias("moved_at"),
            F.col("accepted_by_employee_id").alias("employee_id"),
        )
    )


def movements(tables: dict[str, DataFrame], non_overlapping_ids: bool = False) -> DataFrame:
    """Shipment movements, then receipt movements written over them by id.

    The two id ranges start 10,000 apart, so from 10,001 received lines on a
    receipt takes the id of a shipment and replaces it. That is the defined
    result; ``non_overlapping_ids`` numbers the receipts after the shipments
    instead and keeps all rows.
    """
    key = "inventory_movement_id"
    shipped = assign_ids(shipped_movements(tables), key, ["source_id"], start=SHIPMENT_MOVEMENT_BASE + 1)
    received = assign_ids(received_movements(tables), key, ["source_id"], start=RECEIPT_MOVEMENT_BASE + 1)
    columns = [key, "product_id", "warehouse_id", "movement_type", "quantity", "moved_at", "employee_id"]
    shipped, received = shipped.select(*columns), received.select(*columns)
    if non_overlapping_ids:
        top = shipped.agg(F.max(key).alias("_top"))
        moved = received.crossJoin(F.broadcast(top)).withColumn(
            key, F.col(key) + F.greatest(F.col("_top") - RECEIPT_MOVEMENT_BASE, F.lit(0))
        )
        return shipped.unionByName(moved.select(*columns))
    return upsert(shipped, received, [key])


# Builders of the generated tables: (session, seed count, clock) -> rows.
TABLES = {
    "product_categories": categories,
    "brands": brands,
    "warehouses": locations,
    "suppliers": suppliers,
    "employees": employees,
    "customers": customers,
    "products": products,
    "supplier_orders": supplier_orders,
    "supplier_order_items": supplier_order_items,
    "goods_receipts": goods_receipts,
    "goods_receipt_items": goods_receipt_items,
    "customer_orders": customer_orders,
    "customer_order_items": customer_order_items,
    "shipments": shipments,
    "shipment_items": shipment_items,
}


def generate(spark: SparkSession, n: int, as_of: object) -> dict[str, DataFrame]:
    """All generated tables but the movements, which :func:`movements` makes from them."""
    if n < 1:
        raise ValueError("the seed count has to be at least 1")
    return {name: build(spark, n, as_of) for name, build in TABLES.items()}


def probe_movement(tables: dict[str, DataFrame], movement_id: int, as_of: object) -> DataFrame:
    """One adjustment that refers to the first product, location and employee, for trying out the change stream."""
    row = tables["products"].agg(F.min("product_id").alias("product_id"))
    for table, key in [("warehouses", "warehouse_id"), ("employees", "employee_id")]:
        row = row.crossJoin(F.broadcast(tables[table].agg(F.min(key).alias(key))))
    return row.select(
        F.lit(movement_id).cast("bigint").alias("inventory_movement_id"),
        "product_id",
        "warehouse_id",
        F.lit("adjustment").alias("movement_type"),
        F.lit("11.111").cast("decimal(14,3)").alias("quantity"),
        instant(as_of).alias("moved_at"),
        "employee_id",
    )


# Tables written by each seed step, with the key rows are merged on. Names and
# mails identify the rows of the small tables, ids the others.
SEED_STEPS: dict[int, dict[str, list[str]]] = {
    1: {
        "product_categories": ["category_name"],
        "brands": ["brand_name"],
        "warehouses": ["warehouse_name"],
        "suppliers": ["supplier_name"],
        "employees": ["email"],
        "customers": ["email"],
    },
    2: {"products": ["brand_id", "product_name"]},
    3: {
        "supplier_orders": ["supplier_order_id"],
        "supplier_order_items": ["supplier_order_item_id"],
        "goods_receipts": ["goods_receipt_id"],
        "goods_receipt_items": ["goods_receipt_item_id"],
    },
    4: {"customer_orders": ["customer_order_id"], "customer_order_items": ["customer_order_item_id"]},
    5: {
        "shipments": ["shipment_id"],
        "shipment_items": ["shipment_item_id"],
        "inventory_movements": ["inventory_movement_id"],
    },
}
MOVEMENT_SOURCES = [
    "shipments",
    "shipment_items",
    "customer_order_items",
    "goods_receipts",
    "goods_receipt_items",
    "supplier_order_items",
]
KEEP_EXISTING = {"product_categories", "brands"}
# Tables whose rows are not known by their id, with what they are known by.
NATURAL_KEYS = {name: keys for step in (1, 2) for name, keys in SEED_STEPS[step].items()}


def merge_table(spark: SparkSession, rows: DataFrame, path: str, name: str, keys: list[str]) -> None:
    """Publish the table with ``rows`` merged in; ids of existing rows stay, and new rows whose id one of
    those has are numbered after all."""
    try:
        old = read_version(spark, path)
    except FileNotFoundError:
        publish(rows, path)
        return
    row_id = rows.columns[0]
    if row_id not in keys:
        known, taken = old.select(*keys), old.select(row_id)
        absent = rows.join(known, keys, "left_anti")
        after = max(next_id(old, row_id), next_id(rows, row_id))
        moved = assign_ids(absent.join(taken, row_id, "left_semi").drop(row_id), row_id, keys, start=after)
        parts = [rows.join(known, keys, "left_semi"), absent.join(taken, row_id, "left_anti"), moved]
        rows = reduce(DataFrame.unionByName, parts).select(*rows.columns)
    if name in KEEP_EXISTING:
        publish(insert_missing(old, rows, keys), path)
        return
    publish(upsert(old, rows, keys, [c for c in rows.columns if c not in keys and c != row_id]), path)


def with_stored_ids(spark: SparkSession, fresh: dict[str, DataFrame], path: str, name: str) -> DataFrame:
    """Generated rows whose references are the ids under which the stored tables know their parents."""
    rows = fresh[name]
    for child, column, parent, parent_id in schemas.REFERENCES:
        if child != name or parent not in NATURAL_KEYS:
            continue
        keys = NATURAL_KEYS[parent]
        made = with_stored_ids(spark, fresh, path, parent).select(F.col(parent_id).alias(column), *keys)
        stored = read_version(spark, f"{path}/{parent}").select(F.col(parent_id).alias("_stored"), *keys)
        ids = made.join(stored, keys).select(column, "_stored")
        rows = rows.join(ids, column).withColumn(column, F.col("_stored")).select(*fresh[name].columns)
    return rows


def run_seed_steps(
    spark: SparkSession, path: str, n: int, environment: str, as_of: object, upto: int = 5
) -> list[int]:
    """Run the seed steps that the history does not list yet; returns those run.

    Production is never seeded. A step is recorded after its tables are published.
    """
    if environment.lower() == "prod":
        return []
    history_path = f"{path}/seed_history"
    history = read_if_there(spark, history_path, SEED_HISTORY)
    done = {row.seed_version for row in history.select("seed_version").collect()} if history is not None else set()
    ran = []
    for version, written in SEED_STEPS.items():
        if version > upto or version in done:
            continue
        fresh = generate(spark, n, as_of)
        for name, keys in written.items():
            if name == "inventory_movements":
                rows = movements({t: read_version(spark, f"{path}/{t}") for t in MOVEMENT_SOURCES})
            else:
                rows = with_stored_ids(spark, fresh, path, name)
            merge_table(spark, rows, f"{path}/{name}", name, keys)
        entry = spark.range(1).select(
            F.lit(version).cast("int").alias("seed_version"),
            F.lit(n).cast("int").alias("seed_count"),
            F.lit(environment).alias("app_env"),
            instant(as_of).alias("applied_at"),
        )
        entry.coalesce(1).write.mode("append").parquet(history_path)
        ran.append(version)
    return ran
