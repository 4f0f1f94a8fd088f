"""Table schemas with their keys, references and value domains."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Enum members.
SUPPLIER_ORDER_STATUSES = ["draft", "placed", "partially_received", "received", "cancelled"]
ORDER_STATUSES = ["new", "confirmed", "picking", "shipped", "delivered", "cancelled"]
SHIPMENT_STATUSES = ["created", "dispatched", "delivered", "cancelled"]
MOVEMENT_TYPES = ["receipt", "shipment", "write_off", "adjustment"]

QUANTITY = "DECIMAL(14,3)"
MONEY = "DECIMAL(14,2)"

TABLES: dict[str, str] = {
    "customers": "customer_id BIGINT NOT NULL, full_name STRING NOT NULL, email STRING NOT NULL, "
    "phone STRING, created_at TIMESTAMP NOT NULL",
    "employees": "employee_id BIGINT NOT NULL, full_name STRING NOT NULL, email STRING NOT NULL, "
    "position_name STRING NOT NULL, hired_at DATE NOT NULL",
    "suppliers": "supplier_id BIGINT NOT NULL, supplier_name STRING NOT NULL, email STRING, phone STRING",
    "warehouses": "warehouse_id BIGINT NOT NULL, warehouse_name STRING NOT NULL, city STRING NOT NULL",
    "product_categories": "category_id BIGINT NOT NULL, category_name STRING NOT NULL",
    "brands": "brand_id BIGINT NOT NULL, brand_name STRING NOT NULL",
    "products": "product_id BIGINT NOT NULL, category_id BIGINT NOT NULL, brand_id BIGINT NOT NULL, "
    "product_name STRING NOT NULL, unit_of_measure STRING NOT NULL",
    "supplier_orders": "supplier_order_id BIGINT NOT NULL, supplier_id BIGINT NOT NULL, "
    "created_by_employee_id BIGINT NOT NULL, order_date DATE NOT NULL, status STRING NOT NULL",
    "supplier_order_items": "supplier_order_item_id BIGINT NOT NULL, supplier_order_id BIGINT NOT NULL, "
    f"product_id BIGINT NOT NULL, ordered_quantity {QUANTITY} NOT NULL, unit_price {MONEY} NOT NULL",
    "goods_receipts": "goods_receipt_id BIGINT NOT NULL, supplier_order_id BIGINT NOT NULL, "
    "warehouse_id BIGINT NOT NULL, accepted_by_employee_id BIGINT NOT NULL, received_at TIMESTAMP NOT NULL",
    "goods_receipt_items": "goods_receipt_item_id BIGINT NOT NULL, goods_receipt_id BIGINT NOT NULL, "
    f"supplier_order_item_id BIGINT NOT NULL, received_quantity {QUANTITY} NOT NULL, "
    f"unit_cost {MONEY} NOT NULL, expiration_date DATE",
    "customer_orders": "customer_order_id BIGINT NOT NULL, customer_id BIGINT NOT NULL, "
    "delivery_address STRING NOT NULL, created_at TIMESTAMP NOT NULL, status STRING NOT NULL, "
    "delivery_window_start TIMESTAMP, delivery_window_end TIMESTAMP, delivery_priority SMALLINT, "
    f"total_amount {MONEY}, items_count INT, last_status_changed_at TIMESTAMP",
    "customer_order_items": "customer_order_item_id BIGINT NOT NULL, customer_order_id BIGINT NOT NULL, "
    f"product_id BIGINT NOT NULL, ordered_quantity {QUANTITY} NOT NULL, sale_price {MONEY} NOT NULL",
    "shipments": "shipment_id BIGINT NOT NULL, customer_order_id BIGINT NOT NULL, warehouse_id BIGINT NOT NULL, "
    "shipped_by_employee_id BIGINT NOT NULL, shipped_at TIMESTAMP NOT NULL, status STRING NOT NULL",
    "shipment_items": "shipment_item_id BIGINT NOT NULL, shipment_id BIGINT NOT NULL, "
    f"customer_order_item_id BIGINT NOT NULL, shipped_quantity {QUANTITY} NOT NULL",
    "inventory_movements": "inventory_movement_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
    f"warehouse_id BIGINT NOT NULL, movement_type STRING NOT NULL, quantity {QUANTITY} NOT NULL, "
    "moved_at TIMESTAMP NOT NULL, employee_id BIGINT NOT NULL",
    "order_status_events": "order_status_event_id BIGINT NOT NULL, customer_order_id BIGINT NOT NULL, "
    "old_status STRING, new_status STRING NOT NULL, event_source STRING NOT NULL, created_at TIMESTAMP NOT NULL",
    "customer_order_audit_notes": "audit_note_id BIGINT NOT NULL, customer_order_id BIGINT NOT NULL, "
    "note_type STRING NOT NULL, note_text STRING NOT NULL, created_at TIMESTAMP NOT NULL",
}

# Inputs that are not tables of the shop: metric samples, request log, statement statistics.
SAMPLES = "metric STRING, labels MAP<STRING, STRING>, ts TIMESTAMP, value DOUBLE"
REQUESTS = "ts TIMESTAMP, profile STRING, duration_ms DOUBLE, status INT, failed BOOLEAN"
STATEMENTS = "query STRING, mean_exec_time DOUBLE, calls BIGINT, shared_blks_hit BIGINT, shared_blks_read BIGINT"
SEED_HISTORY = "seed_version INT, seed_count INT, app_env STRING, applied_at TIMESTAMP"
REVENUE_MV = (
    "sales_day DATE, category_name STRING, order_count BIGINT, revenue DECIMAL(18,2), audit_note_count BIGINT"
)

# Primary and unique keys.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "customers": [["customer_id"], ["email"]],
    "employees": [["employee_id"], ["email"]],
    "suppliers": [["supplier_id"], ["supplier_name"]],
    "warehouses": [["warehouse_id"], ["warehouse_name"]],
    "product_categories": [["category_id"], ["category_name"]],
    "brands": [["brand_id"], ["brand_name"]],
    "products": [["product_id"], ["brand_id", "product_name"]],
    "supplier_orders": [["supplier_order_id"]],
    "supplier_order_items": [["supplier_order_item_id"], ["supplier_order_id", "product_id"]],
    "goods_receipts": [["goods_receipt_id"]],
    "goods_receipt_items": [["goods_receipt_item_id"], ["goods_receipt_id", "supplier_order_item_id"]],
    "customer_orders": [["customer_order_id"]],
    "customer_order_items": [["customer_order_item_id"], ["customer_order_id", "product_id"]],
    "shipments": [["shipment_id"]],
    "shipment_items": [["shipment_item_id"], ["shipment_id", "customer_order_item_id"]],
    "inventory_movements": [["inventory_movement_id"]],
    "order_status_events": [["order_status_event_id"]],
    "customer_order_audit_notes": [["audit_note_id"]],
}

# (child table, child column, parent table, parent column).
REFERENCES: list[tuple[str, str, str, str]] = [
    ("products", "category_id", "product_categories", "category_id"),
    ("products", "brand_id", "brands", "brand_id"),
    ("supplier_orders", "supplier_id", "suppliers", "supplier_id"),
    ("supplier_orders", "created_by_employee_id", "employees", "employee_id"),
    ("supplier_order_items", "supplier_order_id", "supplier_orders", "supplier_order_id"),
    ("supplier_order_items", "product_id", "products", "product_id"),
    ("goods_receipts", "supplier_order_id", "supplier_orders", "supplier_order_id"),
    ("goods_receipts", "warehouse_id", "warehouses", "warehouse_id"),
    ("goods_receipts", "accepted_by_employee_id", "employees", "employee_id"),
    ("goods_receipt_items", "goods_receipt_id", "goods_receipts", "goods_receipt_id"),
    ("goods_receipt_items", "supplier_order_item_id", "supplier_order_items", "supplier_order_item_id"),
    ("customer_orders", "customer_id", "customers", "customer_id"),
    ("customer_order_items", "customer_order_id", "customer_orders", "customer_order_id"),
    ("customer_order_items", "product_id", "products", "product_id"),
    ("shipments", "customer_order_id", "customer_orders", "customer_order_id"),
    ("shipments", "warehouse_id", "warehouses", "warehouse_id"),
    ("shipments", "shipped_by_employee_id", "employees", "employee_id"),
    ("shipment_items", "shipment_id", "shipments", "shipment_id"),
    ("shipment_items", "customer_order_item_id", "customer_order_items", "customer_order_item_id"),
    ("inventory_movements", "product_id", "products", "product_id"),
    ("inventory_movements", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory_movements", "employee_id", "employees", "employee_id"),
    ("order_status_events", "customer_order_id", "customer_orders", "customer_order_id"),
    ("customer_order_audit_notes", "customer_order_id", "customer_orders", "customer_order_id"),
]

# (table, column) -> allowed values.
DOMAINS: dict[tuple[str, str], list[str]] = {
    ("supplier_orders", "status"): SUPPLIER_ORDER_STATUSES,
    ("customer_orders", "status"): ORDER_STATUSES,
    ("shipments", "status"): SHIPMENT_STATUSES,
    ("inventory_movements", "movement_type"): MOVEMENT_TYPES,
    ("order_status_events", "old_status"): ORDER_STATUSES,
    ("order_status_events", "new_status"): ORDER_STATUSES,
}


def schema(name: str) -> StructType:
    """The declared schema of a table."""
    return StructType.fromDDL(TABLES[name])


def required_columns(name: str) -> list[str]:
    return [field.name for field in schema(name).fields if not field.nullable]
