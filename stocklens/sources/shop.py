"""Shop tables derived from a star schema of orders, line items, parts and events.

Used to run the plans on the given Parquet tables. Amounts arrive as doubles
and become decimals before anything is summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions.changes import to_messages
from stocklens.operators.ordered import assign_ids
from stocklens.sources.changes import stream_parquet

# Six order states for five event types: 'signup' covers two, by event id.
STATUS_OF_EVENT = {"view": "picking", "purchase": "shipped", "click": "confirmed", "error": "cancelled"}
PROFILE_OF_EVENT = {
    "view": "oltp_read",
    "purchase": "oltp_insert",
    "click": "oltp_update",
    "error": "log_insert",
    "signup": "olap_revenue",
}


# Columns of the given tables that the mapping reads.
GIVEN = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{folder}/{name}.parquet")


def mapped(column: str, pairs: dict[str, str], other: Column | None = None) -> Column:
    result: Column | None = None
    for value, target in pairs.items():
        test = F.col(column) == value
        result = F.when(test, target) if result is None else result.when(test, target)
    return result if other is None else result.otherwise(other)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("decimal(14,2)").alias("balance"),
    )


def warehouses(spark: SparkSession, folder: str) -> DataFrame:
    supplier, nation = base(spark, folder, "supplier"), base(spark, folder, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("warehouse_id"),
        F.col("s_name").alias("warehouse_name"),
        F.col("n_name").alias("city"),
    )


def product_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand_name"),
        F.col("p_type").alias("category_name"),
    )


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "new")
    return base(spark, folder, "orders").select(
        F.col("o_orderkey").alias("customer_order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("Dock "), F.col("o_orderpriority")).alias("delivery_address"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        status.otherwise("picking").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("smallint").alias("delivery_priority"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("total_amount"),
        F.lit(None).cast("int").alias("items_count"),
        F.lit(None).cast("timestamp").alias("last_status_changed_at"),
    )


def customer_order_items(spark: SparkSession, folder: str) -> DataFrame:
    # The line items have no key; this number orders the lines of one order.
    line_id = (
        F.col("l_linenumber") * F.lit(1_000_000_000_000)
        + F.col("l_partkey") * F.lit(100)
        + F.col("l_quantity").cast("bigint")
    )
    return base(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("customer_order_id"),
        line_id.alias("customer_order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("decimal(14,3)").alias("ordered_quantity"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("sale_price"),
    )


def inventory_movements(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        F.when(F.col("l_returnflag") == "A", "receipt")
        .when(F.col("l_returnflag") == "N", "shipment")
        .when(F.col("l_linestatus") == "F", "write_off")
        .otherwise("adjustment")
    )
    return base(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("warehouse_id"),
        kind.alias("movement_type"),
        F.col("l_quantity").cast("decimal(14,3)").alias("quantity"),
        F.col("l_shipdate").cast("timestamp").alias("moved_at"),
    )


def audit_notes(spark: SparkSession, folder: str) -> DataFrame:
    # Errors pile up on few orders, the other events spread three to an order.
    order = F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(F.expr("event_id div 3 * 4"))
    return base(spark, folder, "events").select(
        F.col("event_id").alias("audit_note_id"),
        order.alias("customer_order_id"),
        F.col("event_type").alias("note_type"),
        F.col("props").alias("note_text"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        mapped("event_type", PROFILE_OF_EVENT).alias("profile"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("value") > 300, 500).otherwise(200).alias("status"),
        (F.col("value") > 300).alias("failed"),
    )


class ShopTables(dict):
    """The derived tables by name; each is set up when it is first asked for."""

    BUILDERS = {
        "customers": customers,
        "warehouses": warehouses,
        "product_catalog": product_catalog,
        "customer_orders": customer_orders,
        "customer_order_items": customer_order_items,
        "inventory_movements": inventory_movements,
        "customer_order_audit_notes": audit_notes,
        "requests": requests,
        "status_commands": lambda spark, folder: status_commands(base(spark, folder, "events")),
        "samples": lambda spark, folder: samples(base(spark, folder, "events")),
    }

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __contains__(self, name) -> bool:
        return name in self.BUILDERS

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.BUILDERS[name](self.spark, self.folder)
        return self[name]


def shop_tables(spark: SparkSession, folder: str) -> ShopTables:
    return ShopTables(spark, folder)


def status_commands(events: DataFrame) -> DataFrame:
    """Status commands, some with an unknown status and some for unknown orders."""
    other = F.when(F.expr("event_id % 2 = 0"), "delivered").otherwise("lost")
    return events.select(
        F.expr("user_id * 7 + event_id % 5 - 2").alias("customer_order_id"),
        mapped("event_type", STATUS_OF_EVENT, other).alias("status"),
        F.col("event_id").alias("seq"),
    )


def samples(events: DataFrame) -> DataFrame:
    """Metric samples: two counters and a gauge per database, one row per event."""
    metric = (
        F.when(F.col("event_type").isin("view", "click"), "pg_stat_database_blks_hit")
        .when(F.col("event_type") == "error", "pg_stat_database_blks_read")
        .when(F.col("event_type") == "purchase", "pg_stat_database_xact_commit")
        .otherwise("pg_stat_activity_count")
    )
    state = F.when(F.col("event_type") == "view", "idle").otherwise("active")
    return events.select(
        metric.alias("metric"),
        F.create_map(
            F.lit("datname"),
            F.concat(F.lit("db"), (F.col("user_id") % 7).cast("string")),
            F.lit("instance"),
            F.concat(F.lit("node"), F.col("user_id").cast("string")),
            F.lit("state"),
            F.when(F.col("event_type") == "signup", F.expr("CASE WHEN event_id % 3 = 0 THEN 'idle' ELSE 'active' END"))
            .otherwise(state),
        ).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value")).cast("double").alias("value"),
    )


def transaction_samples(events: DataFrame) -> DataFrame:
    """Commit and rollback counters of three databases and two templates on two nodes."""
    name = F.expr("CASE user_id % 5 WHEN 3 THEN 'template0' WHEN 4 THEN 'template1' ELSE 'db' || user_id % 5 END")
    rolled_back = "CASE WHEN event_id % 3 = 0 THEN 'pg_stat_database_xact_rollback' ELSE 'pg_stat_database_xact_commit' END"
    node = F.expr("'node' || user_id % 2")
    return events.select(
        F.expr(rolled_back).alias("metric"),
        F.create_map(F.lit("datname"), name, F.lit("instance"), node).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").cast("double").alias("value"),
    )


# Gauges of the overview reports in the order in which the events take them; the job and the backend of those that have one.
OVERVIEW_GAUGES = [
    ("pg_up", "", ""),
    ("pg_database_size_bytes", "", ""),
    ("pg_stat_database_numbackends", "", ""),
    ("up", "minio", ""),
    ("up", "backup_exporter", ""),
    ("up", "etcd", ""),
    ("minio_cluster_capacity_usable_free_bytes", "", ""),
    ("backup_last_size_bytes", "", ""),
    ("patroni_primary", "", ""),
    ("patroni_replica", "", ""),
    ("etcd_server_has_leader", "", ""),
    ("haproxy_server_up", "", "patroni_primary"),
    ("haproxy_server_up", "", "patroni_replica"),
    ("pg_replication_lag_seconds", "", ""),
]


def overview_samples(events: DataFrame) -> DataFrame:
    """Samples of the gauges above on three nodes, of databases and templates for those about databases."""
    gauges = F.array(*[F.struct(*[F.lit(text) for text in gauge]) for gauge in OVERVIEW_GAUGES])
    gauge = F.get(gauges, F.expr(f"event_id % {len(OVERVIEW_GAUGES)}"))
    rows = events.withColumn("gauge", gauge)
    metric, job, backend = (F.col("gauge")[f"col{i}"] for i in (1, 2, 3))
    name = F.expr("CASE user_id % 4 WHEN 3 THEN 'template1' ELSE 'db' || user_id % 4 END")
    of_database = metric.isin("pg_database_size_bytes", "pg_stat_database_numbackends")
    labels = {"datname": F.when(of_database, name).otherwise(""), "instance": F.expr("'node' || user_id % 3"), "job": job, "backend": backend}
    state = F.when(F.col("value") > 50, 1.0).otherwise(0.0)
    amount = metric.isin("pg_database_size_bytes", "pg_stat_database_numbackends", "backup_last_size_bytes",
                         "minio_cluster_capacity_usable_free_bytes", "pg_replication_lag_seconds")
    return rows.select(
        metric.alias("metric"),
        F.create_map(*[c for key, value in labels.items() for c in (F.lit(key), value)]).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(amount, F.floor("value").cast("double")).otherwise(state).alias("value"),
    )


def movement_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Shipped and received lines with their headers and the order lines they fulfil.

    Lines that came back are receipts of a supplier's order, all others shipments of a customer's.
    """
    orders = base(spark, folder, "orders")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = assign_ids(base(spark, folder, "lineitem").select(*order, "l_returnflag", "l_quantity"), "n", order)
    number = F.col("n")
    came_back = F.col("l_returnflag") == "R"
    amount = F.col("l_quantity").cast("decimal(14,3)")
    at = F.col("o_orderdate").cast("timestamp")

    def header(key: str, at_name: str, by_name: str, of: str) -> DataFrame:
        return orders.select(
            F.col("o_orderkey").alias(key),
            F.col("o_orderkey").alias(of),
            (F.col("o_custkey") % 10 + 1).alias("warehouse_id"),
            (F.col("o_custkey") % 7 + 1).alias(by_name),
            at.alias(at_name),
            F.lit("delivered").alias("status"),
        )

    def line(key: str, header_key: str, item_key: str, amount_name: str, kept: Column) -> DataFrame:
        return lines.where(kept).select(
            number.alias(key), F.col("l_orderkey").alias(header_key), number.alias(item_key), amount.alias(amount_name)
        )

    def item(key: str) -> DataFrame:
        return lines.select(number.alias(key), F.col("l_partkey").alias("product_id"))

    return {
        "shipments": header("shipment_id", "shipped_at", "shipped_by_employee_id", "customer_order_id"),
        "shipment_items": line(
            "shipment_item_id", "shipment_id", "customer_order_item_id", "shipped_quantity", ~came_back
        ),
        "customer_order_items": item("customer_order_item_id"),
        "goods_receipts": header("goods_receipt_id", "received_at", "accepted_by_employee_id", "supplier_order_id"),
        "goods_receipt_items": line(
            "goods_receipt_item_id", "goods_receipt_id", "supplier_order_item_id", "received_quantity", came_back
        ),
        "supplier_order_items": item("supplier_order_item_id"),
    }


def movement_versions(events: DataFrame) -> DataFrame:
    """Stock movement versions: each user has four movement ids that are written again and again."""
    kind = mapped(
        "event_type", {"view": "receipt", "purchase": "shipment", "click": "write_off"}, F.lit("adjustment")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        F.expr("user_id * 4 + event_id % 4 + 1").alias("inventory_movement_id"),
        F.expr("event_id div 2").alias("product_id"),
        F.col("user_id").alias("warehouse_id"),
        kind.alias("movement_type"),
        F.col("value").cast("decimal(14,3)").alias("quantity"),
        F.col("ts").cast("timestamp").alias("moved_at"),
        (F.col("user_id") + 1).alias("employee_id"),
        F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u").alias(
            "cdc_op"
        ),
    )


def change_table(spark: SparkSession, folder: str) -> DataFrame:
    """The versions as a typed table, as the loading job leaves them."""
    return movement_versions(base(spark, folder, "events")).select(
        "*",
        F.col("seq").alias("cdc_source_ts_ms"),
        F.col("seq").alias("version"),
        (F.col("cdc_op") == "d").cast("int").alias("is_deleted"),
    ).withColumn("moved_at", F.date_trunc("millisecond", "moved_at"))


def movement_changes(events: DataFrame) -> DataFrame:
    """The versions as flat change messages carry them: amounts and times as text."""
    return (
        movement_versions(events)
        .withColumn("quantity", F.col("quantity").cast("string"))
        .withColumn("moved_at", F.date_format("moved_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .withColumnRenamed("cdc_op", "__op")
        .withColumns(
            {
                "__table": F.lit("inventory_movements"),
                "__source_ts_ms": F.col("seq"),
                "__deleted": F.when(F.col("__op") == "d", "true").otherwise("false"),
            }
        )
    )


def change_messages(spark: SparkSession, folder: str) -> DataFrame:
    return to_messages(movement_changes(base(spark, folder, "events")), keep=["seq"])


def change_message_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = base(spark, folder, "events").schema
    return to_messages(movement_changes(stream_parquet(spark, folder, "events.parquet", schema)), keep=["seq"])


def status_command_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = base(spark, folder, "events").schema
    return status_commands(stream_parquet(spark, folder, "events.parquet", schema))


# Deliveries of the change scenario; messages of one source time are spread over them, so many come late.
DELIVERIES = 4


def delivered_messages(events: DataFrame) -> DataFrame:
    """Change messages as a bad link brings them: ``delivery``, ``key``, ``seq``, ``value``.

    The deliveries do not follow the source time. Some messages come a second
    time in the last one; some are no JSON, some have no key or none that can be read.
    """
    rows = to_messages(movement_changes(events).withColumn("key", F.col("inventory_movement_id")), keep=["seq", "key"])
    spoilt = (
        F.when(F.expr("seq % 50 = 7"), F.concat(F.lit("no message "), F.col("seq")))
        .when(F.expr("seq % 50 = 8"), F.concat(F.lit('{"__op": "u", "__source_ts_ms": '), F.col("seq"), F.lit("}")))
        .when(F.expr("seq % 50 = 9"), F.concat(F.lit('{"inventory_movement_id": "x'), F.col("seq"), F.lit('"}')))
        .otherwise(F.col("value"))
    )
    first = rows.select(F.expr("seq % 4").cast("int").alias("delivery"), "key", "seq", spoilt.alias("value"))
    again = first.where("seq % 10 = 3").withColumn("delivery", F.lit(DELIVERIES))
    return first.unionByName(again)


def deliver(messages: DataFrame, number: int, path: str) -> None:
    """One delivery as text files; a key's messages are in one file, by ``seq``."""
    part = messages.where(F.col("delivery") == number).repartition("key").sortWithinPartitions("key", "seq")
    part.select("value").write.text(f"{path}/{number}")
