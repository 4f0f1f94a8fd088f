"""Every query on the given Parquet tables, by name.

Each entry takes a session and the folder of the tables and returns a
DataFrame over the whole tables. :mod:`stocklens.oracle` holds the same
queries as SQL text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, ShortType, TimestampType

from stocklens.functions.changes import flatten_envelope, parse_changes, to_messages, typed_changes
from stocklens.operators import quality
from stocklens.functions.scalars import days_before, instant, padded_phone
from stocklens.operators.latest import current_rows, latest_per_key
from stocklens.operators.merge import backfill_totals, delete_keys, evolve, insert_missing, upsert
from stocklens.operators.ordered import assign_by_bounds, assign_cyclic, assign_ids
from stocklens.operators.ranking import sample_rows, top_by
from stocklens.plans import dashboards, latency, metrics, orders, revenue
from stocklens.plans.documents import order_documents, order_responses
from stocklens.plans.generate import movements, probe_movement
from stocklens.plans.turnover import turnover
from stocklens.schemas import ORDER_STATUSES, schema
from stocklens.session import configure, fresh_dir
from stocklens.sinks.bucketed import upsert_into, write_bucketed
from stocklens.sinks.periods import PERIOD, period_of, read_periods, within, write_periods
from stocklens.sinks.versioned import append, export_csv
from stocklens.sources.changes import read_change_files, snapshot_as_changes
from stocklens.sources.shop import (
    DELIVERIES,
    base,
    change_message_stream,
    change_messages,
    change_table,
    deliver,
    delivered_messages,
    movement_changes,
    movement_sources,
    overview_samples,
    shop_tables,
    status_command_stream,
    transaction_samples,
)
from stocklens.sources.tables import load_requests, load_samples, load_statements, load_table
from stocklens.streaming import movements as movement_stream
from stocklens.streaming import status as status_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The orders and movements of the given tables lie between 1995 and 2001.
START = "1990-01-01T00:00:00Z"
END = "2100-01-01T00:00:00Z"
AS_OF = "2024-02-01T00:00:00Z"
SEED = 7
MOVES = "product_id BIGINT, warehouse_id BIGINT, movement_type STRING, quantity DECIMAL(14,3), moved_at TIMESTAMP"
# Bounds inside the data, one of them not at midnight.
ORDERS_FROM, ORDERS_TO = "1996-03-05T12:00:00Z", "1998-07-01T00:00:00Z"
EVENTS_FROM, EVENTS_TO = "2024-01-20T06:00:00Z", "2024-01-30T00:00:00Z"


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types every engine prints alike."""

    def convert(field):
        column = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return column.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])


def register(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(query(configure(spark), folder))

    QUERIES[query.__name__] = run
    return query


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- analytic reports ------------------------------------------------------


@register
def turnover_top_locations(spark, folder):
    return turnover(shop_tables(spark, folder), START, END)


@register
def turnover_all_locations(spark, folder):
    return turnover(shop_tables(spark, folder), START, END, top_locations=None)


@register
def turnover_best_sellers(spark, folder):
    """The ten locations with the greatest turnover, and of them products with much of it only."""
    return turnover(shop_tables(spark, folder), ORDERS_FROM, ORDERS_TO, top_locations=10, min_quantity=40)


@register
def revenue_between(spark, folder):
    return revenue.revenue_by_day(shop_tables(spark, folder), ORDERS_FROM, ORDERS_TO, limit=5000)


@register
def revenue_between_stored(spark, folder):
    path = fresh_dir(spark, "revenue")
    revenue.build_revenue_aggregate(shop_tables(spark, folder), path)
    return revenue.stored_revenue_by_day(spark, path, ORDERS_FROM, ORDERS_TO, limit=5000)


@register
def revenue_by_day(spark, folder):
    return revenue.revenue_by_day(shop_tables(spark, folder), START, END)


@register
def revenue_all_days(spark, folder):
    return revenue.revenue_by_day_and_category(shop_tables(spark, folder))


@register
def revenue_stored(spark, folder):
    path = fresh_dir(spark, "revenue")
    revenue.build_revenue_aggregate(shop_tables(spark, folder), path)
    return revenue.read_version(spark, path)


@register
def revenue_by_day_stored(spark, folder):
    tables = shop_tables(spark, folder)
    path = fresh_dir(spark, "revenue")
    revenue.build_revenue_aggregate(tables, path)
    return revenue.stored_revenue_by_day(spark, path, START, END)


def without_late_lines(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The order facts in two deliveries: the later lines of the orders of one spring come in the second one."""
    tables = shop_tables(spark, folder)
    spring = tables["customer_orders"].where("created_at >= '1997-03-01' AND created_at < '1997-06-01'")
    lines, late = tables["customer_order_items"], F.col("customer_order_item_id") >= 3 * 10**12
    second = lines.where(late).join(spring.select("customer_order_id"), "customer_order_id", "left_semi")
    first = lines.join(second.select("customer_order_id", "customer_order_item_id"), ["customer_order_id", "customer_order_item_id"], "left_anti")
    names = ["customer_orders", "customer_order_audit_notes"]
    none = {name: tables[name].where("false") for name in names}
    return {**{name: tables[name] for name in names}, "customer_order_items": first}, {**none, "customer_order_items": second}


@register
def revenue_from_periods(spark, folder):
    path = fresh_dir(spark, "facts")
    tables = shop_tables(spark, folder)
    revenue.add_facts(spark, path, tables, "month")
    catalog = tables["product_catalog"]
    return revenue.revenue_from_periods(spark, path, catalog, ORDERS_FROM, ORDERS_TO, "month", limit=5000)


@register
def revenue_after_refresh(spark, folder):
    """The daily aggregate, first of all lines but some, then refreshed for the months that the rest touches."""
    path, catalog = fresh_dir(spark, "facts"), shop_tables(spark, folder)["product_catalog"]
    for delivery in without_late_lines(spark, folder):
        months = revenue.add_facts(spark, path, delivery, "month")
        revenue.refresh_periods(spark, path, catalog, months, "month")
    return revenue.stored_daily(spark, path).drop("period")


@register
def turnover_from_periods(spark, folder):
    path = fresh_dir(spark, "moves")
    tables = shop_tables(spark, folder)
    moves = tables["inventory_movements"].withColumn(PERIOD, period_of(F.col("moved_at"), "month"))
    write_periods(moves, path, ["warehouse_id", "product_id"])
    stored = read_periods(spark, path, MOVES)
    bounded = {name: tables[name] for name in ("warehouses", "product_catalog")}
    bounded["inventory_movements"] = within(stored, ORDERS_FROM, ORDERS_TO, "month")
    return turnover(bounded, ORDERS_FROM, ORDERS_TO, top_locations=10, min_quantity=40)


@register
def order_document_lines(spark, folder):
    documents = order_documents(shop_tables(spark, folder))
    lines = documents.drop("part").select("*", F.inline("items")).drop("items")
    return lines.withColumn("items_count", F.coalesce("items_count", F.lit(0)))


@register
def order_document_totals(spark, folder):
    """Size and amount of each order's JSON document."""
    documents = order_responses(order_documents(shop_tables(spark, folder)))
    body = F.from_json("body", "order STRUCT<order_id: BIGINT, customer_name: STRING>, items ARRAY<STRUCT<sale_price: STRING>>")
    parsed = documents.select(body.alias("b"))
    total = F.aggregate(
        "b.items", F.lit(0).cast("decimal(24,2)"), lambda t, i: (t + i["sale_price"].cast("decimal(14,2)")).cast("decimal(24,2)")
    )
    parts = parsed.select(
        F.col("b.order.order_id").alias("order_id"),
        F.col("b.order.customer_name").alias("customer_name"),
        F.size("b.items").alias("line_count"),
        total.alias("price_sum"),
    )
    return parts.groupBy("order_id", "customer_name").agg(
        F.sum("line_count").alias("line_count"), F.sum("price_sum").alias("price_sum")
    )


@register
def order_document_parts(spark, folder):
    """Parts of three lines at most: their sizes and first lines."""
    documents = order_documents(shop_tables(spark, folder), lines_per_part=3)
    first = F.element_at("items", 1)["customer_order_item_id"]
    return documents.select("customer_order_id", "part", F.size("items").alias("line_count"), first.alias("first_line"))


@register
def order_documents_by_id(spark, folder):
    """The documents of a list of orders."""
    tables = shop_tables(spark, folder)
    ids = base(spark, folder, "customer").select((F.col("c_custkey") * 3).alias("customer_order_id"))
    documents = order_documents(tables, ids)
    return documents.select("customer_order_id", "full_name", "audit_note_count", F.size("items").alias("line_count"))


# --- change stream and dashboards -----------------------------------------


def current(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(change_table(spark, folder))


@register
def current_movements(spark, folder):
    return current_rows(parse_changes(change_messages(spark, folder), ingest_ms=0))


@register
def current_from_envelopes(spark, folder):
    rows = movement_changes(base(spark, folder, "events"))
    fields = [c for c in rows.columns if c != "seq" and not c.startswith("__")]
    gone = F.col("__op") == "d"
    row = F.struct(*fields)
    envelopes = rows.select(
        "seq",
        F.to_json(
            F.struct(
                F.when(gone, row).alias("before"),
                F.when(~gone, row).alias("after"),
                F.struct(F.lit("inventory_movements").alias("table"), F.col("__source_ts_ms").alias("ts_ms")).alias(
                    "source"
                ),
                F.col("__op").alias("op"),
            )
        ).alias("value"),
    )
    schema = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.select(*fields).schema.fields)
    flat = flatten_envelope(envelopes, schema, table="inventory_movements")
    return current_rows(typed_changes(flat, ingest_ms=0))


@register
def snapshot_then_changes(spark, folder):
    snapshot = base(spark, folder, "orders").select(
        F.lit(-1).cast("bigint").alias("seq"),
        (F.col("o_orderkey") + 1).alias("inventory_movement_id"),
        F.col("o_orderkey").alias("product_id"),
        F.col("o_custkey").alias("warehouse_id"),
        F.lit("receipt").alias("movement_type"),
        F.col("o_totalprice").cast("decimal(14,3)").cast("string").alias("quantity"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("moved_at"),
        F.lit(1).cast("bigint").alias("employee_id"),
    )
    first = snapshot_as_changes(snapshot, source_ts_ms=0)
    both = to_messages(first, keep=["seq"]).unionByName(change_messages(spark, folder))
    return current_rows(parse_changes(both, ingest_ms=0))


def loaded_stream(spark: SparkSession, folder: str) -> str:
    path = fresh_dir(spark, "movements")
    load = movement_stream.load_changes(
        change_message_stream(spark, folder), path, f"{path}/checkpoint", ingest_ms=0
    )
    load.awaitTermination()
    return path


@register
def stream_current_movements(spark, folder):
    return movement_stream.read_current(spark, loaded_stream(spark, folder))


@register
def compacted_current_movements(spark, folder):
    path = loaded_stream(spark, folder)
    movement_stream.compact(spark, path)
    return movement_stream.read_current(spark, path)


def delivered(spark: SparkSession, folder: str) -> str:
    """The change scenario: a stream that is started anew after each delivery and goes on where it was.

    Half of the versions are raised to one ingest time.
    """
    path = fresh_dir(spark, "scenario")
    events = base(spark, folder, "events")
    ingest_ms = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    for number in range(DELIVERIES + 1):
        deliver(delivered_messages(events), number, f"{path}/in")
        stream = read_change_files(spark, f"{path}/in/*")
        movement_stream.load_changes(stream, path, f"{path}/checkpoint", ingest_ms).awaitTermination()
    return path


@register
def delivered_current_movements(spark, folder):
    return movement_stream.read_current(spark, delivered(spark, folder))


@register
def delivered_rejects(spark, folder):
    return movement_stream.read_rejected(spark, delivered(spark, folder)).groupBy("value").agg(
        F.count(F.lit(1)).alias("times")
    )


@register
def kpi_total_quantity(spark, folder):
    return dashboards.total_quantity(current(spark, folder), START, END)


@register
def daily_by_type(spark, folder):
    return dashboards.daily_by_type(current(spark, folder), START, END)


@register
def top_locations(spark, folder):
    return dashboards.top_locations(current(spark, folder), START, END)


@register
def kpi_total_quantity_between(spark, folder):
    return dashboards.total_quantity(current(spark, folder), EVENTS_FROM, EVENTS_TO)


@register
def daily_by_type_between(spark, folder):
    return dashboards.daily_by_type(current(spark, folder), EVENTS_FROM, EVENTS_TO)


@register
def top_locations_between(spark, folder):
    return dashboards.top_locations(current(spark, folder), EVENTS_FROM, EVENTS_TO, 5)


@register
def daily_by_type_unbounded(spark, folder):
    return dashboards.daily_by_type(current(spark, folder))


@register
def top_locations_unbounded(spark, folder):
    return dashboards.top_locations(current(spark, folder))


@register
def type_share(spark, folder):
    return rounded(dashboards.type_share(current(spark, folder)), "share", digits=9)


@register
def kpi_total_quantity_unbounded(spark, folder):
    return dashboards.total_quantity(current(spark, folder))


@register
def movements_by_id(spark, folder):
    ids = base(spark, folder, "customer").select((F.col("c_custkey") + 1).alias("inventory_movement_id"))
    return dashboards.movement_by_id(current(spark, folder), ids)


# --- merges and ids ---------------------------------------------------------


def newcomers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows keyed like customers: some keys exist there, most do not."""
    return base(spark, folder, "orders").select(
        F.col("o_orderkey").alias("customer_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("full_name"),
        F.col("o_orderpriority").alias("segment"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("balance"),
    )


@register
def upsert_customers(spark, folder):
    customers = shop_tables(spark, folder)["customers"]
    return upsert(customers, newcomers(spark, folder), ["customer_id"], ["balance"])


@register
def upsert_customers_bucketed(spark, folder):
    """The merge into a table of eight buckets, read from the table it leaves."""
    name = write_bucketed(shop_tables(spark, folder)["customers"], ["customer_id"], 8)
    return spark.table(upsert_into(spark, name, newcomers(spark, folder), ["balance"]))


@register
def backfill_order_totals_bucketed(spark, folder):
    tables = shop_tables(spark, folder)
    stored = [
        spark.table(write_bucketed(tables[name], ["customer_order_id"], 8))
        for name in ("customer_orders", "customer_order_items")
    ]
    return backfill_totals(*stored)


@register
def insert_missing_customers(spark, folder):
    return insert_missing(shop_tables(spark, folder)["customers"], newcomers(spark, folder), ["customer_id"])


@register
def delete_ordering_customers(spark, folder):
    tables = shop_tables(spark, folder)
    urgent = tables["customer_orders"].where("delivery_priority = 1")
    return delete_keys(tables["customers"], urgent, ["customer_id"])


@register
def backfill_order_totals(spark, folder):
    tables = shop_tables(spark, folder)
    return backfill_totals(tables["customer_orders"], tables["customer_order_items"])


@register
def numbered_notes(spark, folder):
    notes = shop_tables(spark, folder)["customer_order_audit_notes"]
    rows = notes.select("audit_note_id", "created_at")
    return assign_ids(rows, "note_number", ["created_at", "audit_note_id"], start=1001)


@register
def cyclic_locations(spark, folder):
    tables = shop_tables(spark, folder)
    numbered = tables["customer_orders"].select("customer_order_id", (F.col("customer_order_id") + 1).alias("n"))
    return assign_cyclic(numbered, "n", tables["warehouses"], "warehouse_id", "warehouse_id")


@register
def bounded_customers(spark, folder):
    tables = shop_tables(spark, folder)
    numbered = tables["customer_orders"].select("customer_order_id", (F.col("customer_order_id") + 1).alias("n"))
    return assign_by_bounds(numbered, "n", tables["customers"], "customer_id", "customer_id")


# --- order jobs -------------------------------------------------------------


def created(spark: SparkSession, folder: str) -> orders.CreatedOrders:
    tables = shop_tables(spark, folder)
    requests = base(spark, folder, "events").select((F.col("event_id") + 1).alias("request_id"))
    return orders.create_orders(
        requests, tables["customers"], tables["product_catalog"], AS_OF, SEED, next_ids=(500_001, 700_001, 900_001)
    )


@register
def created_orders(spark, folder):
    return created(spark, folder).orders


@register
def created_order_items(spark, folder):
    return created(spark, folder).items


@register
def created_order_notes(spark, folder):
    return created(spark, folder).notes


@register
def order_creation_results(spark, folder):
    return orders.creation_results(created(spark, folder))


def changed(spark: SparkSession, folder: str) -> orders.StatusChanges:
    tables = shop_tables(spark, folder)
    return orders.apply_status_changes(tables["customer_orders"], tables["status_commands"], AS_OF)


def order_state(df: DataFrame) -> DataFrame:
    changed_at = F.coalesce("last_status_changed_at", "created_at").alias("last_status_changed_at")
    return df.select("customer_order_id", "customer_id", "status", changed_at)


@register
def status_changes_orders(spark, folder):
    return order_state(changed(spark, folder).orders)


@register
def status_changes_events(spark, folder):
    return changed(spark, folder).events


@register
def status_changes_notes(spark, folder):
    return changed(spark, folder).notes


@register
def status_change_results(spark, folder):
    return changed(spark, folder).results


@register
def drawn_log_orders(spark, folder):
    tables = shop_tables(spark, folder)
    requests = tables["status_commands"].select("seq", "status")
    return orders.drawn_orders(requests, tables["customer_orders"], SEED)


@register
def logged_status_events(spark, folder):
    tables = shop_tables(spark, folder)
    return orders.log_status_events(tables["customer_orders"], tables["status_commands"], AS_OF)


def status_run(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    stored = shop_tables(spark, folder)["customer_orders"]
    path = fresh_dir(spark, "status")
    commands = status_command_stream(spark, folder)
    status_stream.run_status_stream(commands, path, f"{path}/checkpoint", AS_OF).awaitTermination()
    return stored, path


@register
def stream_status_orders(spark, folder):
    stored, path = status_run(spark, folder)
    return order_state(status_stream.current_orders(stored, path))


@register
def stream_status_events(spark, folder):
    return status_stream.read_events(*status_run(spark, folder)).drop("order_status_event_id")


@register
def combined_movements(spark, folder):
    """Shipment movements, and the receipt movements that take over some of their ids."""
    return movements(movement_sources(spark, folder))


@register
def combined_movements_apart(spark, folder):
    return movements(movement_sources(spark, folder), non_overlapping_ids=True)


# --- stored tables ------------------------------------------------------------


@register
def orders_of_two_schemas(spark, folder):
    """Orders appended first without, then with the columns that were added later, read with the declared schema."""
    path = fresh_dir(spark, "orders")
    stored = shop_tables(spark, folder)["customer_orders"]
    early = F.col("customer_order_id") % 3 == 0
    first = stored.where(early).select("customer_order_id", "customer_id", "delivery_address", "created_at", "status")
    append(first, path)
    append(evolve(stored.where(~early), schema("customer_orders")), path)
    columns = ["customer_order_id", "status", "delivery_window_start", "delivery_priority", "total_amount"]
    return load_table(spark, "customer_orders", path).select(*columns)


@register
def stored_requests(spark, folder):
    """The request log through JSON files: requests and failures per profile and status."""
    path = fresh_dir(spark, "requests")
    shop_tables(spark, folder)["requests"].write.json(path)
    log = load_requests(spark, path, "json")
    return log.groupBy("profile", "status").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("failed").alias("failures"),
        F.min("ts").alias("first_at"),
        F.max("duration_ms").alias("longest_ms"),
    )


@register
def stored_samples(spark, folder):
    """Metric samples through Parquet files with their label maps: samples and greatest value per series."""
    path = fresh_dir(spark, "samples")
    shop_tables(spark, folder)["samples"].write.parquet(path)
    flat = flat_labels(load_samples(spark, path), "datname", "instance", "state")
    return flat.groupBy("metric", "datname", "instance", "state").agg(
        F.count(F.lit(1)).alias("samples"), F.max("value").alias("greatest")
    )


@register
def revenue_rebuilt(spark, folder):
    """The stored aggregate, built of half the lines, after a refresh; where none was built there is nothing to refresh."""
    tables, path = shop_tables(spark, folder), fresh_dir(spark, "revenue")
    half = tables["customer_order_items"].where("product_id % 2 = 0")
    names = ["customer_orders", "product_catalog", "customer_order_audit_notes"]
    revenue.build_revenue_aggregate({**{n: tables[n] for n in names}, "customer_order_items": half}, path)
    for target in (path, f"{path}-never-built"):
        revenue.refresh_revenue_aggregate(spark, tables, target)
    return revenue.read_version(spark, path)


@register
def probing_movement(spark, folder):
    tables = shop_tables(spark, folder)
    people = tables["customers"].select(F.col("customer_id").alias("employee_id"))
    parts = {"products": tables["product_catalog"], "warehouses": tables["warehouses"], "employees": people}
    return probe_movement(parts, 990_001, AS_OF)


@register
def customer_contacts(spark, folder):
    """Padded phone numbers, and days counted back from the clock."""
    number = F.col("customer_id")
    now = instant(AS_OF)
    return shop_tables(spark, folder)["customers"].select(
        "customer_id",
        padded_phone("+100000", number).alias("phone"),
        days_before(now, (number % 400).cast("int")).alias("created_at"),
        F.date_sub(F.to_date(now), (number % 90).cast("int")).alias("hired_at"),
        F.date_add(F.to_date(now), (number % 30).cast("int")).alias("expiration_date"),
    )


# --- data quality -----------------------------------------------------------


@register
def duplicate_line_keys(spark, folder):
    lines = base(spark, folder, "lineitem")
    return quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@register
def commands_without_order(spark, folder):
    tables = shop_tables(spark, folder)
    return quality.orphans(
        tables["status_commands"], "customer_order_id", tables["customer_orders"], "customer_order_id"
    )


@register
def missing_order_values(spark, folder):
    columns = ["customer_id", "created_at", "status", "items_count", "last_status_changed_at"]
    return quality.missing_values(shop_tables(spark, folder)["customer_orders"], columns)


@register
def unknown_statuses(spark, folder):
    commands = shop_tables(spark, folder)["status_commands"]
    return quality.outside_domain(commands, "status", ORDER_STATUSES)


def spoilt(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The derived tables with some customers twice, and some values missing, unknown or without a parent."""
    tables = shop_tables(spark, folder)
    customers, stored, moves = (tables[n] for n in ("customers", "customer_orders", "inventory_movements"))
    again = customers.where("customer_id % 50 = 0").withColumn("full_name", F.lit(None).cast("string"))
    return {
        "customers": customers.unionByName(again),
        "warehouses": tables["warehouses"],
        "products": tables["product_catalog"].select("product_id", "product_name"),
        "customer_orders": stored.withColumns(
            {
                "status": F.expr("CASE customer_order_id % 100 WHEN 3 THEN 'lost' WHEN 4 THEN NULL ELSE status END"),
                "customer_id": F.expr("CASE WHEN customer_order_id % 200 = 5 THEN -customer_id ELSE customer_id END"),
                "created_at": F.expr("CASE WHEN customer_order_id % 150 <> 2 THEN created_at END"),
            }
        ),
        "customer_order_items": tables["customer_order_items"],
        "inventory_movements": moves.withColumn(
            "movement_type", F.expr("CASE WHEN product_id % 90 = 1 THEN 'moved' ELSE movement_type END")
        ),
        "customer_order_audit_notes": tables["customer_order_audit_notes"],
    }


@register
def constraint_violations(spark, folder):
    return quality.violations(spoilt(spark, folder))


@register
def wrong_backfilled_totals(spark, folder):
    """Totals worked out from the lines, and of some orders an amount or a number changed afterwards."""
    tables = shop_tables(spark, folder)
    lines = tables["customer_order_items"]
    amount = F.expr("CASE WHEN customer_order_id % 300 = 7 THEN total_amount + 0.01 ELSE total_amount END")
    number = F.expr("CASE WHEN customer_order_id % 500 = 8 THEN items_count - 1 ELSE items_count END")
    stored = backfill_totals(tables["customer_orders"].drop("total_amount").withColumn("total_amount", F.lit(None)), lines)
    return quality.wrong_totals(
        stored.withColumns({"total_amount": amount.cast("decimal(14,2)"), "items_count": number}), lines
    )


@register
def wrong_order_totals(spark, folder):
    tables = shop_tables(spark, folder)
    stored = tables["customer_orders"].withColumn("items_count", F.coalesce("items_count", F.lit(0)))
    return quality.wrong_totals(stored, tables["customer_order_items"])


@register
def movement_differences(spark, folder):
    changes = change_table(spark, folder)
    undeleted = latest_per_key(changes.where("is_deleted = 0"), ["inventory_movement_id"], ["version", "seq"])
    return quality.reconcile(
        undeleted, current_rows(changes), "inventory_movement_id", ["movement_type", "quantity", "moved_at"]
    )


# --- metrics and latency ----------------------------------------------------


def flat_labels(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col("labels")[n].alias(n) for n in names], *[c for c in df.columns if c != "labels"])


@register
def counter_rates(spark, folder):
    samples = shop_tables(spark, folder)["samples"].where(F.col("metric") != metrics.CONNECTIONS)
    rates = flat_labels(metrics.counter_rates(samples), "datname", "instance", "state")
    return rounded(rates, "rate", digits=9)


@register
def cache_hit_ratio(spark, folder):
    ratio = metrics.hit_ratio(shop_tables(spark, folder)["samples"], window_seconds=86_400)
    return rounded(ratio, "hit_ratio", digits=9)


@register
def transactions_per_second(spark, folder):
    samples = shop_tables(spark, folder)["samples"]
    # Reads stand in for rollbacks: both counters then share the label sets.
    rates = metrics.added_rates(samples, metrics.COMMITS, metrics.BLOCKS_READ, window_seconds=86_400)
    return rounded(flat_labels(rates, "datname", "instance", "state"), "rate", digits=9)


@register
def commits_and_rollbacks_per_second(spark, folder):
    samples = transaction_samples(base(spark, folder, "events"))
    rates = metrics.transactions_per_second(samples, window_seconds=86_400)
    return rounded(flat_labels(rates, "datname", "instance"), "rate", digits=9)


@register
def database_overview(spark, folder):
    return metrics.database_overview(overview_samples(base(spark, folder, "events")), AS_OF)


@register
def backup_overview(spark, folder):
    return metrics.backup_overview(overview_samples(base(spark, folder, "events")), AS_OF)


@register
def cluster_counts(spark, folder):
    return metrics.cluster_counts(overview_samples(base(spark, folder, "events")), AS_OF)


@register
def cluster_members(spark, folder):
    members = metrics.member_states(overview_samples(base(spark, folder, "events")), AS_OF)
    return flat_labels(members, "instance", "job", "backend")


@register
def connections_by_state(spark, folder):
    return metrics.connections_by_state(shop_tables(spark, folder)["samples"])


@register
def gauge_by_database(spark, folder):
    samples = shop_tables(spark, folder)["samples"]
    return metrics.gauge(samples, metrics.CONNECTIONS, "max", ["datname"], as_of=AS_OF)


@register
def database_names(spark, folder):
    return metrics.label_values(shop_tables(spark, folder)["samples"], metrics.CONNECTIONS, "datname")


@register
def series_values(spark, folder):
    now = metrics.newest_samples(shop_tables(spark, folder)["samples"], AS_OF)
    return flat_labels(now.select("metric", "labels", "value"), "datname", "instance", "state")


@register
def statement_mean_time(spark, folder):
    pairs = F.array(
        F.struct(F.lit(metrics.STATEMENT_SECONDS).alias("metric"), F.col("value").alias("value")),
        F.struct(F.lit(metrics.STATEMENT_CALLS).alias("metric"), (F.col("event_id") % 9).cast("double").alias("value")),
    )
    samples = base(spark, folder, "events").select(
        F.create_map(F.lit("queryid"), F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.inline(pairs),
    )
    return rounded(flat_labels(metrics.top_mean_time(samples), "queryid"), "mean_ms")


@register
def backup_staleness(spark, folder):
    samples = base(spark, folder, "events").select(
        F.lit(metrics.LAST_SUCCESS).alias("metric"),
        F.create_map(
            F.lit("db"), F.concat(F.lit("db"), F.col("user_id").cast("string")), F.lit("bucket"), F.col("event_type")
        ).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") > 20, F.unix_seconds(F.col("ts").cast("timestamp"))).otherwise(0).cast("double").alias(
            "value"
        ),
    )
    return flat_labels(metrics.staleness(samples, AS_OF), "db", "bucket")


@register
def latency_by_profile(spark, folder):
    report = latency.latency_report(shop_tables(spark, folder)["requests"])
    return rounded(report, "avg", "per_second", "med", "p90", "p95")


@register
def threshold_verdicts(spark, folder):
    verdicts = latency.threshold_verdicts(
        shop_tables(spark, folder)["requests"], {**latency.P95_LIMITS, "oltp_read": 100.0, "log_insert": 100.0}
    )
    return rounded(verdicts, "measured")


@register
def check_counts(spark, folder):
    return latency.check_counts(shop_tables(spark, folder)["requests"], {**latency.EXPECTED_STATUS, "log_insert": 200})


@register
def run_comparison(spark, folder):
    before = shop_tables(spark, folder)["requests"]
    slower = F.when(F.col("profile") == "oltp_read", F.col("duration_ms") * 1.5).otherwise(F.col("duration_ms") + 2)
    after = before.withColumn("duration_ms", slower)
    compared = latency.compare_runs(latency.latency_report(before), latency.latency_report(after))
    return rounded(compared, "p95_before", "p95_after", "change_percent")


@register
def slowest_statements(spark, folder):
    statements = (
        base(spark, folder, "events")
        .groupBy(F.concat(F.lit("SELECT\n\""), "event_type", F.lit("\", "), F.col("user_id").cast("string")).alias("query"))
        .agg(
            F.max("value").alias("mean_exec_time"),
            F.count(F.lit(1)).alias("calls"),
            F.sum("event_id").alias("shared_blks_hit"),
            F.max("event_id").alias("shared_blks_read"),
        )
    )
    path = fresh_dir(spark, "statements")
    export_csv(latency.slowest_statements(statements), path)
    return load_statements(spark, path)


@register
def newest_notes(spark, folder):
    notes = shop_tables(spark, folder)["customer_order_audit_notes"]
    return top_by(notes, [F.desc("audit_note_id")], 5)


@register
def sampled_products(spark, folder):
    return sample_rows(shop_tables(spark, folder)["product_catalog"], "product_id", 100, SEED)
