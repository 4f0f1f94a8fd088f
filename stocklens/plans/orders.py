"""Batch forms of order creation and status changes.

Every job takes its clock (``as_of``) and, where something is picked at
random, a ``seed``, so that a repeated run gives the same rows.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.scalars import draw, instant, order_status
from stocklens.operators.latest import latest_per_key
from stocklens.operators.ordered import assign_ids, forget, numbered, previous_value

# Lines per created order, price range, address ranges, delivery window, note texts.
LINES_PER_ORDER = 3
LOWEST_PRICE = 20
PRICE_STEPS = 150
STREETS = 1000
BUILDINGS = 200
CREATED_NOTE = "Order created by {source} workload"
CHANGED_NOTE = "Status changed from %s to %s by {source} workload"
LOG_SOURCE = "k6-log-stream"
DEFAULT_SOURCE = "orders-api"

# Commands of one order that may meet in one task while they are put in sequence.
SEQUENCE_CHUNK = 1_000_000


class CreatedOrders(NamedTuple):
    orders: DataFrame
    items: DataFrame
    notes: DataFrame


class StatusChanges:
    """Orders after status commands, with an event, a note and a result row per command.

    Nothing runs before a part is asked for. The commands are numbered once,
    when the first part with ids is asked for; :meth:`close` removes that sort
    after the last use.
    """

    def __init__(self, orders: DataFrame, commands: DataFrame, now: Column, source: str, next_ids: tuple[int, int]):
        self.stored, self.commands, self.now, self.source = orders, commands, now, source
        self.first_event, self.first_note = next_ids

    @cached_property
    def steps(self) -> DataFrame:
        return assign_ids(status_steps(self.stored, self.commands), "_n", ["seq"], start=0)

    @property
    def orders(self) -> DataFrame:
        return with_last_status(self.stored, last_commands(self.commands), self.now)

    @property
    def events(self) -> DataFrame:
        return self.steps.select(
            (F.col("_n") + self.first_event).alias("order_status_event_id"),
            "customer_order_id",
            "old_status",
            "new_status",
            F.lit(self.source).alias("event_source"),
            self.now.alias("created_at"),
        )

    @property
    def notes(self) -> DataFrame:
        return self.steps.select(
            (F.col("_n") + self.first_note).alias("audit_note_id"),
            "customer_order_id",
            F.lit("status").alias("note_type"),
            F.format_string(CHANGED_NOTE.format(source=self.source), "old_status", "new_status").alias("note_text"),
            self.now.alias("created_at"),
        )

    @property
    def results(self) -> DataFrame:
        return self.steps.select(
            "customer_order_id",
            "old_status",
            "new_status",
            (F.col("_n") + self.first_event).alias("order_status_event_id"),
            (F.col("_n") + self.first_note).alias("audit_note_id"),
        )

    def close(self) -> None:
        if "steps" in self.__dict__:
            forget(self.steps)
            del self.steps


def with_distinct_picks(df: DataFrame, seed: int, request: Column, size: int, name: str) -> DataFrame:
    """Add an array of up to three different positions in ``0 … size-1``.

    Each draw is made among the positions not taken yet and moved past the
    taken ones in ascending order. Every step is a column of its own, so that
    a draw is computed once however often later steps use it.
    """
    count = min(size, LINES_PER_ORDER)
    free = {f"_free{i}": F.pmod(draw(seed + i, request), F.lit(size - i)) for i in range(count)}
    picked = df.withColumns(free) if free else df
    taken = [F.col("_free0")]
    if count > 1:
        picked = picked.withColumn("_second", F.col("_free1") + (F.col("_free1") >= F.col("_free0")).cast("bigint"))
        taken.append(F.col("_second"))
    if count > 2:
        low, high = F.least(*taken), F.greatest(*taken)
        picked = picked.withColumn("_past_low", F.col("_free2") + (F.col("_free2") >= low).cast("bigint"))
        picked = picked.withColumn("_third", F.col("_past_low") + (F.col("_past_low") >= high).cast("bigint"))
        taken.append(F.col("_third"))
    picks = F.array(*taken[:count]) if count else F.array().cast("array<bigint>")
    return picked.withColumn(name, picks).drop(*free, "_second", "_past_low", "_third")


def create_orders(
    requests: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    as_of: object,
    seed: int,
    source: str = DEFAULT_SOURCE,
    next_ids: tuple[int, int, int] = (1, 1, 1),
) -> CreatedOrders:
    """One order with three different products per request id.

    Customer and products are drawn at random. The ordered quantity is the
    product's place among all products plus one, not 2, 3, 4. No customers:
    no orders. No products: orders without lines and without an amount.
    ``next_ids`` are the first free order, line and note ids.
    """
    first_order, first_item, first_note = next_ids
    now = instant(as_of)
    people, person_count = numbered(customers.select("customer_id"), "_customer_place", ["customer_id"], start=0)
    goods, product_count = numbered(products.select("product_id"), "_place", ["product_id"], start=0)
    places = assign_ids(requests.select("request_id"), "_n", ["request_id"], start=0)
    lines = min(product_count, LINES_PER_ORDER)
    request = F.col("request_id")
    # Without customers the join below finds none and no order is made.
    person = F.pmod(draw(seed + 10, request), F.lit(max(person_count, 1)))
    drawn = with_distinct_picks(places, seed, request, product_count, "_picks").select(
        "request_id",
        "_n",
        (F.col("_n") + first_order).alias("customer_order_id"),
        person.alias("_customer_place"),
        "_picks",
    )
    price = F.lit(LOWEST_PRICE) + F.pmod(draw(seed + 20, request, F.col("_i")), F.lit(PRICE_STEPS))
    # The outer form keeps Spark from repeating the draws in an inferred filter.
    lines_of = F.posexplode_outer("_picks").alias("_i", "_place")
    items = (
        drawn.select("request_id", "_n", "customer_order_id", lines_of)
        .where("_place IS NOT NULL")
        .join(goods, "_place")
        .select(
            (F.col("_n") * lines + F.col("_i") + first_item).alias("customer_order_item_id"),
            "customer_order_id",
            "product_id",
            (F.col("_place") + 2).cast("decimal(14,3)").alias("ordered_quantity"),
            price.cast("decimal(14,2)").alias("sale_price"),
        )
    )
    totals = items.groupBy("customer_order_id").agg(
        F.sum(F.col("ordered_quantity") * F.col("sale_price")).cast("decimal(14,2)").alias("total_amount"),
        F.count(F.lit(1)).cast("int").alias("items_count"),
    )
    address = F.format_string(
        "Load street %d, building %d",
        F.pmod(draw(seed + 11, request), F.lit(STREETS)),
        F.pmod(draw(seed + 12, request), F.lit(BUILDINGS)),
    )
    orders = (
        drawn.join(people, "_customer_place")
        .join(totals, "customer_order_id", "left")
        .select(
            "customer_order_id",
            "customer_id",
            address.alias("delivery_address"),
            now.alias("created_at"),
            F.lit("new").alias("status"),
            (now + F.expr("INTERVAL '1' DAY")).alias("delivery_window_start"),
            (now + F.expr("INTERVAL '1 04' DAY TO HOUR")).alias("delivery_window_end"),
            F.lit(1).cast("smallint").alias("delivery_priority"),
            "total_amount",
            F.coalesce("items_count", F.lit(0)).alias("items_count"),
            now.alias("last_status_changed_at"),
        )
    )
    notes = orders.select(
        (F.col("customer_order_id") - first_order + first_note).alias("audit_note_id"),
        "customer_order_id",
        F.lit("operator").alias("note_type"),
        F.lit(CREATED_NOTE.format(source=source)).alias("note_text"),
        now.alias("created_at"),
    )
    return CreatedOrders(orders, items, notes)


def creation_results(created: CreatedOrders) -> DataFrame:
    """The created orders with the number of lines that were written."""
    written = created.items.groupBy("customer_order_id").agg(F.count("customer_order_id").alias("item_count"))
    return created.orders.join(written, "customer_order_id", "left").select(
        "customer_order_id",
        "customer_id",
        "delivery_address",
        "created_at",
        "status",
        "total_amount",
        "items_count",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
    )


def normalized(commands: DataFrame) -> DataFrame:
    return commands.select("customer_order_id", order_status(F.col("status")).alias("status"), "seq")


def status_steps(orders: DataFrame, commands: DataFrame) -> DataFrame:
    """Each command with the status it replaces; commands for unknown orders give no row.

    The commands of an order form one sequence along ``seq``, which has to be
    unique: the first replaces the stored status, each other one the status of
    the command before it.
    """
    return previous_value(
        normalized(commands),
        keys=["customer_order_id"],
        order="seq",
        value="status",
        chunk=F.floor(F.col("seq") / SEQUENCE_CHUNK),
        name="old_status",
        start=orders.select("customer_order_id", "status"),
    ).select("customer_order_id", "seq", "old_status", F.col("status").alias("new_status"))


def last_commands(commands: DataFrame) -> DataFrame:
    return latest_per_key(normalized(commands), ["customer_order_id"], ["seq"])


def with_last_status(orders: DataFrame, last: DataFrame, as_of: Column) -> DataFrame:
    """Orders with the given last status; orders without one stay as they are."""
    new = last.select("customer_order_id", F.col("status").alias("_new"))
    changed = F.col("_new").isNotNull()
    return (
        orders.join(new, "customer_order_id", "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .withColumn("last_status_changed_at", F.when(changed, as_of).otherwise(F.col("last_status_changed_at")))
        .select(*orders.columns)
    )


def apply_status_changes(
    orders: DataFrame,
    commands: DataFrame,
    as_of: object,
    source: str = DEFAULT_SOURCE,
    next_ids: tuple[int, int] = (1, 1),
) -> StatusChanges:
    """Orders after all commands, plus one event, one note and one result row per command.

    ``next_ids`` are the first free event and note ids.
    """
    return StatusChanges(orders, commands, instant(as_of), source, next_ids)


def drawn_orders(requests: DataFrame, orders: DataFrame, seed: int) -> DataFrame:
    """Requests (``seq`` and further columns) with an order drawn for each; none if there are no orders."""
    places, count = numbered(orders.select("customer_order_id"), "_place", ["customer_order_id"], start=0)
    place = F.pmod(draw(seed, F.col("seq")), F.lit(max(count, 1)))
    return requests.withColumn("_place", place).join(places, "_place").drop("_place")


def log_status_events(
    orders: DataFrame, commands: DataFrame, as_of: object, next_id: int = 1, source: str = LOG_SOURCE
) -> DataFrame:
    """Status events that leave the orders as they are: every event starts from the stored status."""
    known = normalized(commands).join(
        orders.select("customer_order_id", F.col("status").alias("old_status")), "customer_order_id"
    )
    return assign_ids(known, "order_status_event_id", ["seq"], start=next_id).select(
        "order_status_event_id",
        "customer_order_id",
        "old_status",
        F.col("status").alias("new_status"),
        F.lit(source).alias("event_source"),
        instant(as_of).alias("created_at"),
    )
