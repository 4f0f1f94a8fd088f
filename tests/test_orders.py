import collections
import os

import pytest
from pyspark.sql import functions as F

from stocklens.operators.quality import wrong_totals
from stocklens.plans import orders
from stocklens.plans.orders import apply_status_changes, create_orders, creation_results, log_status_events
from stocklens.schemas import ORDER_STATUSES

AS_OF = "2021-06-01T12:00:00Z"


def pool(spark, name, n):
    return spark.range(1, n + 1).select((F.col("id") * 10).alias(name))


def make(spark, requests=500, customers=7, products=5, seed=1, **more):
    return create_orders(
        spark.range(1, requests + 1).toDF("request_id"),
        pool(spark, "customer_id", customers),
        pool(spark, "product_id", products),
        AS_OF,
        seed,
        **more,
    )


def test_created_orders(spark):
    made = make(spark, next_ids=(1001, 5001, 9001), source="shop")
    stored, items = made.orders.collect(), made.items.collect()
    assert sorted(r.customer_order_id for r in stored) == list(range(1001, 1501))
    assert sorted(r.customer_order_item_id for r in items) == list(range(5001, 6501))
    assert sorted(r.audit_note_id for r in made.notes.collect()) == list(range(9001, 9501))
    assert {r.status for r in stored} == {"new"} and {r.items_count for r in stored} == {3}
    assert {str(r.delivery_window_end - r.delivery_window_start) for r in stored} == {"4:00:00"}
    assert made.notes.first().note_text == "Order created by shop workload"
    per_order = collections.defaultdict(set)
    for r in items:
        per_order[r.customer_order_id].add(r.product_id)
        assert float(r.ordered_quantity) == r.product_id / 10 + 1  # place among the products plus one
        assert 20 <= float(r.sale_price) < 170
    assert all(len(p) == 3 for p in per_order.values())
    assert wrong_totals(made.orders, made.items).count() == 0
    assert {r.item_count for r in creation_results(made).collect()} == {3}


def test_picks_reach_every_product_and_customer_evenly(spark):
    made = make(spark, requests=6000)
    products = [r["count"] for r in made.items.groupBy("product_id").count().collect()]
    customers = [r["count"] for r in made.orders.groupBy("customer_id").count().collect()]
    assert len(products) == 5 and min(products) > 3300 and max(products) < 3900
    assert len(customers) == 7 and min(customers) > 700 and max(customers) < 1020
    triples = made.items.groupBy("customer_order_id").agg(F.sort_array(F.collect_list("product_id")).alias("t"))
    assert triples.select("t").distinct().count() == 10


def test_same_seed_same_orders(spark, rows):
    assert rows(make(spark, 50).orders) == rows(make(spark, 50).orders)
    assert rows(make(spark, 50).items) != rows(make(spark, 50, seed=2).items)


@pytest.mark.parametrize("products", [0, 1, 2])
def test_small_product_pool(spark, products):
    made = make(spark, 20, products=products)
    assert made.items.count() == 20 * products
    first = made.orders.first()
    assert first.items_count == products and (first.total_amount is None) == (products == 0)
    assert made.orders.count() == 20


def test_no_customers_no_orders(spark):
    made = make(spark, 20, customers=0)
    assert made.orders.count() == 0


def stored(spark):
    return spark.sql(
        """SELECT *, TIMESTAMP '2021-01-01' AS created_at, CAST(NULL AS TIMESTAMP) AS last_status_changed_at
        FROM VALUES (1L, 'new'), (2L, 'picking'), (3L, 'new') AS t(customer_order_id, status)"""
    )


def commands(spark, *rows):
    return spark.createDataFrame(list(rows), "customer_order_id BIGINT, status STRING, seq BIGINT")


COMMANDS = [(1, "picking", 1), (2, "lost", 2), (1, None, 3), (9, "new", 4), (1, "delivered", 7), (2, "cancelled", 8)]


def test_status_changes(spark, rows):
    done = apply_status_changes(stored(spark), commands(spark, *COMMANDS), AS_OF, source="desk", next_ids=(50, 70))
    assert rows(done.orders, "customer_order_id", "status") == [(1, "delivered"), (2, "cancelled"), (3, "new")]
    assert done.orders.where("last_status_changed_at IS NULL").count() == 1
    assert rows(done.events, "order_status_event_id", "customer_order_id", "old_status", "new_status") == [
        (50, 1, "new", "picking"),
        (51, 2, "picking", "confirmed"),
        (52, 1, "picking", "confirmed"),
        (53, 1, "confirmed", "delivered"),
        (54, 2, "confirmed", "cancelled"),
    ]
    note = done.notes.where("audit_note_id = 70").first()
    assert note.note_text == "Status changed from new to picking by desk workload"


def test_a_batch_equals_its_commands_one_by_one(spark, rows):
    at_once = apply_status_changes(stored(spark), commands(spark, *COMMANDS), AS_OF)
    now, events = stored(spark), []
    for command in COMMANDS:
        step = apply_status_changes(now, commands(spark, command), AS_OF)
        events += [(r.customer_order_id, r.old_status, r.new_status) for r in step.events.collect()]
        now = spark.createDataFrame(step.orders.collect(), step.orders.schema)
    assert rows(now, "customer_order_id", "status") == rows(at_once.orders, "customer_order_id", "status")
    assert sorted(events) == rows(at_once.events, "customer_order_id", "old_status", "new_status")


def test_sequence_across_chunks(spark, rows, monkeypatch):
    many = spark.range(1, 400).select(
        F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id") % 3).alias("customer_order_id"),
        F.element_at(F.array(*[F.lit(s) for s in ORDER_STATUSES]), (F.col("id") % 6 + 1).cast("int")).alias("status"),
        F.col("id").alias("seq"),
    )
    whole = rows(orders.status_steps(stored(spark), many))
    monkeypatch.setattr(orders, "SEQUENCE_CHUNK", 5)
    assert rows(orders.status_steps(stored(spark), many)) == whole


def test_logging_leaves_the_orders_alone(spark, rows):
    events = log_status_events(stored(spark), commands(spark, *COMMANDS), AS_OF, next_id=5)
    assert rows(events, "order_status_event_id", "customer_order_id", "old_status", "new_status", "event_source") == [
        (5, 1, "new", "picking", "k6-log-stream"),
        (6, 2, "picking", "confirmed", "k6-log-stream"),
        (7, 1, "new", "confirmed", "k6-log-stream"),
        (8, 1, "new", "delivered", "k6-log-stream"),
        (9, 2, "picking", "cancelled", "k6-log-stream"),
    ]


def test_changed_orders_need_no_numbering(spark):
    """Setting up starts no job; events, notes and results share one sort, which can be removed."""
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("set-up", "")
    changes = apply_status_changes(stored(spark), commands(spark, *COMMANDS), AS_OF)
    assert changes.orders.columns
    assert list(tracker.getJobIdsForGroup("set-up")) == []
    sort = changes.steps.stored_at
    assert changes.events.count() == changes.notes.count() == changes.results.count() == 5
    assert changes.steps.stored_at == sort and os.path.isdir(sort)
    changes.close()
    assert not os.path.exists(sort)
    context.setLocalProperty("spark.jobGroup.id", None)
