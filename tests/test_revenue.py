import datetime
import json

import pytest
from pyspark.sql import functions as F

from stocklens.session import configure
from stocklens.plans import revenue
from stocklens.plans.documents import order_documents, order_lines, order_responses
from stocklens.sinks.versioned import newest


@pytest.fixture
def shop(spark):
    orders = spark.sql(
        """SELECT * FROM VALUES
        (1L, 10L, 'a', TIMESTAMP '2021-03-01 08:00:00', 'new', 1, CAST(NULL AS DECIMAL(14,2)), 2),
        (2L, 10L, 'b', TIMESTAMP '2021-03-01 23:30:00', 'new', 1, 1.00, CAST(NULL AS INT)),
        (3L, 11L, 'c', TIMESTAMP '2021-03-02 00:00:00', 'new', NULL, 2.00, 1),
        (4L, 11L, 'd', TIMESTAMP '2021-03-03 12:00:00', 'new', 1, 2.00, 1)
        AS t(customer_order_id, customer_id, delivery_address, created_at, status, delivery_priority,
             total_amount, items_count)"""
    )
    items = spark.sql(
        """SELECT customer_order_item_id, customer_order_id, product_id,
          CAST(q AS DECIMAL(14,3)) AS ordered_quantity, CAST(p AS DECIMAL(14,2)) AS sale_price
        FROM VALUES (11L, 1L, 1L, 2, 10), (12L, 1L, 2L, 1, 5), (13L, 1L, 3L, 1, 7),
                    (21L, 2L, 1L, 1.005, 1.01), (31L, 3L, 3L, 1, 4)
        AS t(customer_order_item_id, customer_order_id, product_id, q, p)"""
    )
    notes = spark.sql(
        """SELECT * FROM VALUES
        (1L, 1L, 'x', 'first', TIMESTAMP '2021-03-01'), (2L, 1L, 'x', 'second', TIMESTAMP '2021-03-02'),
        (3L, 1L, 'x', 'third', TIMESTAMP '2021-03-02'), (4L, 3L, 'x', 'only', TIMESTAMP '2021-03-02')
        AS t(audit_note_id, customer_order_id, note_type, note_text, created_at)"""
    )
    return {
        "customer_orders": orders,
        "customer_order_items": items,
        "customer_order_audit_notes": notes,
        "customers": spark.createDataFrame([(10, "Ann"), (11, "Bob")], "customer_id BIGINT, full_name STRING"),
        "products": spark.createDataFrame(
            [(1, 1, 1, "pen"), (2, 1, 1, "ink"), (3, 2, 2, "cup")],
            "product_id BIGINT, category_id BIGINT, brand_id BIGINT, product_name STRING",
        ),
        "product_categories": spark.createDataFrame(
            [(1, "Office"), (2, "Home")], "category_id BIGINT, category_name STRING"
        ),
        "brands": spark.createDataFrame([(1, "Blue"), (2, "Red")], "brand_id BIGINT, brand_name STRING"),
    }


DAY1, DAY2 = datetime.date(2021, 3, 1), datetime.date(2021, 3, 2)


def test_notes_count_in_every_category_of_an_order(shop):
    found = [
        (r.sales_day, r.category_name, r.order_count, float(r.revenue), r.audit_note_count)
        for r in revenue.revenue_by_day(shop).collect()
    ]
    assert found == [
        (DAY2, "Home", 1, 4.0, 1),
        (DAY1, "Office", 2, 26.01505, 3),
        (DAY1, "Home", 1, 7.0, 3),
    ]


def test_order_count_is_a_distinct_count(shop, rows):
    t = shop
    distinct = (
        t["customer_orders"]
        .join(t["customer_order_items"], "customer_order_id")
        .join(t["products"].join(t["product_categories"], "category_id"), "product_id")
        .groupBy(F.to_date("created_at").alias("sales_day"), "category_name")
        .agg(F.count_distinct("customer_order_id").alias("order_count"))
    )
    ours = revenue.revenue_by_day_and_category(t)
    assert rows(ours, "sales_day", "category_name", "order_count") == rows(distinct)


def test_limit_keeps_newest_days(shop):
    assert [r.sales_day for r in revenue.revenue_by_day(shop, limit=1).collect()] == [DAY2]


def test_stored_report_equals_direct_one_for_whole_days(spark, shop, rows, tmp_path):
    path = str(tmp_path / "mv")
    revenue.build_revenue_aggregate(shop, path)
    stored = revenue.stored_revenue_by_day(spark, path, "2021-03-02", "2021-03-05")
    direct = revenue.revenue_by_day(shop, "2021-03-02", "2021-03-05")
    columns = ["sales_day", "category_name", "order_count", "audit_note_count"]
    assert rows(stored, *columns) == rows(direct, *columns)
    assert [float(r.revenue) for r in stored.collect()] == [float(r.revenue) for r in direct.collect()]


def test_stored_report_differs_for_part_days_and_rounds(spark, shop, tmp_path):
    path = str(tmp_path / "mv")
    revenue.build_revenue_aggregate(shop, path)
    bounds = ("2021-03-01T12:00:00Z", "2021-03-02T12:00:00Z")
    stored = {(r.sales_day, r.category_name): r for r in revenue.stored_revenue_by_day(spark, path, *bounds).collect()}
    direct = {(r.sales_day, r.category_name): r for r in revenue.revenue_by_day(shop, *bounds).collect()}
    assert set(stored) == {(DAY1, "Office"), (DAY1, "Home")}
    assert set(direct) == {(DAY1, "Office"), (DAY2, "Home")}
    assert str(stored[(DAY1, "Office")].revenue) == "26.02"
    assert str(direct[(DAY1, "Office")].revenue) == "1.01505"


def test_refresh_is_skipped_until_built_and_shows_new_rows_after(spark, shop, tmp_path):
    path = str(tmp_path / "mv")
    assert revenue.refresh_revenue_aggregate(spark, shop, path) is None
    revenue.build_revenue_aggregate(shop, path)
    reader = revenue.stored_revenue_by_day(spark, path)
    more = dict(shop)
    extra = shop["customer_order_items"].where("customer_order_item_id = 31").withColumns(
        {"customer_order_item_id": F.lit(41).cast("bigint"), "customer_order_id": F.lit(4).cast("bigint")}
    )
    more["customer_order_items"] = shop["customer_order_items"].unionByName(extra)
    assert reader.count() == 3
    assert revenue.refresh_revenue_aggregate(spark, more, path) == 2
    assert reader.count() == 3  # a reader keeps the version it resolved
    assert revenue.stored_revenue_by_day(spark, path).count() == 4
    assert newest(spark, path)[0] == 2


def test_order_lines(shop):
    lines = order_lines(shop).orderBy("customer_order_item_id").collect()
    assert [r.customer_order_item_id for r in lines] == [11, 12, 13, 21, 31]  # order 4 has no line
    assert (lines[0].audit_note_count, lines[0].last_audit_note) == (3, "third")
    assert (lines[3].audit_note_count, lines[3].last_audit_note, lines[3].items_count) == (0, None, None)
    assert lines[0].total_amount is None
    assert (lines[4].full_name, lines[4].brand_name, lines[4].category_name) == ("Bob", "Red", "Home")


def test_documents_by_order_id(spark, shop):
    wanted = spark.createDataFrame([(1,), (4,), (77,)], "customer_order_id BIGINT")
    documents = order_documents(shop, wanted).collect()
    assert [d.customer_order_id for d in documents] == [1]
    assert [i.customer_order_item_id for i in documents[0]["items"]] == [11, 12, 13]


def test_long_orders_come_in_parts_without_loss(shop):
    documents = order_documents(shop, lines_per_part=2).where("customer_order_id = 1").orderBy("part").collect()
    assert [d.part for d in documents] == [0, 1]
    assert [[i.customer_order_item_id for i in d["items"]] for d in documents] == [[11, 12], [13]]


@pytest.mark.parametrize("lines_per_part", [2, 3, 10_000])
def test_parts_hold_every_line_of_sparse_ids(spark, shop, lines_per_part):
    ids = [2**40 * i for i in range(1, 8)] + [5, 6]
    items = shop["customer_order_items"]
    line = items.where("customer_order_item_id = 11").drop("customer_order_item_id")
    numbers = spark.createDataFrame([(i,) for i in ids], "customer_order_item_id BIGINT")
    many = {**shop, "customer_order_items": line.crossJoin(numbers).select(items.columns)}
    found = order_documents(many, lines_per_part=lines_per_part).orderBy("part").collect()
    assert [d.part for d in found] == list(range(-(-len(ids) // lines_per_part)))
    assert [i.customer_order_item_id for d in found for i in d["items"]] == sorted(ids)
    assert all(len(d["items"]) == lines_per_part for d in found[:-1])


def test_response_text(spark, shop):
    wanted = spark.createDataFrame([(3,)], "customer_order_id BIGINT")
    body = json.loads(order_responses(order_documents(shop, wanted)).first().body)
    assert body == {
        "order": {
            "order_id": 3,
            "customer_id": 11,
            "customer_name": "Bob",
            "delivery_address": "c",
            "created_at": "2021-03-02 00:00:00+00",
            "status": "new",
            "delivery_priority": None,
            "total_amount": "2.00",
            "items_count": 1,
            "audit_note_count": 1,
            "last_audit_note": "only",
        },
        "items": [
            {
                "order_item_id": 31,
                "product_id": 3,
                "product_name": "cup",
                "brand_name": "Red",
                "category_name": "Home",
                "ordered_quantity": "1.000",
                "sale_price": "4.00",
            }
        ],
    }


def test_a_missing_amount_reads_as_zero(shop):
    bodies = [json.loads(r.body)["order"] for r in order_responses(order_documents(shop)).collect()]
    assert {b["order_id"]: b["total_amount"] for b in bodies}[1] == "0"


def test_shuffles_of_tables_begin_with_many_partitions(spark):
    # With the session's own few partitions, what a task holds grows with the tables.
    configure(spark)
    plan = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()._jdf.queryExecution().executedPlan().toString()
    assert ", 1000)" in plan
