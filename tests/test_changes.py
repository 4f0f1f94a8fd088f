import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from stocklens.functions.changes import flatten_envelope, parse_changes, to_messages, typed_changes, unreadable_changes
from stocklens.operators.latest import current_rows, latest_per_key
from stocklens.operators.quality import reconcile
from stocklens.plans import dashboards
from stocklens.sources.changes import snapshot_as_changes


def message(key, kind="receipt", quantity="1.000", at="2021-05-01T10:00:00.123456Z", op="u", ts=1, deleted="false"):
    return json.dumps(
        {
            "inventory_movement_id": key,
            "product_id": 1,
            "warehouse_id": 2,
            "movement_type": kind,
            "quantity": quantity,
            "moved_at": at,
            "employee_id": 3,
            "__op": op,
            "__table": "inventory_movements",
            "__source_ts_ms": ts,
            "__deleted": deleted,
        }
    )


@pytest.fixture
def messages(spark):
    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "seq BIGINT, value STRING")

    return build


def state(df):
    return sorted((r.inventory_movement_id, r.movement_type, str(r.quantity)) for r in df.collect())


def current(messages, *texts, ingest_ms=0):
    return current_rows(parse_changes(messages(*texts), ingest_ms=ingest_ms))


def test_insert_update_delete(messages):
    steps = [
        message(7, "adjustment", "11.111", op="c", ts=1),
        message(7, "write_off", "22.222", op="u", ts=2),
        json.dumps({"inventory_movement_id": 7, "__op": "d", "__source_ts_ms": 3, "__deleted": "true"}),
    ]
    assert state(current(messages, *steps[:1])) == [(7, "adjustment", "11.111")]
    assert state(current(messages, *steps[:2])) == [(7, "write_off", "22.222")]
    assert state(current(messages, *steps)) == []
    again = message(7, "receipt", "5.000", op="c", ts=4)
    assert state(current(messages, *steps, again)) == [(7, "receipt", "5.000")]


def test_bad_fields_do_not_void_the_message(messages):
    row = parse_changes(messages(message(1, quantity="abc", at="not a date", ts="x")), 0).first()
    assert (str(row.quantity), row.moved_at, row.cdc_source_ts_ms, row.version) == ("0.000", None, 0, 0)
    assert str(parse_changes(messages(message(1, quantity="-1.23456")), 0).first().quantity) == "-1.234"
    assert str(parse_changes(messages(message(1, quantity="99999999999999")), 0).first().quantity) == "0.000"
    sparse = parse_changes(messages('{"inventory_movement_id": 4}'), 0).first()
    assert (sparse.product_id, sparse.movement_type, sparse.moved_at, sparse.cdc_op, sparse.is_deleted) == (0, "", None, "", 0)


def test_times_are_cut_to_milliseconds(messages):
    row = parse_changes(messages(message(1)), 0).select(F.col("moved_at").cast("string")).first()
    assert row[0] == "2021-05-01 10:00:00.123"


def test_delete_mark_in_any_case(messages):
    found = parse_changes(messages(*[message(1, deleted=d) for d in ("true", "TRUE", "True", "false", "yes")]), 0)
    assert [r.is_deleted for r in found.orderBy("seq").collect()] == [1, 1, 1, 0, 0]


@pytest.mark.parametrize("text", ["no json", "", "{", "[]", "{}", message(0), message(-3), message(None)])
def test_messages_without_a_positive_key_are_set_apart(messages, text):
    both = messages(text, message(5))
    assert [r.seq for r in parse_changes(both, 0).collect()] == [1]
    assert [r.seq for r in unreadable_changes(both).collect()] == [0]


def test_version_is_the_later_of_source_and_ingest(messages):
    df = messages(message(1, ts=50), message(2, ts=200))
    assert [r.version for r in parse_changes(df, 100).orderBy("seq").collect()] == [100, 200]
    now = parse_changes(df).first().version
    assert now > 1_600_000_000_000


def test_order_and_repetition_do_not_matter(messages):
    texts = [message(1, quantity=f"{i}.000", ts=i, deleted=str(i == 3).lower()) for i in range(1, 5)]
    texts += [message(2, quantity="9.000", ts=1), message(2, ts=2, deleted="true", op="d")]
    expected = [(1, "receipt", "4.000")]
    for order in itertools.islice(itertools.permutations(texts), 0, 720, 97):
        assert state(current(messages, *order)) == expected
    assert state(current(messages, *texts, *texts[::-1])) == expected


def test_update_before_insert(messages):
    assert state(current(messages, message(1, quantity="2.000", ts=9), message(1, op="c", ts=1))) == [
        (1, "receipt", "2.000")
    ]


def test_equal_versions_go_by_arrival(messages):
    assert state(current(messages, message(1, quantity="1.000"), message(1, quantity="2.000"))) == [
        (1, "receipt", "2.000")
    ]
    assert state(current(messages, message(1, quantity="2.000"), message(1, quantity="1.000"))) == [
        (1, "receipt", "1.000")
    ]


def test_dropping_deletes_first_would_be_wrong(messages):
    changes = parse_changes(messages(message(1, ts=1), message(1, op="d", ts=2, deleted="true")), 0)
    wrong = latest_per_key(changes.where("is_deleted = 0"), ["inventory_movement_id"], ["version", "seq"])
    assert wrong.count() == 1 and current_rows(changes).count() == 0
    found = reconcile(wrong, current_rows(changes), "inventory_movement_id", ["quantity"])
    assert [tuple(r) for r in found.collect()] == [(1, "missing_in_sink")]


def test_hot_key_sends_few_rows(spark):
    hot = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("version")
    )
    found = latest_per_key(hot, ["k"], ["version"])
    assert found.where("k = 1").first().version == 29_997
    assert found.count() == hot.select("k").distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange hashpartitioning")
    assert "WindowGroupLimit" in after and "Partial" in after


def test_envelopes(spark, rows):
    schema = "inventory_movement_id: BIGINT, product_id: BIGINT, warehouse_id: BIGINT, movement_type: STRING, "
    schema += "quantity: STRING, moved_at: STRING, employee_id: BIGINT"
    row = json.loads(message(1))
    row = {k: v for k, v in row.items() if not k.startswith("__")}
    source = {"table": "inventory_movements", "ts_ms": 5}
    other = {"table": "orders", "ts_ms": 5}
    texts = [
        json.dumps({"before": None, "after": row, "source": source, "op": "c"}),
        json.dumps({"before": row, "after": None, "source": {**source, "ts_ms": 6}, "op": "d"}),
        json.dumps({"before": None, "after": {**row, "inventory_movement_id": 2}, "source": other, "op": "c"}),
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "seq BIGINT, value STRING")
    flat = flatten_envelope(df, schema, table="inventory_movements")
    assert rows(flat, "seq", "inventory_movement_id", "__op", "__source_ts_ms", "__deleted") == [
        (0, 1, "c", 5, "false"),
        (1, 1, "d", 6, "true"),
    ]
    assert flatten_envelope(df, schema).count() == 3
    assert current_rows(typed_changes(flat, 0)).count() == 0


def test_snapshot_rows_lose_to_changes(spark, messages):
    table = spark.sql(
        """SELECT 1L AS inventory_movement_id, 1L AS product_id, 2L AS warehouse_id, 'receipt' AS movement_type,
        '8.000' AS quantity, '2021-01-01T00:00:00Z' AS moved_at, 3L AS employee_id, -1L AS seq"""
    )
    first = to_messages(snapshot_as_changes(table, 0), keep=["seq"])
    assert state(current_rows(parse_changes(first, 0))) == [(1, "receipt", "8.000")]
    both = first.unionByName(messages(message(1, quantity="3.000", ts=0)))
    assert state(current_rows(parse_changes(both, 0))) == [(1, "receipt", "3.000")]


def test_dashboards(messages, rows):
    random.seed(1)
    kinds = ["receipt", "shipment", "write_off", "adjustment"]
    texts = [message(i, kinds[i % 4], f"{i}.500", f"2021-05-0{1 + i % 3}T23:59:59Z", ts=i) for i in range(1, 13)]
    now = current(messages, *texts)
    assert float(dashboards.total_quantity(now).first()[0]) == 84.0
    assert float(dashboards.total_quantity(now, "2030-01-01").first()[0]) == 0.0
    daily = dashboards.daily_by_type(now, "2021-05-01", "2021-05-03")
    assert {str(r.movement_day) for r in daily.collect()} == {"2021-05-01", "2021-05-02"}
    shares = dashboards.type_share(now).collect()
    assert abs(sum(r.share for r in shares) - 1) < 1e-12
    assert [r.total_quantity for r in shares] == sorted((r.total_quantity for r in shares), reverse=True)
    assert rows(dashboards.top_locations(now), "warehouse_name") == [("Warehouse 2",)]
    empty = now.where("false")
    assert dashboards.type_share(empty).count() == 0
    one = empty.sparkSession.createDataFrame([(3,)], "inventory_movement_id BIGINT")
    assert dashboards.movement_by_id(now, one).first().inventory_movement_id == 3
