import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from stocklens.operators.latest import current_rows
from stocklens.schemas import TABLES
from stocklens.sources.changes import natural_order, read_change_files, read_change_topic, stream_parquet
from stocklens.streaming import log, movements, status
from test_changes import message, state
from test_orders import AS_OF, COMMANDS, commands, stored


@pytest.fixture
def place(tmp_path):
    os.makedirs(tmp_path / "in")
    counter = iter(range(1000))

    def put(*texts):
        number = next(counter)
        target = tmp_path / "in" / f"{number}.txt"
        target.write_text("".join(t + "\n" for t in texts))
        os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))

    put.folder, put.table, put.checkpoint = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    return put


def load(spark, place, ingest_ms=0):
    stream = read_change_files(spark, place.folder)
    movements.load_changes(stream, place.table, place.checkpoint, ingest_ms).awaitTermination()
    return movements.read_current(spark, place.table)


def test_insert_update_delete_in_three_runs(spark, place):
    place(message(7, "adjustment", "11.111", op="c", ts=1))
    assert state(load(spark, place)) == [(7, "adjustment", "11.111")]
    place(message(7, "write_off", "22.222", ts=2))
    assert state(load(spark, place)) == [(7, "write_off", "22.222")]
    place(json.dumps({"inventory_movement_id": 7, "__op": "d", "__source_ts_ms": 3, "__deleted": "true"}))
    assert state(load(spark, place)) == []


def test_bad_messages_are_kept_apart_and_do_not_stop_the_load(spark, place):
    place("no json", message(1), '{"inventory_movement_id": 0}', message(2))
    assert [r[0] for r in state(load(spark, place))] == [1, 2]
    assert {r.value for r in movements.read_rejected(spark, place.table).collect()} == {
        "no json",
        '{"inventory_movement_id": 0}',
    }


def test_a_restart_reads_only_what_is_new(spark, place):
    place(message(1, ts=1))
    load(spark, place)
    load(spark, place)
    assert movements.read_versions(spark, place.table).count() == 1
    place(message(1, quantity="2.000", ts=2), message(3, ts=1))
    assert state(load(spark, place)) == [(1, "receipt", "2.000"), (3, "receipt", "1.000")]


def test_equal_versions_go_by_file(spark, place):
    place(message(1, quantity="1.000"))
    load(spark, place)
    place(message(1, quantity="2.000"))
    assert state(load(spark, place)) == [(1, "receipt", "2.000")]


def test_a_stopped_batch_is_seen_once_and_whole(spark, place, tmp_path):
    """The second batch writes one of its two files and dies; its readers see the state before, then the one after."""
    place(message(1, ts=1), "no json")
    load(spark, place)
    place(message(1, quantity="2.000", ts=2), message(2, ts=2))
    place("still no json", message(3, ts=2))
    broken = tmp_path / "broken"
    broken.write_text("x")

    @F.udf("string")
    def dies(value):
        if value == "still no json" and os.path.exists(broken):
            time.sleep(2)
            raise RuntimeError("lost")
        return value

    def start():
        stream = read_change_files(spark, place.folder).withColumn("value", dies("value"))
        movements.load_changes(stream, place.table, place.checkpoint, 0).awaitTermination()

    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a task for each file
    try:
        with pytest.raises(Exception, match="lost"):
            start()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # A driver that is killed leaves the files of finished tasks behind; no batch names them.
    part = next(n for n in os.listdir(f"{place.table}/log") if n.endswith(".parquet"))
    shutil.copy(f"{place.table}/log/{part}", f"{place.table}/log/part-00009-left-behind.parquet")
    assert state(movements.read_current(spark, place.table)) == [(1, "receipt", "1.000")]
    assert [r.value for r in movements.read_rejected(spark, place.table).collect()] == ["no json"]
    broken.unlink()
    start()
    after = [(1, "receipt", "2.000"), (2, "receipt", "1.000"), (3, "receipt", "1.000")]
    assert state(movements.read_current(spark, place.table)) == after
    assert movements.loaded_changes(spark, place.table).count() == 4
    assert sorted(r.value for r in movements.read_rejected(spark, place.table).collect()) == ["no json", "still no json"]


def test_a_first_batch_that_dies_leaves_nothing(spark, place):
    place(message(1))
    stream = read_change_files(spark, place.folder).withColumn("value", F.expr("raise_error(value)"))
    with pytest.raises(Exception, match="inventory_movement_id"):
        movements.load_changes(stream, place.table, place.checkpoint, 0).awaitTermination()
    assert movements.read_current(spark, place.table).count() == 0
    assert state(load(spark, place)) == [(1, "receipt", "1.000")]


def test_compaction_keeps_delete_marks(spark, place):
    place(message(1, ts=1), message(2, ts=1), message(2, quantity="4.000", ts=2))
    load(spark, place)
    place(message(1, op="d", ts=9, deleted="true"))
    load(spark, place)
    assert movements.compact(spark, place.table) == 1
    assert movements.compact(spark, place.table) == 1
    assert spark.read.parquet(f"{place.table}/base/v1").count() == 2
    assert state(movements.read_current(spark, place.table)) == [(2, "receipt", "4.000")]
    place(message(1, ts=5), message(3, ts=1))  # late for key 1
    assert state(load(spark, place)) == [(2, "receipt", "4.000"), (3, "receipt", "1.000")]
    assert movements.compact(spark, place.table) == 2
    assert state(movements.read_current(spark, place.table)) == [(2, "receipt", "4.000"), (3, "receipt", "1.000")]


def test_a_compacted_log_reads_only_what_came_later(spark, place, monkeypatch):
    monkeypatch.setattr(log, "OVERLAP_MS", 0)
    place(message(1, ts=1), message(1, quantity="2.000", ts=2))
    load(spark, place)
    movements.compact(spark, place.table)
    place(message(2, ts=3))
    load(spark, place)
    assert movements.read_versions(spark, place.table).count() == 2
    assert state(movements.read_current(spark, place.table)) == [(1, "receipt", "2.000"), (2, "receipt", "1.000")]


def test_lines_of_many_splits_keep_their_order(spark, place):
    """Every split holds a line or two of a key's changes, the last of which has to win, also for equal versions."""
    lines = [message(n % 7 + 1, quantity=f"{n}.000", op="c") for n in range(400)] + ["bad"]
    place(*lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = state(load(spark, place, ingest_ms=10**15))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    changes = movements.loaded_changes(spark, place.table)
    assert changes.select("block").distinct().count() > 50
    assert found == [(k, "receipt", f"{max(n for n in range(400) if n % 7 + 1 == k)}.000") for k in range(1, 8)]
    order = [F.col(c) for c in ("seq", "file", "block", "part", "place")]
    assert [int(r.quantity) for r in changes.orderBy(*order).collect()] == list(range(400))


def test_paths_sort_by_their_numbers(spark):
    paths = ["in/9.json", "in/10.json", "b/part-2/x", "b/part-11/x", "in/123456789012345678901234.txt", "in/7"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").orderBy(natural_order(F.col("path")))
    assert [r.path for r in df.collect()] == [paths[i] for i in (2, 3, 5, 0, 1, 4)]


def test_nothing_loaded_yet(spark, tmp_path):
    assert movements.read_current(spark, str(tmp_path / "none")).count() == 0
    assert current_rows(movements.read_versions(spark, str(tmp_path / "none"))).columns[0] == "inventory_movement_id"


def test_kafka_source_is_named_in_the_error(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_change_topic(spark, {"subscribe": "t", "kafka.bootstrap.servers": "none:1"})


def feed(spark, path, batches, first=0):
    """Command batches, one file each."""
    os.makedirs(f"{path}/in", exist_ok=True)
    schema = commands(spark).schema
    for number, batch in enumerate(batches, first):
        with open(f"{path}/in/{number}.json", "w") as out:
            out.writelines(json.dumps(dict(zip(schema.names, c))) + "\n" for c in batch)
        os.utime(f"{path}/in/{number}.json", (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, path, log_only=False):
    schema = commands(spark).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in")
    query = status.run_status_stream(source, path, f"{path}/c", AS_OF, log_only=log_only)
    query.awaitTermination()
    return query


EVENTS = [
    (1, "new", "picking"),
    (2, "picking", "confirmed"),
    (1, "picking", "confirmed"),
    (1, "confirmed", "delivered"),
    (2, "confirmed", "cancelled"),
]


def test_status_stream_equals_one_batch(spark, tmp_path, rows):
    path = str(tmp_path)
    feed(spark, path, [COMMANDS[:2], COMMANDS[2:5], COMMANDS[5:]])
    run(spark, path)
    orders = stored(spark)
    after = [(1, "delivered"), (2, "cancelled"), (3, "new")]
    assert rows(status.current_orders(orders, path), "customer_order_id", "status") == after
    found = status.read_events(orders, path)
    assert rows(found, "customer_order_id", "old_status", "new_status") == sorted(EVENTS, key=repr)
    assert found.columns == [part.split()[0] for part in TABLES["order_status_events"].split(", ")]
    notes = [r.note_text for r in status.read_notes(orders, path).collect()]
    assert len(notes) == 5 and "Status changed from new to picking by orders-api workload" in notes
    status.compact_steps(spark, path)
    assert spark.read.parquet(f"{path}/base/v1").count() == status.last_steps(spark, path).count()
    assert rows(status.current_orders(orders, path), "customer_order_id", "status") == after


def test_a_status_stream_goes_on_from_its_state(spark, tmp_path, rows):
    path = str(tmp_path)
    feed(spark, path, [COMMANDS[:2]])
    run(spark, path)
    feed(spark, path, [COMMANDS[2:5], COMMANDS[5:]], first=1)
    run(spark, path)
    assert rows(status.read_events(stored(spark), path), "customer_order_id", "old_status", "new_status") == sorted(
        EVENTS, key=repr
    )
    before = status.written_steps(spark, path).count()
    run(spark, path)  # nothing new
    assert status.written_steps(spark, path).count() == before


def test_a_batch_costs_its_own_commands_only(spark, tmp_path):
    """Twenty batches of forty commands: none reads more rows or touches more states than the first."""
    path = str(tmp_path)
    feed(spark, path, [[(n % 10 + 1, "confirmed", 40 * b + n) for n in range(40)] for b in range(20)])
    query = run(spark, path)
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) == 20
    assert {p.numInputRows for p in progress} == {40}
    assert {p.stateOperators[0].numRowsUpdated for p in progress} == {10}
    assert {p.stateOperators[0].numRowsTotal for p in progress} == {10}
    steps = status.written_steps(spark, path).where("customer_order_id = 3").orderBy("step").collect()
    assert [(r.step, r.seq) for r in steps] == list(enumerate(range(2, 800, 10), 1))


def test_log_only_stream(spark, tmp_path, rows):
    path = str(tmp_path)
    feed(spark, path, [COMMANDS])
    run(spark, path, log_only=True)
    orders = stored(spark)
    assert rows(status.current_orders(orders, path), "status") == [("new",), ("new",), ("picking",)]
    found = status.read_events(orders, path).collect()
    assert {r.event_source for r in found} == {"k6-log-stream"} and len(found) == 5
    assert {(r.customer_order_id, r.old_status) for r in found} == {(1, "new"), (2, "picking")}
    assert status.read_notes(orders, path).count() == 0


def test_changes_of_one_key_in_one_file_go_by_line(spark, place):
    place(message(1, quantity="1.000"), message(1, quantity="2.000"), message(1, quantity="3.000"), message(2, op="c"),
          json.dumps({"inventory_movement_id": 2, "__op": "d", "__source_ts_ms": 1, "__deleted": "true"}))
    assert state(load(spark, place, ingest_ms=10**15)) == [(1, "receipt", "3.000")]


def test_a_replayed_batch_has_the_same_versions(spark, place, tmp_path):
    place(message(1), message(2))
    load(spark, place, ingest_ms=None)
    first = sorted(r.version for r in movements.read_versions(spark, place.table).collect())
    # Without its commit the batch is run again.
    for name in os.listdir(f"{place.checkpoint}/commits"):
        os.replace(f"{place.checkpoint}/commits/{name}", tmp_path / f"gone-{name}")
    load(spark, place, ingest_ms=None)
    assert sorted(r.version for r in movements.read_versions(spark, place.table).collect()) == first


def test_a_table_of_part_files_streams_like_one_file(spark, tmp_path):
    rows = spark.range(30).selectExpr("id")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next(n for n in os.listdir(tmp_path / "one") if n.endswith(".parquet"))
    os.makedirs(tmp_path / "t")
    os.link(tmp_path / "one" / part, tmp_path / "t" / "single.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "t" / "many.parquet"))
    for name in ("single.parquet", "many.parquet"):
        stream = stream_parquet(spark, str(tmp_path / "t"), name, rows.schema, files_per_batch=1)
        out = str(tmp_path / f"out-{name}")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(
            out
        ).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))
    with pytest.raises(FileNotFoundError):
        stream_parquet(spark, str(tmp_path / "t"), "absent.parquet", rows.schema)
