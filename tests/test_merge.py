import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stocklens.operators import quality
from stocklens.operators.merge import backfill_totals, delete_keys, evolve, insert_missing, upsert
from stocklens.sinks.versioned import append, export_csv, newest, publish, read_version, refresh


def table(spark, *rows, columns="k BIGINT, a STRING, b BIGINT"):
    return spark.createDataFrame(list(rows), columns)


def test_upsert_overwrites_listed_columns_only(spark, rows):
    target = table(spark, (1, "x", 10), (2, "y", 20))
    source = table(spark, (2, "new", 99), (3, "z", 30))
    assert rows(upsert(target, source, ["k"], ["b"])) == [(1, "x", 10), (2, "y", 99), (3, "z", 30)]
    assert rows(upsert(target, source, ["k"])) == [(1, "x", 10), (2, "new", 99), (3, "z", 30)]


def test_upsert_with_null_overwrites(spark, rows):
    assert rows(upsert(table(spark, (1, "x", 10)), table(spark, (1, None, None)), ["k"])) == [(1, None, None)]


def test_upsert_rejects_a_repeated_source_key(spark):
    merged = upsert(table(spark, (1, "x", 10)), table(spark, (1, "a", 1), (1, "b", 2)), ["k"])
    with pytest.raises(Exception, match="more than once"):
        merged.collect()


def test_upsert_on_two_keys(spark, rows):
    target = table(spark, (1, "x", 10), (1, "y", 20))
    source = table(spark, (1, "y", 21), (2, "y", 5))
    assert rows(upsert(target, source, ["k", "a"])) == [(1, "x", 10), (1, "y", 21), (2, "y", 5)]


def test_insert_missing_keeps_the_first_by_order(spark, rows):
    target = spark.createDataFrame([(1, 10)], "k INT, v INT")
    source = spark.createDataFrame([(2, 5, 2), (2, 9, 1), (1, 0, 0), (3, 7, 1), (3, 6, 1)], "k INT, v INT, seq INT")
    assert rows(insert_missing(target, source, ["k"], order=["seq"])) == [(1, 10), (2, 9), (3, 6)]
    assert rows(insert_missing(target, source, ["k"])) == [(1, 10), (2, 5), (3, 6)]


def test_insert_missing_keeps_the_target_and_one_of_equal_keys(spark, rows):
    target = table(spark, (1, "x", 10))
    source = table(spark, (1, "no", 0), (2, "y", 1), (2, "y", 1))
    assert rows(insert_missing(target, source, ["k"])) == [(1, "x", 10), (2, "y", 1)]


def test_delete_and_evolve(spark, rows):
    target = table(spark, (1, "x", 10), (2, "y", 20))
    assert rows(delete_keys(target, table(spark, (2, "", 0)), ["k"])) == [(1, "x", 10)]
    wide = evolve(target, StructType.fromDDL("k INT, a STRING, c TIMESTAMP"))
    assert wide.dtypes == [("k", "int"), ("a", "string"), ("c", "timestamp")]
    assert rows(wide) == [(1, "x", None), (2, "y", None)]


def test_backfill(spark):
    orders = spark.sql(
        """SELECT customer_order_id, TIMESTAMP '2021-01-01' AS created_at, CAST(amount AS DECIMAL(14,2)) AS total_amount,
          n AS items_count, CAST(at AS TIMESTAMP) AS last_status_changed_at
        FROM VALUES (1L, 5, 7, '2022-01-01'), (2L, 5, 7, '2022-01-01'), (3L, NULL, NULL, NULL)
        AS t(customer_order_id, amount, n, at)"""
    )
    items = spark.sql(
        """SELECT 1L AS customer_order_id, CAST(q AS DECIMAL(14,3)) AS ordered_quantity,
        CAST(2.5 AS DECIMAL(14,2)) AS sale_price FROM VALUES (1), (2) AS t(q)"""
    )
    done = backfill_totals(orders, items)
    found = {
        r.customer_order_id: (float(r.total_amount), r.items_count, r.last_status_changed_at.year)
        for r in done.collect()
    }
    assert found == {1: (7.5, 2, 2021), 2: (5.0, 7, 2022), 3: (0.0, 0, 2021)}
    assert {r.customer_order_id for r in quality.wrong_totals(orders, items).collect()} == {1, 2, 3}
    assert {r.customer_order_id for r in quality.wrong_totals(done, items).collect()} == {2}


def test_checks(spark, rows):
    df = table(spark, (1, "x", 10), (1, None, 20), (2, "bad", None))
    assert rows(quality.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert rows(quality.missing_values(df, ["k", "a", "b"])) == [("a", 1), ("b", 1), ("k", 0)]
    assert rows(quality.outside_domain(df, "a", ["x"])) == [("bad", 1)]
    assert rows(quality.orphans(df, "b", table(spark, (10, "", 0)), "k")) == [(20, 1)]
    other = table(spark, (1, "x", 11), (3, "x", 1))
    one = df.where("b = 10")
    assert rows(quality.reconcile(one, other, "k", ["b"])) == [(1, "different"), (3, "missing_in_source")]


def test_versions(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    assert refresh(path, spark, lambda: table(spark, (1, "x", 1))) is None
    assert publish(table(spark, (1, "x", 1)), path, batch_id=4) == 1
    assert publish(table(spark, (9, "repeat", 9)), path, batch_id=4) == 1  # a repeated batch changes nothing
    old = read_version(spark, path)
    assert publish(old.withColumn("b", F.col("b") + 1), path, batch_id=5) == 2  # reads what it replaces
    assert rows(old) == [(1, "x", 1)] and rows(read_version(spark, path)) == [(1, "x", 2)]
    assert newest(spark, path) == (2, 5)


def test_a_half_written_version_is_not_seen(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    publish(table(spark, (1, "x", 1)), path)
    table(spark, (5, "lost", 5)).write.parquet(f"{path}/v2")  # a job that died before the ledger entry
    assert rows(read_version(spark, path)) == [(1, "x", 1)]
    assert publish(table(spark, (2, "y", 2)), path) == 2
    assert rows(read_version(spark, path)) == [(2, "y", 2)]


def test_append_and_csv(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    for day in ("2021-01-01", "2021-01-02"):
        append(spark.createDataFrame([(day, 1)], "day STRING, n INT"), path, partition_by=["day"])
    assert spark.read.parquet(path).where("day = '2021-01-02'").count() == 1
    text = 'a "quoted", text\nin two lines'
    export_csv(spark.createDataFrame([(text, 1)], "q STRING, n INT"), str(tmp_path / "csv"))
    back = spark.read.schema("q STRING, n INT").options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "csv"))
    assert rows(back) == [(text, 1)]
