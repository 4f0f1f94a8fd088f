import numpy
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stocklens.operators import ordered
from stocklens.operators.ordered import (
    assign_by_bounds,
    assign_cyclic,
    assign_ids,
    exact_quantiles,
    next_id,
    previous_value,
)


def test_ids_are_dense_and_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("k"))
    found = [(r.k, r.n) for r in assign_ids(df, "n", ["k"], start=101).orderBy("k").collect()]
    assert [n for _, n in found] == list(range(101, 5101))
    assert [k for k, _ in found] == sorted(k for k, _ in found)


def test_ids_stay_the_same_when_read_again(spark, rows):
    numbered = assign_ids(spark.range(0, 3000, 1, 5).toDF("k"), "n", [F.desc("k")])
    assert rows(numbered) == rows(numbered.repartition(3))
    assert numbered.where("k = 2999").first().n == 1


def test_ids_of_nothing(spark):
    empty = spark.range(0).toDF("k")
    assert assign_ids(empty, "n", ["k"]).count() == 0
    assert next_id(empty, "k") == 1 and next_id(spark.range(5).toDF("k"), "k") == 5


def test_hot_sort_value_with_tiebreak(spark):
    df = spark.range(0, 3000, 1, 4).select(F.lit(1).alias("same"), "id")
    found = assign_ids(df, "n", ["same", "id"])
    assert found.where("n <> id + 1").count() == 0


def test_cyclic(spark, rows):
    pool = spark.createDataFrame([(30,), (10,), (20,)], "id BIGINT")
    df = spark.range(1, 8).toDF("n")
    assert [p for _, p in rows(assign_cyclic(df, "n", pool, "id", "p"))] == [10, 20, 30, 10, 20, 30, 10]
    assert assign_cyclic(df, "n", pool.where("false"), "id", "p").count() == 0


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_previous_value_equals_lag(spark, rows, width):
    df = spark.range(0, 4000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k"),
        F.col("id").alias("o"),
        F.when(F.col("id") % 11 > 0, F.col("id") * 2).alias("v"),
    )
    ours = previous_value(df, ["k"], "o", "v", F.floor(F.col("o") / width), "p")
    lag = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    assert rows(ours, "k", "o", "v", "p") == rows(lag, "k", "o", "v", "p")


def test_previous_value_with_start(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 9, "b"), (2, 3, "c")], "k INT, o INT, v STRING")
    start = spark.createDataFrame([(1, "s")], "k INT, v STRING")
    found = previous_value(df, ["k"], "o", "v", F.floor(F.col("o") / 4), "p", start)
    assert rows(found, "k", "o", "p") == [(1, 1, "s"), (1, 9, "a")]


@pytest.mark.parametrize(("accuracy", "margin"), [(2, 0.0), (3, 0.2), (10_000, 0.0005)])
def test_quantiles(spark, monkeypatch, accuracy, margin):
    """The same with a sketch that is far off."""
    monkeypatch.setattr(ordered, "ACCURACY", accuracy)
    monkeypatch.setattr(ordered, "MARGIN", margin)
    random = numpy.random.default_rng(3)
    values = {"one": [4.25], "two": [1.0, 2.0], "many": random.exponential(40, 997).round(6).tolist()}
    values["hot"] = [5.0] * 600 + random.uniform(0, 90, 300).round(3).tolist()
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("one", None)], "g STRING, v DOUBLE")
    fractions = {"low": 0.0, "med": 0.5, "p90": 0.9, "p95": 0.95, "high": 1.0}
    for row in exact_quantiles(df, ["g"], "v", fractions).collect():
        for name, p in fractions.items():
            assert row[name] == pytest.approx(numpy.quantile(values[row.g], p), abs=1e-9), (row.g, name)


def test_quantiles_without_groups(spark):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", {"med": 0.5, "p95": 0.95}).first() == (51.0, 96.0)


def test_many_values_in_one_millisecond(spark):
    """A million distinct values within one, and an outlier: hardly any are left around the wanted places."""
    values = F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") / 1e6)
    df = spark.range(0, 1_000_001, 1, 8).select(values.alias("v"), F.lit("hot").alias("g"))
    counts = df.groupBy("g", F.col("v").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered.in_steps(df, counts, ["g"], "v", {"med": 0.5, "p90": 0.9})
    wanted = ordered.wanted_steps(placed, ["g"], {"med": 0.5, "p90": 0.9})
    assert wanted.count() == 2 and placed.join(wanted, ["g", "_step"]).count() <= 4000
    row = exact_quantiles(df, ["g"], "v", {"med": 0.5, "p90": 0.9, "p95": 0.95}).first()
    assert row[1:] == pytest.approx((0.500001, 0.900001, 0.950001), abs=1e-9)
    # No operator after the first grouping depends on how many values share a millisecond.
    assert exact_quantiles(df.where("false"), ["g"], "v", {"med": 0.5}).collect() == []


def test_bounds(spark, rows):
    pool = spark.range(40, 43).toDF("id")
    df = spark.range(1, 6).toDF("n")
    assert [p for _, p in rows(assign_by_bounds(df, "n", pool, "id", "p"))] == [40, 41, 42, 40, 41]
    assert assign_by_bounds(df, "n", pool.where("false"), "id", "p").count() == 0
