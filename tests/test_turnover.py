import pytest
from pyspark.sql import functions as F

from stocklens.operators.ranking import dense_top_per_group, sample_rows, top_keys
from stocklens.plans.turnover import turnover

MOVES = "warehouse_id BIGINT, product_id BIGINT, movement_type STRING, quantity DECIMAL(14,3), moved_at TIMESTAMP"


@pytest.fixture
def shop(spark):
    def build(moves, places=3, products=30):
        rows = spark.createDataFrame(
            [(w, p, t, str(q), at) for w, p, t, q, at in moves],
            "warehouse_id BIGINT, product_id BIGINT, movement_type STRING, quantity STRING, moved_at STRING",
        )
        return {
            "inventory_movements": rows.select(
                "warehouse_id",
                "product_id",
                "movement_type",
                F.col("quantity").cast("decimal(14,3)").alias("quantity"),
                F.col("moved_at").cast("timestamp").alias("moved_at"),
            ),
            "warehouses": spark.range(1, places + 1).select(
                F.col("id").alias("warehouse_id"), F.format_string("Place %d", "id").alias("warehouse_name")
            ),
            "products": spark.range(1, products + 1).select(
                F.col("id").alias("product_id"), F.format_string("Product %02d", "id").alias("product_name")
            ),
        }

    return build


def test_all_kinds_count_as_positive(shop, rows):
    moves = [
        (1, 1, "receipt", 5, "2021-01-01"),
        (1, 1, "shipment", 3, "2021-01-02"),
        (1, 1, "write_off", 1, "2021-01-03"),
        (1, 1, "adjustment", 0.5, "2021-01-04"),
    ]
    found = rows(turnover(shop(moves)))
    assert len(found) == 1
    assert [float(v) for v in found[0][4:8]] == [5.0, 3.0, 1.5, 9.5]


def test_half_open_range_and_default_bounds(shop, rows):
    moves = [
        (1, 1, "receipt", 1, "2019-12-31 23:59:59"),
        (1, 2, "receipt", 2, "2020-01-01 00:00:00"),
        (1, 3, "receipt", 4, "2020-01-02 00:00:00"),
    ]
    assert {r[0] for r in rows(turnover(shop(moves)), "product_id")} == {2, 3}
    one_day = turnover(shop(moves), "2020-01-01", "2020-01-02")
    assert {r[0] for r in rows(one_day, "product_id")} == {2}


def test_minimum_quantity_is_inclusive(shop, rows):
    moves = [(1, 1, "receipt", 1, "2021-01-01"), (1, 2, "receipt", 0.999, "2021-01-01")]
    assert rows(turnover(shop(moves)), "product_id") == [(1,)]
    assert rows(turnover(shop(moves), min_quantity=0.5), "product_id") == [(1,), (2,)]


def test_ties_share_a_rank_and_all_are_kept(shop, rows):
    moves = [(1, p, "receipt", 7, "2021-01-01") for p in range(1, 16)] + [(1, 20, "receipt", 9, "2021-01-01")]
    found = rows(turnover(shop(moves), top_products=2), "product_rank", "product_id")
    assert found == [(1, 20)] + sorted([(2, p) for p in range(1, 16)], key=repr)


def test_only_the_busiest_locations(shop, rows):
    moves = [(w, 1, "receipt", w, "2021-01-01") for w in (1, 2, 3)]
    assert rows(turnover(shop(moves), top_locations=2), "warehouse_id") == [(2,), (3,)]
    assert rows(turnover(shop(moves), top_locations=None), "warehouse_id") == [(1,), (2,), (3,)]


def test_equal_locations_smaller_id_first(shop, rows):
    moves = [(w, 1, "receipt", 5, "2021-01-01") for w in (3, 2, 1)]
    assert rows(turnover(shop(moves), top_locations=2), "warehouse_id") == [(1,), (2,)]


def test_rows_without_a_product_take_no_rank(shop, rows):
    moves = [(1, 99, "receipt", 50, "2021-01-01"), (1, 2, "receipt", 5, "2021-01-01")]
    assert rows(turnover(shop(moves)), "product_id", "product_rank") == [(2, 1)]


def test_result_is_sorted(shop):
    moves = [(w, p, "receipt", p, "2021-01-01") for w in (1, 2) for p in range(1, 13)]
    found = [(r.warehouse_name, r.product_rank, r.product_name) for r in turnover(shop(moves)).collect()]
    assert found == sorted(found) and len(found) == 20


def test_hot_location_agrees_with_a_window(spark, rows):
    from pyspark.sql import Window

    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 1013).alias("m")
    )
    plain = df.withColumn("r", F.dense_rank().over(Window.partitionBy("g").orderBy(F.desc("m")))).where("r <= 10")
    assert rows(dense_top_per_group(df, "g", "m", 10, "r"), "g", "m", "r") == rows(plain, "g", "m", "r")
    assert rows(dense_top_per_group(df, "g", "m", 10, "r", max_groups=50), "g", "m", "r") == rows(plain, "g", "m", "r")


def test_top_keys_and_samples_repeat(spark, rows):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    assert [r.k for r in top_keys(df, "k", "v", 3).collect()] == [9, 8, 7]
    once, again = rows(sample_rows(df, "v", 20, 1)), rows(sample_rows(df.repartition(7), "v", 20, 1))
    assert once == again and len(once) == 20
    assert once != rows(sample_rows(df, "v", 20, 2))
