"""Integer series and inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def series(spark: SparkSession, n: int, name: str = "n") -> DataFrame:
    """The integers 1 to ``n``, made where they are used."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def grid(spark: SparkSession, orders: int, lines: int) -> DataFrame:
    """Every pair of 1..``orders`` and 1..``lines``, without a join."""
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(lines).cast("bigint")))
    return series(spark, orders, "order_n").select("order_n", each.alias("line_n"))


def inline_rows(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")
