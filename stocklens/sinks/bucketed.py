"""Tables dealt into buckets by key, so that merges and joins on it leave the large side where it is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stocklens.operators.merge import insert_missing, upsert
from stocklens.session import fresh_dir


def write_bucketed(
    df: DataFrame, keys: list[str], buckets: int, name: str | None = None, path: str | None = None, dealt: bool = False
) -> str:
    """Write the rows as a table of ``buckets`` files, one for each bucket of ``keys``; returns its name.

    ``dealt`` says that the rows are in the tasks of their buckets already, as
    after a merge into a table of the same buckets: then nothing is shuffled.
    The table is an external one at ``path``, by default in the shared folder;
    take as many buckets as the largest bucket's size asks for, and at least
    as many as there are tasks at a time.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or fresh_dir(spark, name)
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return name


def layout_of(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """Bucket columns and number of buckets of a table."""
    rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    columns = [c.strip(" `") for c in rows["Bucket Columns"].strip("[]").split(",")]
    return columns, int(rows["Num Buckets"])


def merged(spark: SparkSession, name: str, source: DataFrame, update: list[str] | None = None) -> DataFrame:
    """:func:`upsert` into a bucketed table: the source alone is shuffled, once, into the table's buckets."""
    keys, buckets = layout_of(spark, name)
    return upsert(spark.table(name), source.repartition(buckets, *keys), keys, update)


def upsert_into(
    spark: SparkSession, name: str, source: DataFrame, update: list[str] | None = None, new_name: str | None = None
) -> str:
    """The table of :func:`merged` rows, written as a new one by the tasks that hold them; returns its name.

    Readers keep the old table until they are given the new name.
    """
    return write_bucketed(merged(spark, name, source, update), *layout_of(spark, name), new_name, dealt=True)


def insert_missing_into(spark: SparkSession, name: str, source: DataFrame, order: list[str] | None = None) -> DataFrame:
    """:func:`insert_missing` for a bucketed table, which is read where it lies."""
    return insert_missing(spark.table(name), source, layout_of(spark, name)[0], order=order)
