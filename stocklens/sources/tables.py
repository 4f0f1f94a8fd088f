"""Scans of tables, metric samples and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocklens import schemas


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A declared table from Parquet; no inference pass over the files."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def load_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {name: load_table(spark, name, f"{base}/{name}") for name in schemas.TABLES}


def load_jdbc_table(
    spark: SparkSession, name: str, url: str, key_range: tuple[int, int], parts: int, **options: str
) -> DataFrame:
    """A declared table from a database, read in ``parts`` ranges of its key."""
    key = schemas.UNIQUE_KEYS[name][0][0]
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=name,
        partitionColumn=key,
        lowerBound=str(key_range[0]),
        upperBound=str(key_range[1]),
        numPartitions=str(parts),
        **options,
    )
    return reader.load()


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SAMPLES).parquet(path)


def load_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.REQUESTS).format(fmt).load(path)


def load_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement statistics exported as CSV with quoted multi-line query texts."""
    reader = spark.read.schema(schemas.STATEMENTS).options(header=True, multiLine=True, escape='"')
    return reader.csv(path)
