"""Whole-table versions on plain Parquet.

A version is a directory that is written completely and then named in a small
ledger. Readers look the newest version up once and never see a partly written
one; a version whose job died is not in the ledger and is written again.
One writer per table is assumed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "version BIGINT, batch_id BIGINT"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newest(spark: SparkSession, path: str) -> tuple[int, int | None]:
    """Newest version (0 when there is none) and the batch it was written for."""
    ledger = read_if_there(spark, f"{path}/ledger", LEDGER)
    if ledger is None:
        return 0, None
    row = ledger.agg(F.max(F.struct("version", "batch_id")).alias("top")).first()
    return (row.top.version, row.top.batch_id) if row.top else (0, None)


def publish(df: DataFrame, path: str, batch_id: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write a new version and switch readers to it; returns its number.

    A ``batch_id`` that is not newer than the published one is a repeat and
    writes nothing.
    """
    spark = df.sparkSession
    version, done = newest(spark, path)
    if batch_id is not None and done is not None and batch_id <= done:
        return version
    version += 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/v{version}")
    entry = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.lit(batch_id).cast("bigint").alias("batch_id")
    )
    entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest (or the given) version."""
    version = newest(spark, path)[0] if version is None else version
    if version == 0:
        raise FileNotFoundError(f"no version has been published at {path}")
    return spark.read.parquet(f"{path}/v{version}")


def refresh(path: str, spark: SparkSession, rebuild) -> int | None:
    """Publish ``rebuild()`` as the next version; None when the table was never built."""
    if newest(spark, path)[0] == 0:
        return None
    return publish(rebuild(), path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a value are doubled."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
