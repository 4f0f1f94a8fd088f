"""Session settings and written intermediates of the text operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.session import configure, fresh_dir

# Arrow batches to Python are bounded by bytes as well as rows, since one text may be very long.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """The run-time settings that the operators rely on."""
    configure(spark, tables=False)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read from there.

    Cuts the lineage: whatever executor is lost later, the rows stay as they were.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again


def some_rows(df: DataFrame, rows: int) -> list:
    """At most ``rows`` rows in the order of a hash over all columns; equal rows are counted apart.

    The hashes alone are sorted, so that no task sends more rows than are chosen.
    """
    mark = F.xxhash64(*df.columns)
    last = df.select(mark.alias("mark")).orderBy("mark").limit(rows).agg(F.max("mark")).first()[0]
    if last is None:
        return []
    chosen = df.select("*", mark.alias("mark")).where(F.col("mark") <= last).limit(rows).collect()
    return sorted(chosen, key=lambda r: r.mark)


def narrow(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table, marked to be sent to all executors if it has at most ``rows`` rows; else it is joined by key."""
    return F.broadcast(table) if table.count() <= rows else table


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished work, which it does when the driver's collector finds them unused."""
    gc.collect()
    spark._jvm.System.gc()
