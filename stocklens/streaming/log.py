"""Append-only logs of streams: Spark's file sink for writing, one compacted base besides.

A batch's rows are seen all at once, when the sink's own log names its files,
or not at all; files of an attempt that died are never named. From time to
time the rows so far are folded into a base table with one row per key, and
readers need the base and what was loaded since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stocklens.operators.latest import latest_per_key
from stocklens.sinks.versioned import newest, publish, read_if_there, read_version

# Rows stamped this long before the newest folded one are read again, since the clocks that stamp batches can differ.
OVERLAP_MS = 3_600_000


def start_log(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start appending a stream's rows below ``path``, stamped with their batch's time (``loaded_at``).

    ``once`` stops after everything available was read.
    """
    stamped = rows.withColumn("loaded_at", F.current_timestamp())
    writer = stamped.writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of finished batches.

    ``part`` and ``place`` say where a row stands in the log's files. A task
    writes rows as it has read them, so they order the rows of one split.
    """
    schema = f"{schema}, loaded_at TIMESTAMP"
    rows = read_if_there(spark, f"{path}/log", schema)
    if rows is None:
        return spark.createDataFrame([], f"{schema}, part STRING, place BIGINT")
    return rows.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("place"))


def since_base(rows: DataFrame, path: str) -> DataFrame:
    """The compacted base, if there is one, and the committed rows since; some rows can be there twice."""
    version, upto_ms = newest(rows.sparkSession, f"{path}/base")
    if version == 0:
        return rows
    later = rows.where(F.col("loaded_at") > F.timestamp_millis(F.lit(upto_ms - OVERLAP_MS)))
    return read_version(rows.sparkSession, f"{path}/base", version).unionByName(later)


def compact(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Fold committed ``rows`` into one per key, the last by ``order``; returns the version of the base.

    Folding rows again changes nothing, and neither does a repeat without new batches.
    """
    last = rows.agg(F.unix_millis(F.max("loaded_at"))).first()[0]
    if last is None:
        return newest(rows.sparkSession, f"{path}/base")[0]
    return publish(latest_per_key(since_base(rows, path), keys, order), f"{path}/base", batch_id=last)
