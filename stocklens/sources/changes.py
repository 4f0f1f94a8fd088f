"""Change messages as rows of ``seq`` (arrival order) and ``value`` (text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_change_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Stream of a Kafka topic. A key's messages share a partition, so the offset orders them.

    Needs the Kafka connector on the class path.
    """
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("offset").alias("seq"), F.col("value").cast("string").alias("value"))


def natural_order(path: Column) -> Column:
    """A text that sorts paths with their numbers by size: every run of digits is filled up to 20 places."""
    filled = F.regexp_replace(path, "([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(filled, "0*([0-9]{20,})(?![0-9])", "$1")


def read_change_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of text files with one message per line, in the order of file time, path and line.

    ``seq`` is the file time, ``file`` the path in its natural order and
    ``block`` where the message's split of the file begins. A file is read in
    as many splits as its size asks for. Lines of one split stay in their
    order within a task, so the place of a row in the file that a sink writes
    orders them; see ``streaming.movements``.
    """
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return raw.select(
        F.unix_millis("_metadata.file_modification_time").alias("seq"),
        natural_order(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )


def stream_parquet(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet table ``name`` in ``folder``, a single file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        raise FileNotFoundError(f"{folder}/{name}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def snapshot_as_changes(table: DataFrame, source_ts_ms: int, name: str = "inventory_movements") -> DataFrame:
    """The rows of a table as the read events that precede its change stream."""
    return table.withColumns(
        {
            "__op": F.lit("r"),
            "__table": F.lit(name),
            "__source_ts_ms": F.lit(source_ts_ms).cast("bigint"),
            "__deleted": F.lit("false"),
        }
    )
