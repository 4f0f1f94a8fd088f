"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Day buckets and ISO texts are defined in UTC. AQE sizes the shuffles, splits
# skewed join partitions even where that costs one more shuffle, and turns
# joins into broadcasts only on sizes it has measured. A selective side filters
# the other one before the shuffle (Bloom filter).
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}
# Shuffles of tables begin with many partitions, which AQE merges up to the advisory size, and files are read in pieces of
# bounded size: what a task sorts and groups then stays the same when tables grow. Rows of narrow columns take some thirty
# times their compressed size there, so both sizes are below Spark's own.
TABLE_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def configure(spark: SparkSession, tables: bool = True) -> SparkSession:
    """Apply the run-time SQL settings the plans rely on to an existing session; ``tables`` sets the sizes of tasks, too."""
    for key, value in {**SQL_SETTINGS, **(TABLE_SETTINGS if tables else {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "stocklens", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a temporary folder. On a
    cluster a missing setting is an error, because a machine-local folder
    would not be visible to the other machines.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    shared = tempfile.mkdtemp(prefix="stocklens-")
    context.setCheckpointDir(shared)
    return shared


def fresh_dir(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder, in this application's part of it.

    Nothing in there is needed once the application has ended.
    """
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
