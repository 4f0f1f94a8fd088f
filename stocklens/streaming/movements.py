"""Change stream to current stock movements.

The stream only appends: every message becomes one row of a log, a typed change
or a rejected text, so both are seen at the same moment. The current state is
worked out when it is read, so late and repeated messages need no special care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stocklens.functions.changes import sorted_out
from stocklens.operators.latest import ARRIVAL, current_rows
from stocklens.streaming import log

LOG = (
    "seq BIGINT, file STRING, block BIGINT, inventory_movement_id BIGINT, product_id BIGINT, warehouse_id BIGINT, "
    "movement_type STRING, quantity DECIMAL(14,3), moved_at TIMESTAMP, employee_id BIGINT, cdc_op STRING, "
    "cdc_source_ts_ms BIGINT, version BIGINT, is_deleted INT, value STRING"
)
KEY = ["inventory_movement_id"]
ORDER = ["version", *ARRIVAL]


def load_changes(
    messages: DataFrame, path: str, checkpoint: str, ingest_ms: int | None = None, once: bool = True
) -> StreamingQuery:
    """Start loading ``(seq, value)`` messages below ``path``; a bad message becomes a row with its text.

    ``once`` stops after everything available was read. The clock, when used
    as the version, is that of the batch in the stream's own log, so a repeated
    batch gets the same versions.
    """
    return log.start_log(sorted_out(messages, ingest_ms), path, checkpoint, once)


def loaded_changes(spark: SparkSession, path: str) -> DataFrame:
    return log.committed(spark, path, LOG).where("inventory_movement_id IS NOT NULL").drop("value")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions that still matter: the compacted base and what was loaded since."""
    return log.since_base(loaded_changes(spark, path), path)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """Current stock movements."""
    return current_rows(read_versions(spark, path)).drop("loaded_at")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Messages without a readable key, as they came."""
    rows = log.committed(spark, path, LOG).where("inventory_movement_id IS NULL")
    return rows.select(*ARRIVAL, "loaded_at", "value")


def compact(spark: SparkSession, path: str) -> int:
    """Fold versions into one per key. Delete marks stay, so that a late older
    version of a deleted key still loses."""
    return log.compact(loaded_changes(spark, path), path, KEY, ORDER)
