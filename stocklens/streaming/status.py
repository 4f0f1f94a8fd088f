"""Status commands as a stream over a fixed table of orders.

The state store holds each order's last status and the number of its commands,
so a batch touches the orders it names and nothing else: neither the table of
orders nor what earlier batches wrote is read again. Each command becomes one
step in an append-only log. What an order's first step replaces is the stored
status; it is joined when steps are read, where unknown orders fall out too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stocklens.functions.scalars import instant
from stocklens.operators.latest import latest_per_key
from stocklens.plans.orders import CHANGED_NOTE, DEFAULT_SOURCE, LOG_SOURCE, normalized
from stocklens.streaming import log

STEP = "customer_order_id BIGINT, seq BIGINT, step BIGINT, old_status STRING, new_status STRING"
STEPS = f"{STEP}, changed_at TIMESTAMP, source STRING"
KEY = ["customer_order_id"]
STATE = "status STRING, steps BIGINT"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stepper() -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state function. It is made here so that it goes to the executors as it is, which then need pandas alone."""

    def next_steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The commands of one order in a batch along ``seq``, after those of earlier batches."""
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        status, steps = state.get if state.exists else (None, 0)
        new = rows["status"].tolist()
        state.update((new[-1], steps + len(new)))
        yield pd.DataFrame(
            {
                "customer_order_id": rows["customer_order_id"].to_numpy(),
                "seq": rows["seq"].to_numpy(),
                "step": range(steps + 1, steps + len(new) + 1),
                "old_status": [status, *new[:-1]],
                "new_status": new,
            }
        )

    return next_steps


def run_status_stream(
    commands: DataFrame,
    path: str,
    checkpoint: str,
    as_of: object,
    source: str | None = None,
    log_only: bool = False,
    once: bool = True,
) -> StreamingQuery:
    """Apply a stream of ``(customer_order_id, status, seq)`` commands, whose ``seq`` is unique.

    Commands of a batch follow those of earlier batches, and each other along
    ``seq``. An order's commands of one batch meet in one task, so the batch
    size of the source bounds them. ``log_only`` leaves the orders alone: every
    step starts from the stored status, which needs no state.
    """
    named = normalized(commands.where("customer_order_id IS NOT NULL"))
    if log_only:
        none = F.lit(None)
        steps = named.select(*KEY, "seq", none.cast("bigint").alias("step"), none.cast("string").alias("old_status"),
                             F.col("status").alias("new_status"))
    else:
        # RocksDB keeps states on disk, so their number is not bounded by memory.
        commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        steps = named.groupBy(*KEY).applyInPandasWithState(
            stepper(), STEP, STATE, "append", GroupStateTimeout.NoTimeout
        )
    label = source or (LOG_SOURCE if log_only else DEFAULT_SOURCE)
    rows = steps.withColumns({"changed_at": instant(as_of), "source": F.lit(label)})
    return log.start_log(rows, path, checkpoint, once)


def written_steps(spark: SparkSession, path: str) -> DataFrame:
    return log.committed(spark, path, STEPS)


def known_steps(orders: DataFrame, path: str) -> DataFrame:
    """All steps of known orders, each with the status it replaces."""
    stored = orders.select(*KEY, F.col("status").alias("_stored"))
    steps = written_steps(orders.sparkSession, path).join(stored, KEY)
    return steps.withColumn("old_status", F.coalesce("old_status", "_stored")).drop("_stored")


def read_events(orders: DataFrame, path: str) -> DataFrame:
    """One event per command of a known order; its id is the command's ``seq``."""
    return known_steps(orders, path).select(
        F.col("seq").alias("order_status_event_id"),
        *KEY,
        "old_status",
        "new_status",
        F.col("source").alias("event_source"),
        F.col("changed_at").alias("created_at"),
    )


def read_notes(orders: DataFrame, path: str) -> DataFrame:
    """One note per command of a known order that was applied."""
    parts = CHANGED_NOTE.split("{source}")
    text = F.concat(F.format_string(parts[0], "old_status", "new_status"), F.col("source"), F.lit(parts[1]))
    return known_steps(orders, path).where("step IS NOT NULL").select(
        F.col("seq").alias("audit_note_id"),
        *KEY,
        F.lit("status").alias("note_type"),
        text.alias("note_text"),
        F.col("changed_at").alias("created_at"),
    )


def last_steps(spark: SparkSession, path: str) -> DataFrame:
    """The last applied step of each order the stream named."""
    steps = written_steps(spark, path).where("step IS NOT NULL")
    return latest_per_key(log.since_base(steps, path), KEY, ["step"])


def current_orders(orders: DataFrame, path: str) -> DataFrame:
    """The orders after all finished batches."""
    last = last_steps(orders.sparkSession, path)
    new = last.select(*KEY, F.col("new_status").alias("_new"), F.col("changed_at").alias("_changed_at"))
    return (
        orders.join(new, KEY, "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .withColumn("last_status_changed_at", F.coalesce("_changed_at", "last_status_changed_at"))
        .select(*orders.columns)
    )


def compact_steps(spark: SparkSession, path: str) -> int:
    """Fold the steps into the last one of each order, for readers of the current orders."""
    return log.compact(written_steps(spark, path).where("step IS NOT NULL"), path, KEY, ["step"])
