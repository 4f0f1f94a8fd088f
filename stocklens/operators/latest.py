"""Newest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Columns that say in which order messages arrived, as far as a source has them.
ARRIVAL = ["seq", "file", "block", "part", "place"]


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values for each key.

    ``order`` has to be total within a key. Catalyst limits each key to one
    row per input partition before the shuffle, so a key holding a large share
    of all rows sends one row per partition, not all of them.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")


def current_rows(changes: DataFrame) -> DataFrame:
    """Current state of a change table: newest version per key, then without deletes.

    Deletes are dropped after the newest version is known; dropping them first
    would bring back older versions.
    """
    arrival = [c for c in ARRIVAL if c in changes.columns]
    newest = latest_per_key(changes, ["inventory_movement_id"], ["version", *arrival])
    return newest.where("is_deleted = 0").drop("is_deleted", *arrival)
