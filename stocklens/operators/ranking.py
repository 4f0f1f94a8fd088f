"""Top keys, ranks within groups, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions.scalars import draw


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows; each task keeps ``n`` and the driver merges those."""
    return df.orderBy(*order).limit(n)


def top_keys(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The ``n`` keys with the greatest sum, smaller key first among equals."""
    totals = df.groupBy(key).agg(F.sum(measure).alias("total_quantity"))
    return top_by(totals, [F.desc("total_quantity"), F.asc(key)], n)


# Tables counted or known to have at most this many rows may be sent to every
# task; rank rows (a key, a number and a rank) are narrow, so more of them may.
BROADCAST_ROWS = 100_000
BROADCAST_RANKS = 200_000


def dense_top_per_group(
    df: DataFrame, group: str, measure: str, n: int, rank: str, max_groups: int | None = None
) -> DataFrame:
    """Rows whose ``measure`` is among the ``n`` greatest distinct ones of their group.

    Equal values share a rank, so a group may return more than ``n`` rows. Only
    distinct values are ranked, at most ``n`` per group and input partition
    reach the ranking task, and the ranks are joined back: a large group, or a
    group of many equal values, is never gathered in one place. ``max_groups``
    states a known limit on the number of groups; with it the rank table has at
    most ``n`` times as many rows and is broadcast when that is small.
    """
    places = Window.partitionBy(group).orderBy(F.desc(measure))
    ranks = (
        df.select(group, measure)
        .distinct()
        .withColumn(rank, F.dense_rank().over(places))
        .where(F.col(rank) <= n)
    )
    if max_groups is not None and max_groups * n <= BROADCAST_RANKS:
        ranks = F.broadcast(ranks)
    return df.join(ranks, [group, measure])


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows in an order drawn from ``seed``."""
    return top_by(df, [draw(seed, F.col(key)), F.col(key)], k)
