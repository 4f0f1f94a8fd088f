"""Facts in folders by period of time, so that a bounded job opens the files of its periods only.

``period`` is the first day of a row's period. It is a folder of the table and
not part of its files; filters on it are partition filters, and joins on it
let Spark prune the other side's folders while it runs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions.scalars import instant

PERIOD = "period"


def period_of(ts: Column, unit: str) -> Column:
    """First day of the ``unit`` (``day``, ``week``, ``month``, ``quarter`` or ``year``) of a timestamp."""
    return F.to_date(ts) if unit == "day" else F.trunc(ts, unit)


def within(df: DataFrame, start: object | None, end: object | None, unit: str) -> DataFrame:
    """The rows of the periods that ``start <= ts < end`` touches; a missing bound does not restrict."""
    if start is not None:
        df = df.where(F.col(PERIOD) >= period_of(instant(start), unit))
    if end is not None:
        df = df.where(F.col(PERIOD) <= period_of(instant(end), unit))
    return df


def write_periods(df: DataFrame, path: str, sort_by: list[str], mode: str = "append") -> None:
    """Write rows that have a ``period`` column, sorted by ``sort_by`` inside each file.

    Rows are dealt by period, and a period of many rows to several files of a
    good size each, so a hot period is not one task. With ``mode`` overwrite
    the periods that occur are replaced and all others stay as they are.
    """
    spread = df.hint("rebalance", F.col(PERIOD)).sortWithinPartitions(PERIOD, *sort_by)
    writer = spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD)
    writer.parquet(path)


def read_periods(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` with its ``period``; empty before anything was written."""
    whole = f"{schema}, {PERIOD} DATE"
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], whole)
        raise


def touched(*tables: DataFrame) -> list:
    """The periods that occur in the tables. Their number is bounded by the calendar, not by the rows."""
    found: set = set()
    for table in tables:
        found |= {r[0] for r in table.select(PERIOD).distinct().collect()}
    return sorted(found)
