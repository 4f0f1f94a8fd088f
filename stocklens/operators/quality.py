"""Checks that stand in for the constraints a Parquet table does not enforce."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stocklens import schemas
from stocklens.operators.merge import item_totals


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Referenced values without a parent row, with the number of child rows.

    The child is reduced to distinct values first, so a value shared by many
    rows is one row when it meets the parent.
    """
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("child_rows"))
    known = parent.select(F.col(parent_column).alias(column))
    return used.join(known, column, "left_anti")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULLs per column, one row each, from one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in columns])
    return counted.select(F.inline(pairs))


def outside_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values that are not allowed, with the number of rows."""
    bad = df.where(~F.col(column).isin(allowed))
    return bad.groupBy(F.col(column).alias("bad_value")).agg(F.count(F.lit(1)).alias("row_count"))


def wrong_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose stored totals differ from those of their lines."""
    found = item_totals(items).select(
        "customer_order_id", F.col("total_amount").alias("line_amount"), F.col("items_count").alias("line_count")
    )
    both = orders.select("customer_order_id", "total_amount", "items_count").join(
        found, "customer_order_id", "left"
    )
    amount = F.coalesce("line_amount", F.lit(0).cast("decimal(14,2)"))
    count = F.coalesce("line_count", F.lit(0))
    same = F.col("total_amount").eqNullSafe(amount) & F.col("items_count").eqNullSafe(count)
    return both.where(~same).select(
        "customer_order_id",
        "total_amount",
        amount.alias("line_amount"),
        "items_count",
        count.alias("line_count"),
    )


def reconcile(source: DataFrame, sink: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on which two tables disagree: missing on a side, or different."""
    left = source.select(key, F.struct(*columns).alias("_left"))
    right = sink.select(key, F.struct(*columns).alias("_right"))
    both = left.join(right, key, "full")
    verdict = (
        F.when(F.col("_right").isNull(), "missing_in_sink")
        .when(F.col("_left").isNull(), "missing_in_source")
        .when(~F.col("_left").eqNullSafe(F.col("_right")), "different")
    )
    return both.select(key, verdict.alias("difference")).where("difference IS NOT NULL")


def row_checks(df: DataFrame, table: str) -> list[tuple[str, str, Column]]:
    """The declared checks that a row alone decides: kind, subject, and the number of rows that fail.

    Columns that the table at hand does not have are not checked.
    """
    checks = []
    for column in schemas.required_columns(table):
        if column in df.columns:
            checks.append(("not_null", column, F.count_if(F.col(column).isNull())))
    for (of, column), allowed in schemas.DOMAINS.items():
        if of == table and column in df.columns:
            checks.append(("domain", column, F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(allowed))))
    return checks


def watched(df: DataFrame, table: str) -> tuple[DataFrame, Callable[[], dict[tuple[str, str], int]]]:
    """The rows as they are, and what their checks have counted once a job has read them.

    The counts come with that job: no scan of their own. They are of the first
    job that reads all rows; it has to have ended when they are asked for.
    """
    checks = row_checks(df, table)
    seen = Observation()
    rows = df.observe(seen, *[count.alias(f"{kind} {subject}") for kind, subject, count in checks])
    return rows, lambda: {(kind, subject): seen.get[f"{kind} {subject}"] for kind, subject, _ in checks}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared constraint that can be checked on the given tables, with its count.

    A table is read once for everything its rows decide alone, and once for
    each of its keys and references.
    """
    found: list[DataFrame] = []
    shape = ["check_kind", "table_name", "subject", "violations"]

    def add(kind: str, table: str, subject: str, counted: DataFrame) -> None:
        rows = F.coalesce(F.col(counted.columns[0]), F.lit(0)).cast("bigint")
        named = [F.lit(kind), F.lit(table), F.lit(subject), rows]
        found.append(counted.select(*[c.alias(n) for c, n in zip(named, shape, strict=True)]))

    for table, df in tables.items():
        for keys in schemas.UNIQUE_KEYS[table]:
            if set(keys) <= set(df.columns):
                add("unique", table, ",".join(keys), duplicate_keys(df, keys).agg(F.count(F.lit(1))))
        checks = row_checks(df, table)
        if checks:
            counted = df.agg(*[count.alias(f"c{i}") for i, (_, _, count) in enumerate(checks)])
            named = [
                F.struct(F.lit(kind).alias("check_kind"), F.lit(table).alias("table_name"), F.lit(subject).alias("subject"),
                         F.col(f"c{i}").alias("violations"))
                for i, (kind, subject, _) in enumerate(checks)
            ]
            found.append(counted.select(F.inline(F.array(*named))))
    for child, column, parent, parent_column in schemas.REFERENCES:
        if child in tables and parent in tables and column in tables[child].columns:
            bad = orphans(tables[child], column, tables[parent], parent_column)
            add("reference", child, column, bad.agg(F.sum("child_rows")))
    return reduce(DataFrame.unionByName, found)
