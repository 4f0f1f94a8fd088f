"""Parsing of flat and enveloped change messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flat message of one stock movement; everything is read as text first so that
# one bad field does not void the whole message.
MESSAGE_FIELDS = [
    "inventory_movement_id",
    "product_id",
    "warehouse_id",
    "movement_type",
    "quantity",
    "moved_at",
    "employee_id",
    "__op",
    "__table",
    "__source_ts_ms",
    "__deleted",
]
MESSAGE_SCHEMA = ", ".join(f"`{name}` STRING" for name in MESSAGE_FIELDS)


def integer_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def quantity_or_zero(text: Column) -> Column:
    """Three decimals; further digits are cut, not rounded, and bad text is 0."""
    cut = F.regexp_replace(text, r"^([+-]?[0-9]*\.[0-9]{3})[0-9]+$", "$1")
    return F.coalesce(cut.try_cast("decimal(14,3)"), F.lit(0).cast("decimal(14,3)"))


def millis_or_null(text: Column) -> Column:
    """ISO text to a timestamp cut to milliseconds; NULL when unreadable."""
    return F.date_trunc("millisecond", F.try_to_timestamp(text))


def truth_flag(text: Column) -> Column:
    return F.lower(text).eqNullSafe(F.lit("true")).cast("int")


def rows_where(df: DataFrame, kept: list[str], condition: Column, row: Column, present: str) -> DataFrame:
    """``kept`` and the fields of ``row``, for rows that meet the condition.

    A plain filter would be moved below the projection that parses the text
    and parse it a second time. The outer generator stays where it is, and
    the filter behind it looks at ``present``, a field that is never NULL in a row.
    """
    made = df.select(*kept, F.inline_outer(F.when(condition, F.array(row))))
    return made.where(F.col(present).isNotNull())


def ingest_time(ingest_ms: Column | int | None) -> Column:
    if ingest_ms is None:
        return F.unix_millis(F.current_timestamp())
    return F.lit(ingest_ms).cast("bigint") if isinstance(ingest_ms, int) else ingest_ms


def change_row(text: dict[str, Column], ingest_ms: Column) -> tuple[Column, Column]:
    """The key and the typed row of a message whose fields are given as text."""
    key = integer_or_zero(text["inventory_movement_id"])
    source_ms = integer_or_zero(text["__source_ts_ms"])
    row = F.struct(
        key.alias("inventory_movement_id"),
        integer_or_zero(text["product_id"]).alias("product_id"),
        integer_or_zero(text["warehouse_id"]).alias("warehouse_id"),
        F.coalesce(text["movement_type"], F.lit("")).alias("movement_type"),
        quantity_or_zero(text["quantity"]).alias("quantity"),
        millis_or_null(text["moved_at"]).alias("moved_at"),
        integer_or_zero(text["employee_id"]).alias("employee_id"),
        F.coalesce(text["__op"], F.lit("")).alias("cdc_op"),
        source_ms.alias("cdc_source_ts_ms"),
        F.greatest(source_ms, ingest_ms).alias("version"),
        truth_flag(text["__deleted"]).alias("is_deleted"),
    )
    return key, row


def typed_changes(rows: DataFrame, ingest_ms: Column | int | None = None) -> DataFrame:
    """Typed change rows from the fields of a flat message.

    ``version`` is the later of source and ingest time; ``ingest_ms=0`` gives
    pure source order, ``None`` takes the clock. Rows without a positive key
    are left out. Columns that are not message fields (such as ``seq``) are kept.
    """
    kept = [c for c in rows.columns if c not in MESSAGE_FIELDS]
    text = {name: F.col(name).cast("string") for name in MESSAGE_FIELDS}
    key, row = change_row(text, ingest_time(ingest_ms))
    return rows_where(rows, kept, key > 0, row, "inventory_movement_id")


def parse_changes(messages: DataFrame, ingest_ms: Column | int | None = None) -> DataFrame:
    """Typed change rows from messages with a ``value`` text column.

    Messages that are not JSON have no key and are left out with those.
    """
    kept = [c for c in messages.columns if c != "value"]
    rows = messages.select(*kept, F.from_json("value", MESSAGE_SCHEMA).alias("m")).select(*kept, "m.*")
    return typed_changes(rows, ingest_ms)


def sorted_out(messages: DataFrame, ingest_ms: Column | int | None = None) -> DataFrame:
    """Every message, parsed once: as a typed change, or without one and with its text in ``value``."""
    kept = [c for c in messages.columns if c != "value"]
    read = messages.select(*kept, "value", F.from_json("value", MESSAGE_SCHEMA).alias("m"))
    key, row = change_row({name: F.col("m")[name] for name in MESSAGE_FIELDS}, ingest_time(ingest_ms))
    rows = read.select(*kept, "value", F.inline_outer(F.when(key > 0, F.array(row))))
    return rows.withColumn("value", F.when(F.col("inventory_movement_id").isNull(), F.col("value")))


def unreadable_changes(messages: DataFrame) -> DataFrame:
    """The messages :func:`parse_changes` leaves out, as they arrived."""
    body = F.from_json("value", MESSAGE_SCHEMA)
    return messages.where(integer_or_zero(body["inventory_movement_id"]) <= 0)


def flatten_envelope(messages: DataFrame, row_schema: str, table: str | None = None) -> DataFrame:
    """Flat messages from change envelopes ``{before, after, source, op}``.

    The row is ``after``, or ``before`` for deletes, which stay as rows marked
    ``__deleted``. Messages with no value are dropped. ``table`` keeps the
    changes of one source table.
    """
    envelope = (
        f"before STRUCT<{row_schema}>, after STRUCT<{row_schema}>, "
        "source STRUCT<`table`: STRING, ts_ms: BIGINT>, op STRING"
    )
    kept = [c for c in messages.columns if c != "value"]
    read = messages.where("value IS NOT NULL").select(*kept, F.from_json("value", envelope).alias("e"))
    deleted = F.col("e.op") == "d"
    wanted = F.col("e.op").isNotNull()
    if table is not None:
        wanted = wanted & (F.col("e.source.table") == table)
    row = F.struct(
        F.when(deleted, F.col("e.before")).otherwise(F.col("e.after")).alias("r"),
        F.col("e.op").alias("__op"),
        F.col("e.source.table").alias("__table"),
        F.col("e.source.ts_ms").alias("__source_ts_ms"),
        F.when(deleted, "true").otherwise("false").alias("__deleted"),
    )
    rows = rows_where(read, kept, wanted, row, "__op")
    return rows.select(*kept, "r.*", "__op", "__table", "__source_ts_ms", "__deleted")


def to_messages(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows back to one JSON text each, with the columns in ``keep`` beside it."""
    keep = keep or []
    fields = [c for c in rows.columns if c not in keep]
    return rows.select(*keep, F.to_json(F.struct(*fields)).alias("value"))
