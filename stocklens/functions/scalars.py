"""Scalar expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocklens.schemas import ORDER_STATUSES

# Fixed value: status taken for a missing or unknown one.
DEFAULT_STATUS = "confirmed"


def between(ts: Column, start: object | None, end: object | None) -> Column:
    """Half-open range ``start <= ts < end``; a missing bound does not restrict."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= instant(start))
    if end is not None:
        keep = keep & (ts < instant(end))
    return keep


def instant(value: object) -> Column:
    """A timestamp literal from ISO text, a datetime or a ready column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def day(ts: Column) -> Column:
    return F.to_date(ts)


def days_before(as_of: Column, days: Column) -> Column:
    return as_of - F.make_dt_interval(days)


def order_status(raw: Column) -> Column:
    """The status itself when it is a known one, else the default."""
    return F.when(raw.isin(ORDER_STATUSES), raw).otherwise(DEFAULT_STATUS)


def padded_phone(prefix: str, number: Column) -> Column:
    """``prefix`` and the number right-aligned to five places with blanks, never cut."""
    return F.format_string(prefix + "%5s", number.cast("string"))


def location_label(location_id: Column) -> Column:
    return F.concat(F.lit("Warehouse "), location_id.cast("string"))


def cyclic(n: Column, size: int | Column, first: int | Column = 1) -> Column:
    """``first`` plus the zero-based position of ``n`` in a cycle of ``size``."""
    size = size if isinstance(size, Column) else F.lit(size)
    return (F.pmod(n - 1, size) + first).cast("bigint")


def draw(seed: int, *parts: Column) -> Column:
    """A repeatable 48-bit pseudo-random integer for the given parts."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def clamp_min(value: Column, least: float) -> Column:
    return F.greatest(value, F.lit(least))


def seconds_since(epoch_seconds: Column, as_of: object) -> Column:
    return F.unix_micros(instant(as_of)) / F.lit(1e6) - epoch_seconds
