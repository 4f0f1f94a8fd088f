"""Predicates on metric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(labels: Column, name: str) -> Column:
    """A label's value; a missing label reads as the empty string."""
    return F.coalesce(labels[name], F.lit(""))


def label_is(labels: Column, name: str, value: str) -> Column:
    return label(labels, name) == value


def label_like(labels: Column, name: str, pattern: str) -> Column:
    """Whole-value regular expression match."""
    return label(labels, name).rlike(f"^(?:{pattern})$")


def label_unlike(labels: Column, name: str, pattern: str) -> Column:
    return ~label_like(labels, name, pattern)


def series_key(labels: Column) -> Column:
    """Label set in a form that can be grouped and joined on."""
    return F.array_sort(F.map_entries(labels))
