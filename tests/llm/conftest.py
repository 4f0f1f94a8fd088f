from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns named like the operators' own."""

    def make(rows, extra="row string, spans string, n_words string"):
        whole = [(i, t, None, "s", None if t is None else len(t), "x", None, "y") for i, t in rows]
        return spark.createDataFrame(whole, f"{DOCS}, {extra}")

    return make


@pytest.fixture
def small(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
