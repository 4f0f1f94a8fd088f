"""Quality rules as a short-circuit cascade in an order of rejections per cost. DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.shared import discard, prepare, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
SAMPLE_ROWS = 2000


@dataclass
class Rule:
    """``fails`` says of a row with :func:`measures` whether the rule rejects it."""

    name: str
    fails: Column


def occurrences(characters: str) -> Column:
    return F.length("_text") - F.length(F.translate("_text", characters, ""))


def standard_rules() -> list[Rule]:
    n_words = F.col("n_words")
    return [
        Rule("few words", n_words < 20),
        Rule("repeated words", 100 * F.col("n_repeat_words") > 30 * n_words),
        Rule("symbols", 100 * F.col("n_symbols") > 30 * n_words),
        Rule("repeated lines", (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.size("_lines"))),
        Rule("word length", (F.col("word_chars") < 2 * n_words) | (F.col("word_chars") > 40 * n_words)),
        Rule("capitals", 100 * occurrences(CAPITALS) > 50 * F.col("word_chars")),
        Rule("exclamations", 100 * occurrences("!") > 50 * n_words),
    ]


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``_text`` with the word, symbol and repetition counts of each row.

    Words are runs of anything but ASCII white space; null has none.
    ``n_dup_lines`` counts lines with a word that equal an earlier line, and
    ``n_repeat_words`` the words inside runs of ``WINDOW`` words that occur
    twice or more in the text, the first time included. Each step names its
    arrays, so that none is made anew for each of its elements.
    """
    spaces = " " * (len(BLANKS) - 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("*", F.translate("_text", BLANKS[1:], spaces).alias("_flat"))
    rows = rows.select(
        "doc_id",
        "_text",
        F.filter(F.split("_flat", " +"), lambda w: w != "").alias("_words"),
        F.filter(
            F.split("_text", "\n"), lambda line: F.trim(F.translate(line, BLANKS[1:], spaces)) != ""
        ).alias("_lines"),
        occurrences(SYMBOLS).cast("bigint").alias("n_symbols"),
        F.length(F.translate("_text", BLANKS, "")).cast("bigint").alias("word_chars"),
    )
    runs = F.transform(
        F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))
    )
    rows = rows.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, runs).otherwise(F.array().cast("array<bigint>")).alias("_runs"),
    ).drop("_words")
    ordered = F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    unique = F.size("_runs") == F.size(F.array_distinct("_runs"))
    rows = rows.select("*", F.when(~unique, ordered).alias("_ordered")).drop("_runs")
    again = F.transform(
        "_ordered",
        lambda x, i: F.when(
            (F.get("_ordered", i - 1)["hash"] == x["hash"]) | (F.get("_ordered", i + 1)["hash"] == x["hash"]), x["at"]
        ),
    )
    rows = rows.select("*", F.sort_array(F.array_compact(again)).alias("_again")).drop("_ordered")
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda sofar, at: F.struct(
            (sofar["words"] + at + WINDOW - F.greatest(sofar["end"], at)).alias("words"),
            (at + WINDOW).alias("end"),
        ),
        lambda done: done["words"],
    )
    return rows.select("*", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")).drop("_again")


def rule_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by falling share of rejected sample rows per second; ties keep their place."""

    def seconds(column: Column) -> tuple[float, int]:
        query, taken = sample.agg(F.count(F.lit(1)).alias("rows"), F.count_if(column).alias("failed")), []
        for _ in range(2):
            begin = time.perf_counter()
            row = query.first()
            taken.append(time.perf_counter() - begin)
        return min(taken), row.failed

    floor, _ = seconds(F.col("n_words") < 0)
    worth = {}
    for rule in rules:
        cost, failed = seconds(rule.fails)
        worth[rule.name] = failed / max(cost - floor, 1e-3)
    return sorted(rules, key=lambda rule: -worth[rule.name])


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The :func:`measures` of each row with ``rejected_by``, the first rule in the chosen order that fails, or null.

    Cost and selectivity of the rules come from about ``sample_rows`` rows;
    they decide the order alone, so which rows are rejected does not depend on
    them. The rules are branches of one CASE: behind the first one that fails
    nothing is evaluated. Each row is judged by itself, repeated rows alike;
    an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = docs.count()
    sample = written(measures(docs.sample(min(1.0, sample_rows / max(rows, 1)), seed=7)), "sample")
    ordered = rule_order(sample, standard_rules() if rules is None else rules)
    discard(sample)
    first = F.lit(None).cast("string")
    for rule in reversed(ordered):
        first = F.when(rule.fails, F.lit(rule.name)).otherwise(first)
    return measures(docs).withColumn("rejected_by", first)


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` of each row of ``docs`` (``doc_id``, ``text``)."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & F.col("rejected_by").isNull()).alias("kept"),
    )
