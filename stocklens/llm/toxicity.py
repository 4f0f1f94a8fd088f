"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.shared import prepare

# Rows of each label that are learned from, and how long they may be: this bounds what comes to the driver.
SAMPLE_ROWS = 2500
SAMPLE_CHARS = 20_000
# Lengths of the word beginnings that can become lexicon entries.
BEGINNINGS = range(3, 11)
MOST_TERMS = 500
LEAST_DOCS = 3
LEAST_LOG_ODDS = 2.0
TOXIC_FROM = 0.7

# Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʟ": "l", "ո": "n",
    "ս": "u", "օ": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

# Harmless uses of words that are insults elsewhere.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "circus clown", "pond scum",
    "soap scum", "sore loser", "pathetic fallacy",
)

# Signs stand for letters only in front of a letter; "!!" at the end of a word does not.
_SIGNS = re.compile(r"[013457@$!]+(?=[^\W\d_])")
_SIGN_LETTERS = str.maketrans(SIGNS)
_FOLD = {i: " " for i in range(128) if not chr(i).isalpha()}
_FOLD |= {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters


def fold(text: str) -> str:
    """The text in lower case with look-alikes as Latin letters and ASCII non-letters as blanks, blanks around it."""
    text = _SIGNS.sub(lambda m: m[0].translate(_SIGN_LETTERS), text.lower())
    return f" {text.translate(_FOLD)} "


@dataclass
class Model:
    terms: dict[str, float]  # " word " or " beginning" to its weight
    coefficients: np.ndarray
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            folded = " ".join(fold(phrase).split())
            found.add_word(f" {folded} ", (len(folded) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def hits(folded: str, automaton: ahocorasick.Automaton) -> float:
    """The sum over all words hit of the greatest weight matched there, without words inside an exception."""
    if not len(automaton):
        return 0.0
    by_start, free = {}, []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            free.append((start, end))
        else:
            by_start[start] = max(weight, by_start.get(start, 0.0))
    if free:
        by_start = {s: w for s, w in by_start.items() if not any(a <= s < b for a, b in free)}
    return sum(by_start.values())


def inputs(folded: str, automaton: ahocorasick.Automaton) -> list[float]:
    """1, the weight hit, and the weight hit per root of the number of words: what the score is made of."""
    total = hits(folded, automaton)
    words = len(folded.split())
    return [1.0, np.log1p(total), total / np.sqrt(words + 10.0)]


def learn_terms(toxic: list[str], clean: list[str], toxic_share: float) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with their log odds as weights."""

    def document_counts(texts: list[str]) -> Counter:
        counts: Counter = Counter()
        for text in texts:
            words = set(text.split())
            terms = {f" {w} " for w in words}
            terms.update(f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n)
            counts.update(terms)
        return counts

    bad, good = document_counts(toxic), document_counts(clean)
    scored = []
    for term, n in bad.items():
        if n >= LEAST_DOCS:
            odds = np.log((n + 0.5) / (len(toxic) + 1)) - np.log((good[term] + 0.5) / (len(clean) + 1))
            error = np.sqrt(1 / (n + 0.5) + 1 / (good[term] + 0.5))
            if odds >= LEAST_LOG_ODDS and odds > 1.6 * error:
                scored.append((odds * np.log1p(n), odds, term))
    terms: dict[str, float] = {}
    for _, odds, term in sorted(scored, key=lambda x: (-x[0], len(x[2]), x[2])):
        # A beginning that is chosen already speaks for all longer ones.
        if not any(term[:n] in terms for n in range(2, len(term))):
            terms[term] = float(odds)
        if len(terms) == MOST_TERMS:
            break
    return terms


def fit(toxic: list[str], clean: list[str], toxic_share: float, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon from one half of the texts, the score's coefficients from the other half; few texts serve for both.

    ``toxic_share`` is the share of label 1 among all labelled rows, to which
    the classes are weighted.
    """
    toxic, clean = [fold(t) for t in toxic], [fold(t) for t in clean]
    enough = min(len(toxic), len(clean)) >= 200
    terms = learn_terms(toxic[::2] if enough else toxic, clean[::2] if enough else clean, toxic_share)
    model = Model(terms, np.zeros(3), exceptions)
    if not toxic or not clean:
        model.coefficients = np.array([4.0 if toxic else -4.0, 0.0, 0.0])
        return model
    automaton = model.automaton()
    bad, good = (toxic[1::2], clean[1::2]) if enough else (toxic, clean)
    x = np.array([inputs(t, automaton) for t in [*bad, *good]])
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))]
    weight = np.r_[np.full(len(bad), toxic_share / len(bad)), np.full(len(good), (1 - toxic_share) / len(good))]
    coefficients = np.zeros(3)
    for _ in range(50):  # Newton steps of a slightly regularised logistic regression
        p = 1 / (1 + np.exp(-x @ coefficients))
        slope = x.T @ (weight * (p - y)) + 1e-4 * coefficients
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        coefficients = coefficients - np.linalg.solve(bend, slope)
    # More of the lexicon never lowers a score.
    model.coefficients = np.r_[coefficients[0], np.maximum(coefficients[1:], 0)]
    model.terms = learn_terms(toxic, clean, toxic_share)
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str], float]:
    """At most ``rows`` texts of each label in the order of a hash of the id, and the share of label 1 in ``labels``."""
    labels = labels.where("toxic IN (0, 1)").select("doc_id", "toxic")
    counted = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = counted.get(1, 0) / max(sum(counted.values()), 1)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = labels.where("toxic = 1").orderBy(order).limit(rows)
    chosen = chosen.union(labels.where("toxic = 0").orderBy(order).limit(rows))
    # At most 2 * rows ids go to the executors.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts: tuple[list[str], list[str]] = ([], [])
    limited = found.where(F.length("text") <= SAMPLE_CHARS).orderBy(order, "text").limit(2 * rows)
    for r in limited.select("text", "toxic").collect():
        texts[r.toxic].append(r.text)
    return texts[1], texts[0], share


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of each row of ``docs`` (``doc_id``, ``text``).

    The score rises with the weights of the lexicon's words found in the folded
    text, in all and per root of its length; words inside an exception phrase
    do not count. Null and empty texts have the score of a text without hits.
    Rows are scored one by one, so repeated ones alike.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        automaton = known.automaton()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([inputs(fold(t or ""), automaton) for t in texts]).reshape(-1, 3)
            scores = 1 / (1 + np.exp(-x @ known.coefficients))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(scores >= TOXIC_FROM).cast(pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`score` of ``docs`` with a model learned from a bounded sample of ``labels`` (``doc_id``, ``toxic``)."""
    prepare(docs.sparkSession)
    return score(docs, fit(*sample(docs, labels)))
