"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.arrays import utf8
from stocklens.llm.shared import prepare, some_rows

SUBWORDS = (3, 4)
BUCKETS = 1 << 15
SIZE = 16
SAMPLE_ROWS = 4000
# Rows of the sample are not longer than this, which bounds what comes to the driver.
SAMPLE_CHARS = 20_000
EPOCHS = 5
RATE = 0.5
# Share of rightly told calibration texts that the rejection may cost.
REJECTED_SHARE = 0.002
UNKNOWN = "und"

# Bytes looked at together; working arrays stay small for texts of any length.
PART = 1 << 20

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    languages: list[str]
    votes: np.ndarray  # bucket by language: the bucket's embedding under the output layer
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, places = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    return data, places


def subwords(data: np.ndarray, places: np.ndarray):
    """Buckets of all subwords (runs of 3 and 4 bytes inside one text) with the text of each, part by part."""
    text = np.repeat(np.arange(len(places) - 1, dtype=np.int32), np.diff(places))
    for begin in range(0, len(data), PART):
        for n in SUBWORDS:
            end = min(begin + PART, len(data) - n + 1)
            if end <= begin:
                continue
            whole = text[begin:end] == text[begin + n - 1 : end + n - 1]
            code = np.full(end - begin, n, np.uint32)
            for j in range(n):
                code = (code ^ data[begin + j : end + j]) * _FACTORS[j]
                code ^= code >> np.uint32(15)
            yield (code & np.uint32(BUCKETS - 1))[whole], text[begin:end][whole]


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares of all its subwords, in small types: there are many of them."""
    out = []
    for one in texts:
        counts = np.zeros(BUCKETS, np.float32)
        for buckets, _ in subwords(*lowered(pa.array([one], pa.string()))):
            counts += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        out.append((held.astype(np.uint16), counts[held] / max(counts.sum(), 1)))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) rows; every fifth row only calibrates temperature and rejection.

    Beside whole texts, single lines are learned, so that short texts are told as well.
    """
    rows = [(t, lang) for t, lang in rows if any(c.isalpha() for c in t)]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    tested = rows[::5] if len(rows) >= 10 else rows
    learned = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 10 else rows
    examples = []
    for text, lang in learned:
        lines = [line for line in text.split("\n") if len(line) > 3]
        examples += [(text, lang), *((lines[i], lang) for i in rng.permutation(len(lines))[:2])]
    vectors = features([t for t, _ in examples])
    targets = [number[lang] for _, lang in examples]
    embedding = rng.normal(0, 0.1, (BUCKETS, SIZE))
    output, bias = rng.normal(0, 0.1, (SIZE, len(languages))), np.zeros(len(languages))
    steps, total = 0, EPOCHS * len(examples)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            held, share = vectors[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ embedding[held]
            slope = softmax(hidden @ output + bias)
            slope[targets[i]] -= 1
            back = output @ slope
            output -= rate * np.outer(hidden, slope)
            bias -= rate * 0.1 * slope
            # Shares are small, so the embeddings take longer steps.
            embedding[held] -= 20 * rate * np.outer(share, back)
    del vectors, examples
    votes = embedding @ output
    logits = np.array([share @ votes[held] + bias for held, share in features([t for t, _ in tested])])
    truth = np.array([number[lang] for _, lang in tested])
    grid = np.geomspace(0.25, 8, 41)
    losses = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    scores = softmax(logits / temperature)
    right = scores.max(axis=1)[scores.argmax(axis=1) == truth]
    least = min(0.5, float(np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0
    return Model(languages, votes.astype(np.float32), bias, temperature, least)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` rows of ``labelled`` (``doc_id``, ``text``, ``lang``), in the order of a hash."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").where(F.length("text") <= SAMPLE_CHARS)
    return [(r.text, r.lang) for r in some_rows(usable.select("doc_id", "text", "lang"), rows)]


def has_letter(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[places[1:]] > seen[places[:-1]]
    for i in np.flatnonzero(~out & (np.diff(places) > 0)):
        out[i] = any(c.isalpha() for c in data[places[i] : places[i + 1]].tobytes().decode())
    return out


def told(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The number of the language of each text (-1: none) and its score."""
    data, places = lowered(texts)
    kinds = len(model.languages)
    sums, n = np.zeros((len(texts), kinds)), np.zeros(len(texts))
    for buckets, text in subwords(data, places):
        if len(text):
            # Texts are in order, so each part covers a range of them.
            low, many = int(text[0]), int(text[-1] - text[0]) + 1
            n[low : low + many] += np.bincount(text - low, minlength=many)
            votes = model.votes[buckets]
            for k in range(kinds):
                sums[low : low + many, k] += np.bincount(text - low, votes[:, k], many)
    letters = has_letter(data, places)
    if not kinds:
        return np.full(len(texts), -1), np.zeros(len(texts))
    scores = softmax((sums / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
    return np.where(letters, scores.argmax(axis=1), -1), np.where(letters, scores.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` as ``row``, with ``lang_pred``, ``score`` and ``rejected`` from its ``text``.

    ``lang_pred`` is ``und`` with score 0 if the text is null, has no letter,
    or the model knows no language. Otherwise it is the likeliest language;
    ``rejected`` is set for ``und`` and for scores below the calibrated least
    one; if the model knows no language, only texts without a letter are
    rejected. Every row is told by itself and from its whole text.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            row = batch.column("row")
            texts = batch.column("text")
            which, score = told(texts, known)
            rejected = (which < 0) | (score < known.least) if known.languages else ~has_letter(*lowered(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    row,
                    pa.array(names[which], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["row", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = rows.select(
        "row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")
    ).schema
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """:func:`predict` on ``docs`` with a model fitted on a bounded sample of ``labelled``."""
    prepare(docs.sparkSession)
    return predict(docs, fit(sample(labelled)))
