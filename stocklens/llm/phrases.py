"""Phrase collocations of each language, found by best-first growth of phrases under score bounds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.arrays import LOWER, hash_spans, mix, utf8, word_spans
from stocklens.llm.shared import discard, prepare, written

LONGEST = 4
LEAST = 30
KEPT = 2000
SHARE = 80
# Size of a filter in bits (16 MB), whatever the number of phrases in it.
FILTER_BITS = 27
# Phrases of two words by which the first threshold is set, as a multiple of those kept; further waves take more.
FIRST_WAVE, WAVE_GROWTH = 2, 4

# Bytes of text that a task works on at a time, one text at least.
SLICE = 4 << 20

PIECE_BREAKS = np.zeros(256, bool)
PIECE_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = PIECE_BREAKS.copy()
BREAKS[[0x20, 0x09]] = True
TURN = 21


def columns(length: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + length)]


# ---- inside a task -------------------------------------------------------------------------------------------------


class Words:
    """The words of some texts in order: ``word`` is a hash of language and word, ``left`` how many its piece still has."""

    def __init__(self, batch: pa.RecordBatch):
        data, places = utf8(batch.column("text"))
        self.starts, self.ends, counts = word_spans(data, places, BREAKS)
        lang = batch.column("lang").dictionary_encode()
        self.languages = lang.dictionary
        number = len(self.starts)
        document = np.repeat(np.arange(len(counts)), counts)
        self.lang = lang.indices.to_numpy()[document]
        salt, at = utf8(self.languages)
        salt = np.array([hash_spans(salt, at[i : i + 1], at[i + 1 : i + 2])[0] for i in range(len(at) - 1)], np.uint64)
        self.word = mix(hash_spans(data, self.starts, self.ends) ^ mix(salt)[self.lang]) if number else np.zeros(0, np.uint64)
        piece = np.searchsorted(np.flatnonzero(PIECE_BREAKS[data]), self.starts) + document
        last = np.searchsorted(piece, piece, "right") if number else piece
        self.left = last - np.arange(number)
        self.data = data

    @classmethod
    def of(cls, batches):
        """The words of all batches, some texts at a time."""
        for batch in batches:
            ends = utf8(batch.column("text"))[1]
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                yield cls(batch.slice(at, upto - at))
                at = upto

    def mark(self, first: int, length: int, starts: np.ndarray) -> np.ndarray:
        """The mark of the ``length`` words from the ``first`` on (from zero) of the phrases at ``starts``."""
        out = self.word[starts + first].copy()
        for i in range(1, length):
            word, turn = self.word[starts + first + i], np.uint64(TURN * i % 64)
            out ^= (word << turn) | (word >> (np.uint64(64) - turn))
        return out

    def distinct(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """One start of each distinct phrase and how often it occurs."""
        if not len(starts):
            return starts, starts
        values, codes = np.unique(self.word, return_inverse=True)
        code = codes[starts]
        for i in range(1, length):
            _, code = np.unique(code, return_inverse=True)
            code = code * len(values) + codes[starts + i]
        _, at, times = np.unique(code, return_index=True, return_counts=True)
        return starts[at], times


def has(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    slot = (marks >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def count_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``w1`` (hash), ``word`` and its occurrences ``a``."""

    def run(batches):
        for words in Words.of(batches):
            at, times = words.distinct(np.arange(len(words.word)), 1)
            lower = LOWER[words.data].tobytes()
            texts = [lower[i:j] for i, j in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    words.languages.take(pa.array(words.lang[at])),
                    pa.array(words.word[at].view(np.int64)),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(times, pa.int64()),
                ],
                names=["lang", "w1", "word", "times"],
            )

    rows = docs.mapInArrow(run, "lang string, w1 bigint, word string, times bigint")
    return rows.groupBy("lang", "w1", "word").agg(F.sum("times").alias("a"))


def count_phrases(docs: DataFrame, length: int, least: int, wanted, sent) -> DataFrame:
    """``lang``, ``w1`` … and ``a`` of the phrases that ``wanted(words, starts, sent filters)`` marks, from ``least`` occurrences on.

    Whether a phrase is wanted depends on its words alone, so a count is either whole or not made.
    """
    names = columns(length)

    def run(batches):
        for words in Words.of(batches):
            starts = np.flatnonzero(words.left >= length)
            at, times = words.distinct(starts[wanted(words, starts, sent.value)], length)
            yield pa.RecordBatch.from_arrays(
                [
                    words.languages.take(pa.array(words.lang[at])),
                    *[pa.array(words.word[at + i].view(np.int64)) for i in range(length)],
                    pa.array(times, pa.int64()),
                ],
                names=["lang", *names, "times"],
            )

    rows = docs.mapInArrow(run, f"lang string, {', '.join(f'{n} bigint' for n in names)}, times bigint")
    return rows.groupBy("lang", *names).agg(F.sum("times").alias("a")).where(F.col("a") >= least)


# ---- bounds and scores ---------------------------------------------------------------------------------------------


def bits_of(phrases: DataFrame, names: list[str]) -> np.ndarray:
    """A filter that has all ``phrases`` (and, rarely, others): one bit for the mark of the words in ``names``."""
    mark = F.col(names[0])
    for i, name in enumerate(names[1:], 1):
        turn = TURN * i % 64
        turned = F.shiftleft(name, turn).bitwiseOR(F.shiftrightunsigned(name, 64 - turn))
        mark = mark.bitwiseXOR(turned)
    place = F.shiftrightunsigned(mark, 64 - FILTER_BITS) + 1
    parts = phrases.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 4096  # bytes of Spark's bitmaps
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        begin = (r.bucket - 1) * size
        out[begin : begin + size] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def ratio(a: Column, left: Column, right: Column) -> Column:
    """``floor(2000000 a / (left + right))`` in decimals, since the product may pass 64 bits."""
    wide = [c.cast("decimal(20,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * F.lit(2_000_000).cast("decimal(7,0)"), wide[1] + wide[2])


def scored(known: dict[int, DataFrame], length: int) -> DataFrame:
    """``a``, ``score``, ``l``, ``r``, ``bound`` and ``whole`` of the known phrases of a length.

    A part that was not counted occurs ``a`` times at least. The score of a
    phrase with such a part is an upper bound, and ``whole`` is false.
    ``bound`` is the greatest score that any longer phrase with this beginning
    can have: it occurs no more often, its first cut's left part is the same
    word, and its right part occurs as often as the phrase itself.
    """
    rows = known[length]
    for size in range(1, length):
        for side, first in (("l", 1), ("r", length - size + 1)):
            names = columns(size, first)
            part = known[size].select(
                *[F.col(c).alias(n) for c, n in zip(columns(size), names, strict=True)], F.col("a").alias(f"{side}{size}")
            )
            rows = rows.join(part, names, "left")
    cuts = []
    for k in range(1, length):
        left, right = F.coalesce(f"l{k}", "a"), F.coalesce(f"r{length - k}", "a")
        cut = [ratio(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")]
        cuts.append(F.struct(*cut))
    parts = [F.col(f"{side}{size}").isNotNull() for side in "lr" for size in range(1, length)]
    lowest = F.array_min(F.array(*cuts))
    return rows.select(
        "lang",
        *columns(length),
        "a",
        lowest["score"].alias("score"),
        lowest["l"].alias("l"),
        lowest["r"].alias("r"),
        ratio(F.col("a"), F.col("l1"), F.col("a")).alias("bound"),
        reduce(Column.__and__, parts).alias("whole"),
    )


def thresholds(pairs: DataFrame, languages: DataFrame, number: int) -> DataFrame:
    """``lang`` and ``threshold``: the score of the language's ``number``-th best phrase of two words, 0 if it has fewer."""
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    first = pairs.select("lang", "score", best.alias("place")).where(F.col("place") <= number)
    last = first.groupBy("lang").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    reached = F.when(F.col("found") == number, F.col("least")).otherwise(F.lit(0).cast("bigint"))
    return languages.join(last, "lang", "left").select("lang", F.coalesce(reached, F.lit(0)).cast("bigint").alias("threshold"))


def above(rows: DataFrame, limits: DataFrame, column: str) -> DataFrame:
    return rows.join(limits, "lang").where(F.col(column) >= F.col("threshold")).drop("threshold")


def surviving(found: dict[int, DataFrame], limits: DataFrame, share: int) -> DataFrame:
    """Candidates from the threshold on that no candidate of one word more, and so none of any more words, covers.

    A longer one that is not next in length has one of the next length inside
    that occurs as often at least.
    """
    out = []
    for length, rows in found.items():
        words = columns(length)
        own = above(rows.where("whole"), limits, "score")
        if length + 1 in found:
            longer = found[length + 1]
            ends = [
                longer.select(*[F.col(c).alias(w) for c, w in zip(columns(length, first), words, strict=True)], F.col("a").alias("most"))
                for first in (1, 2)
            ]
            most = ends[0].union(ends[1]).groupBy(*words).agg(F.max("most").alias("most"))
            wide = [F.col(c).cast("decimal(20,0)") for c in ("most", "a")]
            own = own.join(most, words, "left").where(F.col("most").isNull() | (100 * wide[0] < share * wide[1]))
        missing = [F.lit(None).cast("bigint").alias(c) for c in columns(max(found) - length, length + 1)]
        out.append(own.select("lang", *words, *missing, "a", "l", "r", "score"))
    return reduce(DataFrame.union, out)


class Growth:
    """The phrases counted so far, and the filters by which they were chosen."""

    def __init__(self, docs: DataFrame, least: int):
        self.docs, self.least = docs, least
        self.spark = docs.sparkSession
        words = written(count_words(docs), "words")
        self.totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
        self.words = words.where(F.col("a") >= least)
        bits = bits_of(self.words, ["w1"])

        def frequent(own: Words, starts: np.ndarray, sent: np.ndarray) -> np.ndarray:
            return has(sent, own.word[starts]) & has(sent, own.word[starts + 1])

        pairs = count_phrases(docs, 2, least, frequent, self.spark.sparkContext.broadcast(bits))
        self.known = {1: self.words.select("lang", "w1", "a"), 2: written(pairs, "phrases")}
        self.found = {2: written(scored(self.known, 2), "scores")}
        self.grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, length: int, counted: DataFrame) -> None:
        """Further counts; a phrase counted again has the same count."""
        new = written(counted, "phrases")
        if length in self.known:
            both = self.known[length].union(new).groupBy("lang", *columns(length)).agg(F.max("a").alias("a"))
            merged = written(both, "phrases")
            discard(self.known[length], new)
            new = merged
        self.known[length] = new

    def score(self, length: int) -> None:
        if length in self.found:
            discard(self.found[length])
        self.found[length] = written(scored(self.known, length), "scores")

    def expand(self, length: int, limits: DataFrame) -> None:
        """Count the phrases of ``length`` that a threshold asks for: ``limits`` has those of the languages still open.

        A phrase is wanted if its beginning may grow into a score from the
        threshold on, or if its end is a candidate from there on that it might
        cover. Beginnings and ends of earlier waves are not counted again.
        """
        shorter, names = self.found[length - 1], columns(length - 1)
        begin = bits_of(above(shorter, limits, "bound"), names)
        end = bits_of(above(shorter.where("whole"), limits, "score"), names)
        had = self.grown.get(length)
        sent = self.spark.sparkContext.broadcast((begin, end, had))

        def wanted(own: Words, starts: np.ndarray, filters) -> np.ndarray:
            first, last = own.mark(0, length - 1, starts), own.mark(1, length - 1, starts)
            begin, end, had = filters
            new = has(begin, first) | has(end, last)
            return new if had is None else new & ~(has(had[0], first) | has(had[1], last))

        self.add(length, count_phrases(self.docs, length, self.least, wanted, sent))
        self.grown[length] = (begin, end) if had is None else (begin | had[0], end | had[1])
        self.score(length)
        self.complete(length, limits)

    def complete(self, length: int, limits: DataFrame) -> None:
        """Count the parts that the score of a phrase still lacks where its upper bound reaches the threshold."""
        open_ = above(self.found[length].where("NOT whole"), limits, "score")
        for size in range(3, length):
            ends = [
                open_.select("lang", *[F.col(c).alias(w) for c, w in zip(columns(size, first), columns(size), strict=True)])
                for first in (1, length - size + 1)
            ]
            lacking = ends[0].union(ends[1]).join(self.known[size], columns(size), "left_anti")
            bits = bits_of(lacking, columns(size))
            if not bits.any():
                continue

            def wanted(own: Words, starts: np.ndarray, filters, size=size) -> np.ndarray:
                return has(filters, own.mark(0, size, starts))

            sent = self.spark.sparkContext.broadcast(bits)
            self.add(size, count_phrases(self.docs, size, self.least, wanted, sent))
            self.score(size)
            self.score(length)


def collocations(
    docs: DataFrame, kept: int = KEPT, least: int = LEAST, longest: int = LONGEST, share: int = SHARE
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's ``kept`` best phrases.

    Texts (A-Z in lower case) are cut at ``.,;:!?`` and line ends into pieces,
    and these at blanks and tabs into words. Candidates are the phrases of 2 to
    ``longest`` words inside pieces that occur ``least`` times or more (``a``)
    in all texts of the language; a null language is ``und``. A cut of a
    candidate into two parts that occur ``l`` and ``r`` times scores
    ``floor(2000000 a / (l + r))``; the lowest cut counts, then the first. A
    candidate inside a longer one that has ``share`` percent of its occurrences
    is dropped. The best have the highest score, then ``a``, then come first
    in byte order; ``n`` counts all words of the language.

    Phrases grow to the right. The counts of a beginning and of its first word
    bound the score of everything that begins with it, so only beginnings whose
    bound reaches a threshold are expanded, wave after wave with lower
    thresholds, until as many candidates from the threshold on survive as are
    kept, ties included, or nothing is left to expand. Words stand in the
    tables as 64-bit hashes of language and word; filters of a fixed size tell
    the tasks which phrases to count, so what is sent does not grow.

    Null texts are empty; rows that repeat a doc_id are separate texts; doc_id
    and other columns are not used. Empty tables give no rows.
    """
    prepare(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    growth = Growth(docs.select(lang, F.col("text").cast("string").alias("text")), least)
    number = FIRST_WAVE * kept
    open_, before, results = written(growth.totals.select("lang"), "languages"), None, []
    while True:
        limits = written(thresholds(growth.found[2], open_, number), "thresholds")
        number *= WAVE_GROWTH
        # Nothing is new if every threshold is the same as in the wave before.
        if before is not None and limits.join(before, ["lang", "threshold"], "left_anti").isEmpty():
            continue
        before = limits
        for length in range(3, longest + 1):
            growth.expand(length, limits)
        survivors = written(surviving(growth.found, limits, share), "survivors")
        numbers = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("survivors"))
        enough = (F.col("threshold") == 0) | F.coalesce(F.col("survivors") >= kept, F.lit(False))
        settled = written(limits.join(numbers, "lang", "left").select("lang", enough.alias("settled")), "settled")
        results.append(survivors.join(settled.where("settled").select("lang"), "lang", "left_semi"))
        open_ = written(settled.where("NOT settled").select("lang"), "languages")
        if open_.isEmpty():
            break

    found = reduce(DataFrame.union, results)
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = written(found.withColumn("_place", place).where(F.col("_place") <= kept).drop("_place"), "best")
    for name in columns(longest):
        text = growth.words.select(F.col("w1").alias(name), F.col("word").alias(f"{name}_text"))
        best = best.join(text, name, "left")
    phrase = F.concat_ws(" ", *[f"{name}_text" for name in columns(longest)])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return (
        ranked.where(F.col("rank") <= kept)
        .join(growth.totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
