"""Benchmark passages in training documents, found by an FM-index per shard of documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.arrays import hash_spans, lists, utf8, word_spans
from stocklens.llm.shared import prepare

WINDOW = 10
# Characters of benchmark text that meet the documents at a time.
BLOCK_CHARS = 4_000_000
SAMPLE_EVERY = 8

# Words are runs of ASCII digits, ASCII letters and everything beyond ASCII.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order. Zeros are separators, all different; the last code is one.

    Prefix doubling that goes on only with the suffixes still tied, so it ends
    at the length of the longest repeat between separators.
    """
    n = len(codes)
    zero = codes == 0
    first = codes.astype(np.int64) + int(zero.sum())
    first[zero] = np.arange(int(zero.sum()))
    order = np.argsort(first, kind="stable")
    head = np.ones(n, bool)
    head[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = order[~head | ~np.append(head[1:], True)]
    step = 1
    while len(tied):
        second = rank[tied + step]
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        group = rank[tied]
        at = np.arange(len(tied))
        opens = np.ones(len(tied), bool)
        opens[1:] = group[1:] != group[:-1]
        parts = opens.copy()
        parts[1:] |= second[1:] != second[:-1]
        start = np.maximum.accumulate(np.where(opens, at, 0))
        order[group + at - start] = tied
        rank[tied] = group + np.maximum.accumulate(np.where(parts, at, 0)) - start
        tied = tied[~parts | ~np.append(parts[1:], True)]
        step *= 2
    return order


class ShardIndex:
    """FM-index of a sequence of codes ``1 … size`` with zeros as separators; the last code is zero."""

    def __init__(self, codes: np.ndarray, size: int):
        order = suffix_order(codes)
        self.last = codes[order - 1]  # the code before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=size + 1))])
        self.bits = range(max(1, int(size).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        now = self.last
        for bit in self.bits:  # wavelet levels, each stably parted by one bit
            high = (now >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(high)]))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[high == 0], now[high == 1]])
        # Every eighth place and every place after a separator is stored, so no walk crosses a separator.
        stored = np.arange(len(codes)) % SAMPLE_EVERY == 0
        stored[1:] |= codes[:-1] == 0
        self.stored = stored[order]
        self.places = order[self.stored]
        self.nth = np.cumsum(self.stored) - 1

    def step(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row before which ``code`` leads: its first row plus its rank in front of ``row``."""
        begin = np.zeros_like(row)
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            high = (code >> bit) & 1 == 1
            row, begin = (
                np.where(high, zeros + ones[row], row - ones[row]),
                np.where(high, zeros + ones[begin], begin - ones[begin]),
            )
        return self.before[code] + row - begin

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows ``low … high`` of the suffixes that begin with each phrase."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            code = phrases[live, lengths[live] - back]
            low[live], high[live] = self.step(code, low[live]), self.step(code, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row's suffix."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.stored[rows])
        while len(open_):
            rows[open_] = self.step(self.last[rows[open_]], rows[open_])
            walked[open_] += 1
            open_ = open_[~self.stored[rows[open_]]]
        return self.places[self.nth[rows]] + walked


@dataclass
class Phrases:
    """The distinct windows of some benchmark items, as codes of their vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; the code is the place plus one
    codes: np.ndarray  # one row per window, filled up with zeros
    lengths: np.ndarray
    items: np.ndarray  # item numbers of all windows in turn …
    item_ends: np.ndarray  # … and where each window's end
    names: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int) -> Phrases:
        data, places = utf8(pa.array([text for _, text in rows], pa.string()))
        starts, ends, counts = word_spans(data, places, BREAKS)
        hashes = hash_spans(data, starts, ends)
        vocabulary = np.unique(hashes)
        codes = np.searchsorted(vocabulary, hashes) + 1
        held: dict[tuple, set[int]] = {}
        names = sorted({name for name, _ in rows})
        number = {name: i for i, name in enumerate(names)}
        at = 0
        for (name, _), n in zip(rows, counts.tolist(), strict=True):
            words = codes[at : at + n].tolist()
            for i in range(max(n - window, 0) + 1 if n else 0):
                held.setdefault(tuple(words[i : i + window]), set()).add(number[name])
            at += n
        table = np.zeros((len(held), window), np.int64)
        for i, phrase in enumerate(held):
            table[i, : len(phrase)] = phrase
        return Phrases(
            vocabulary,
            table,
            np.array([len(p) for p in held], np.int64),
            np.array([i for s in held.values() for i in sorted(s)], np.int64),
            np.cumsum([len(s) for s in held.values()], dtype=np.int64),
            np.array(names, object),
        )


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def search_shard(hashes: np.ndarray, counts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are inside an occurrence, and the (document, item) pairs found, as two arrays.

    Only runs of words that the phrases use, as long as the shortest phrase or
    longer, can hold an occurrence: these runs are the indexed sequence, and
    everything between two of them is one separator.
    """
    hit = np.zeros(len(hashes), bool)
    none = np.zeros(0, np.int64)
    if not len(phrases.codes) or not len(hashes):
        return hit, none, none
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == hashes
    document = np.repeat(np.arange(len(counts)), counts)
    # A run also ends with its document: widen the sequence by a gap after each.
    gaps = np.arange(len(hashes)) + document
    wide = np.zeros(len(hashes) + len(counts), bool)
    wide[gaps] = known
    begins, ends = runs_of(wide)
    long_ = ends - begins >= phrases.lengths.min()
    begins, ends = begins[long_], ends[long_]
    if not len(begins):
        return hit, none, none
    marks = np.zeros(len(wide) + 1, np.int64)
    marks[begins] += 1
    marks[ends] -= 1
    inside = np.cumsum(marks[:-1]) > 0
    word_at = np.full(len(wide), -1, np.int64)
    word_at[gaps] = np.arange(len(hashes))
    # Each run followed by one separator: the place after a run is never inside another one.
    taken = inside.copy()
    taken[ends[ends < len(wide)]] = True
    words = np.where(inside, word_at, -1)[taken]
    if words[-1] >= 0:
        words = np.append(words, -1)
    codes = np.where(words >= 0, place[words] + 1, 0)
    index = ShardIndex(codes, len(phrases.vocabulary))
    low, high = index.search(phrases.codes, phrases.lengths)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    if not len(found):
        return hit, none, none
    which = np.repeat(found, times)
    rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + low[which]
    places = index.locate(rows)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + phrases.lengths[which], -1)
    hit[words[np.cumsum(cover[:-1]) > 0]] = True
    met = np.unique(document[words[places]] * len(phrases.codes) + which)
    of, phrase = np.divmod(met, len(phrases.codes))
    begin = np.concatenate([[0], phrases.item_ends[:-1]])[phrase]
    many = phrases.item_ends[phrase] - begin
    items = phrases.items[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)]
    pairs = np.unique(np.repeat(of, many) * len(phrases.names) + items)
    return hit, *np.divmod(pairs, len(phrases.names))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each row of ``docs`` as ``row`` with ``n_words``, ``spans`` and ``items``; see :func:`contamination`."""
    spark = prepare(docs.sparkSession)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    in_block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        part = items.where(in_block == block)
        sent = spark.sparkContext.broadcast(Phrases.of([(r.item, r.text) for r in part.collect()], window))
        out = out.mapInArrow(_search(sent), out.schema)
    return out


def _search(sent):
    def run(batches):
        phrases = sent.value
        for batch in batches:
            row = batch.column("row")
            data, places = utf8(row.field("text"))
            starts, ends, counts = word_spans(data, places, BREAKS)
            hit, documents, items = search_shard(hash_spans(data, starts, ends), counts, phrases)
            limits = np.concatenate([[0], np.cumsum(counts)])
            # Words hit before, by earlier blocks.
            spans, had = batch.column("spans"), batch.column("spans").value_lengths().to_numpy(zero_copy_only=False)
            flat = spans.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(had)), had)
            for begin, end, doc in zip(flat[::2], flat[1::2], of[::2], strict=True):
                hit[limits[doc] + begin : limits[doc] + end] = True
            wide = np.zeros(len(hit) + len(counts), bool)
            document = np.repeat(np.arange(len(counts)), counts)
            wide[np.arange(len(hit)) + document] = hit
            begins, finals = runs_of(wide)
            owner = np.searchsorted(limits[1:] + np.arange(1, len(counts) + 1), begins, "right")
            both = np.column_stack([begins, finals]) - (limits[:-1] + np.arange(len(counts)))[owner][:, None]
            names = batch.column("items").to_pylist()
            for doc in np.unique(documents).tolist():
                names[doc] = sorted({*names[doc], *phrases.names[items[documents == doc]]})
            yield pa.RecordBatch.from_arrays(
                [
                    row,
                    pa.array(counts, pa.int64()),
                    lists(both.ravel(), 2 * np.bincount(owner, minlength=len(counts)), pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                ],
                names=["row", "n_words", "spans", "items"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` and ``items`` of each row of ``docs`` (``doc_id``, ``text``).

    An item's windows are its runs of ``window`` consecutive words; an item of
    fewer words, but not none, is one window. ``spans`` are the merged runs of
    document words inside any occurrence of a window, as word numbers (begin,
    end, begin, end, …); ``items`` are the ids, as text and sorted, of the
    items whose windows occur. A word is a run of ASCII digits, letters (A-Z
    in lower case) and characters beyond ASCII.

    Documents never move: each Arrow batch is a shard with an index of its own,
    and the items come to it in blocks of about ``BLOCK_CHARS`` characters.
    Null and blank texts have no words and no hits; a null item_id is listed
    as "null", items of equal id count once, and rows that repeat a doc_id
    give a row each. Without items nothing is hit.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return marked(rows, benchmark, window).select(F.col("row.doc_id").alias("doc_id"), "n_words", "spans", "items")


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all of :func:`contamination`'s spans cut out of ``text``; other columns stay as they are.

    A span is cut from its first word's first character to its last word's
    last one. Texts without a hit stay equal, null stays null.
    """

    def run(batches):
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans")
            texts = row.field("text").to_pylist()
            data, places = utf8(row.field("text"))
            starts, ends, counts = word_spans(data, places, BREAKS)
            limits = np.concatenate([[0], np.cumsum(counts)])
            for doc, own in enumerate(spans.to_pylist()):
                if own:
                    kept, done = [], int(places[doc])
                    for begin, end in zip(own[::2], own[1::2], strict=True):
                        kept.append(data[done : starts[limits[doc] + begin]].tobytes())
                        done = int(ends[limits[doc] + end - 1])
                    kept.append(data[done : places[doc + 1]].tobytes())
                    texts[doc] = b"".join(kept).decode()
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], names=["row", "cleaned"])

    found = marked(docs, benchmark, window).select("row", "spans")
    schema = found.select("row", F.lit("").alias("cleaned")).schema
    schema["cleaned"].nullable = True
    cleaned = found.mapInArrow(run, schema)
    return cleaned.select(
        *[(F.col("cleaned") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
