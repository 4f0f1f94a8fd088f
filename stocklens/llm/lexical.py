"""Ranked lexical search of many items at once; sums that items share are worked out once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.arrays import hash_spans, lists, utf8, word_spans
from stocklens.llm.shared import discard, prepare, written

# Characters of item texts that meet the documents at a time, one item at least.
BLOCK_CHARS = 1_000_000
# Parts of one item between which common pairs are looked for; longer items are cut into such runs.
RUN = 64
# Partial sums (of all nodes and some documents) held at a time: 32 MB.
CELLS = 4 << 20

# Terms are runs of ASCII digits, ASCII letters and everything beyond ASCII.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

POSTINGS = "doc_id bigint, n_terms bigint, terms array<int>, times array<int>"
BEST = "item int, doc_id bigint, score bigint"


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of all texts in order, and each text's number of terms."""
    data, places = utf8(texts)
    starts, ends, counts = word_spans(data, places, BREAKS)
    return hash_spans(data, starts, ends), counts


@dataclass
class Sharing:
    """How the sums of many term sets are made from partial sums.

    Nodes ``0 … atoms - 1`` are sets of terms that occur in the same items;
    ``atom`` gives each term's. Every round adds nodes that are the sum of two
    earlier ones (``rounds``: first and second parts); an item is the sum of
    its remaining ``nodes``, which begin at ``begins``.
    """

    atom: np.ndarray
    atoms: int
    rounds: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def size(self) -> int:
        return self.atoms + sum(len(first) for first, _ in self.rounds)

    def sums(self, atoms: np.ndarray) -> np.ndarray:
        """The items' sums (rows) for columns of atom sums; every partial sum is worked out once."""
        every = np.empty((self.size, atoms.shape[1]), np.int64)
        every[: self.atoms] = atoms
        at = self.atoms
        for first, second in self.rounds:
            np.add(every[first], every[second], out=every[at : at + len(first)])
            at += len(first)
        return np.add.reduceat(every[self.nodes], self.begins, axis=0)


def common_pairs(runs: list[list[int]]) -> list[tuple[int, int]]:
    """The pairs of nodes that two and more runs have, those of most runs first."""
    codes = []
    for run in runs:
        own = np.sort(np.array(run, np.int64))
        first, second = np.triu_indices(len(own), 1)
        codes.append(own[first] << 32 | own[second])
    code, held = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]), return_counts=True)
    code, held = code[held > 1], held[held > 1]
    code = code[np.lexsort((code, -held))]
    return list(zip((code >> 32).tolist(), (code & 0xFFFFFFFF).tolist(), strict=True))


def mined(term: np.ndarray, item: np.ndarray, items: int) -> Sharing:
    """The sharing of items from distinct (term, item) pairs: ``term`` and ``item`` are numbers from zero up.

    First terms with the same items become one atom. Then, in rounds, pairs of
    nodes that several items have become nodes of their own, the most common
    pair first and a node of an item once a round, until no pair is left that
    two items have. All items have a term.
    """
    order = np.lexsort((item, term))
    term, item = term[order], item[order]
    heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    atom_of, members = {}, []
    atom = np.zeros(len(heads), np.int64)
    for t, holders in enumerate(np.split(item, heads[1:])):
        key = holders.tobytes()
        if key not in atom_of:
            atom_of[key] = len(members)
            members.append(holders)
        atom[t] = atom_of[key]
    out = Sharing(atom, len(members))

    # Atoms of many items come first, so that runs of long items meet the same ones.
    own: list[list[int]] = [[] for _ in range(items)]
    for number in sorted(range(len(members)), key=lambda a: (-len(members[a]), a)):
        for holder in members[number].tolist():
            own[holder].append(number)
    runs = [(i, nodes[at : at + RUN]) for i, nodes in enumerate(own) for at in range(0, len(nodes), RUN)]
    held = [set(nodes) for _, nodes in runs]
    size = out.atoms
    while True:
        where: dict[int, list[int]] = {}
        for r, nodes in enumerate(held):
            for node in nodes:
                where.setdefault(node, []).append(r)
        free = [set(nodes) for nodes in held]
        made = []
        for a, b in common_pairs([sorted(nodes) for nodes in held]):
            both = [r for r in where[a] if a in free[r] and b in free[r]]
            if len(both) > 1:
                for r in both:
                    free[r] -= {a, b}
                    held[r] -= {a, b}
                    held[r].add(size + len(made))
                made.append((a, b))
        if not made:
            break
        out.rounds.append((np.array([a for a, _ in made]), np.array([b for _, b in made])))
        size += len(made)
    left: list[list[int]] = [[] for _ in range(items)]
    for (i, _), nodes in zip(runs, held, strict=True):
        left[i] += sorted(nodes)
    out.nodes = np.array([n for nodes in left for n in nodes], np.int64)
    out.begins = np.concatenate([[0], np.cumsum([len(nodes) for nodes in left])])[:-1].astype(np.int64)
    return out


@dataclass
class Block:
    """Some items: their ids as text, the sorted hashes of all their terms, and (term, item) pairs."""

    ids: list[str | None]
    vocabulary: np.ndarray
    term: np.ndarray
    item: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str | None, str]]) -> Block:
        hashes, counts = term_hashes(pa.array([text for _, text in rows], pa.string()))
        kept = np.flatnonzero(counts)
        item = np.repeat(np.cumsum(counts > 0) - 1, counts)
        vocabulary, term = np.unique(hashes, return_inverse=True)
        width = max(len(kept), 1)
        pairs = np.unique(term * width + item)
        return Block([rows[i][0] for i in kept], vocabulary, pairs // width, pairs % width)


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id``, the number of terms and the sent vocabulary's terms with their times, of documents with any term."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            hashes, counts = term_hashes(batch.column("text"))
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            met = np.flatnonzero(known[place] == hashes)
            document = np.repeat(np.arange(len(counts)), counts)[met]
            pairs, times = np.unique(document * len(known) + place[met], return_counts=True)
            of, term = np.divmod(pairs, len(known))
            each = np.bincount(of, minlength=len(counts))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    lists(term.astype(np.int32), each, pa.int32()),
                    lists(times.astype(np.int32), each, pa.int32()),
                ],
                names=["doc_id", "n_terms", "terms", "times"],
            )
            yield out.filter(pa.array(counts > 0))

    return docs.mapInArrow(run, POSTINGS)


class Best:
    """The ``k`` best of each item so far: greatest score first, then least document, null after all."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a score below is of no use; zero never is
        self.rows = np.zeros((4, 0), np.int64)  # item, score, whether the document is null, document

    def add(self, scores: np.ndarray, unnamed: np.ndarray, documents: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        new = np.stack([item, scores[item, column], unnamed[column], documents[column]])
        rows = np.concatenate([self.rows, new], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        head = np.searchsorted(rows[0], rows[0])
        rank = np.arange(rows.shape[1]) - head
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.least[last[0]] = last[1]


def best_of_partitions(posts: DataFrame, sent, k: int) -> DataFrame:
    """The ``k`` best documents of every item in each partition."""

    def run(batches):
        sharing, weights, items, documents, terms = sent.value
        best = Best(items, k)
        step = max(1, CELLS // max(sharing.size, 1))
        for batch in batches:
            ids = batch.column("doc_id")
            unnamed = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            named = ids.fill_null(0).to_numpy()
            n = batch.column("n_terms").to_numpy()
            m = 100 - 90 + (90 * n * documents) // terms
            each = batch.column("terms").value_lengths().to_numpy()
            document = np.repeat(np.arange(len(n)), each)
            term = batch.column("terms").flatten().to_numpy().astype(np.int64)
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            part = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[document]))
            ends = np.concatenate([[0], np.cumsum(each)])
            for at in range(0, len(n), step):
                upto = min(at + step, len(n))
                own = slice(ends[at], ends[upto])
                atoms = np.zeros((sharing.atoms, upto - at), np.int64)
                np.add.at(atoms, (sharing.atom[term[own]], document[own] - at), part[own])
                best.add(sharing.sums(atoms), unnamed[at:upto], named[at:upto])
        item, score, none, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=none == 1), pa.array(score, pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return posts.mapInArrow(run, BEST)


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """``item_id`` (as text), ``rank``, ``doc_id`` and ``score`` of a block's items, stored."""
    spark = docs.sparkSession
    posts = written(postings(docs, spark.sparkContext.broadcast(block.vocabulary)), "postings")
    documents, terms = posts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = np.zeros(len(block.vocabulary), np.int64)
    for r in posts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r.term] = r["count"]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()]
    sharing = mined(block.term, block.item, len(block.ids))
    sent = spark.sparkContext.broadcast((sharing, np.array(weights, np.int64), len(block.ids), documents, terms))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best_of_partitions(posts, sent, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id string")
    out = written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(posts)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``k`` best rows of ``docs`` (``doc_id``, ``text``) for each row of ``items`` (``item_id``, ``text``).

    ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``, greatest score
    first, then least doc_id. Terms are runs of ASCII digits, letters (A-Z in
    lower case) and characters beyond ASCII. With N documents that have a term,
    L terms in them, n in one document, df documents with a term and tf its
    times in one, the term adds ``floor(1000 ln((2N+2) / (2df+1)))`` times
    ``10**9 tf div (1000 tf + 8 m)`` with ``m = 10 + 90 n N div L``; an item's
    score is the sum over its distinct terms. Documents with score 0 are no result.

    Items come in blocks of about ``block_chars`` characters, by a hash of
    their rows. A block's terms are looked up in all documents once, and the
    counts stored; term sets that items share are mined (:func:`mined`), and
    per group of documents each shared set's sums are worked out a single time
    and combined along the resulting graph. Each task passes on its ``k`` best
    of an item alone, so documents never move.

    Null and blank texts have no terms: such a document is not counted, such an
    item has no result. Rows that repeat a doc_id are separate documents, rows
    that repeat an item_id separate items with ranks of their own; a null
    doc_id comes after all others of its score. Empty tables give no rows.
    """
    spark = prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    in_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for number in range(blocks):
        rows = items.where(in_block == number).collect()
        block = Block.of([(r.item_id, r.text) for r in rows])
        if block.ids:
            found.append(search_block(docs, block, k))
    none = spark.createDataFrame([], "item_id string, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.union, found, none).withColumn("item_id", F.col("item_id").cast(kind))
