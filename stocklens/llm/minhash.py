"""Near-duplicate documents by MinHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.arrays import hash_spans, lists, mix, shingle_sets, utf8, word_spans
from stocklens.llm.components import apart, linked_by_keys, pairs_apart, shared_keys
from stocklens.llm.shared import discard, prepare, written

ROWS_PER_BAND = 4
BANDS = 24
# Share of equal minima below which a pair is not compared further. At the least
# similarity of a link, 0.8, its probability is below one in a hundred million.
LEAST_AGREEMENT = 0.55

SKETCH = "doc_id bigint, text_hash bigint, n_shingles bigint, fingerprint binary, minima array<int>"
SET = "fingerprint binary, shingles array<bigint>"


def text_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    data, places = utf8(texts)
    starts, ends, counts = word_spans(data, places)
    return shingle_sets(hash_spans(data, starts, ends), counts, width)


def minima(sets: list[np.ndarray], number: int) -> np.ndarray:
    """For each set the least value of each of ``number`` universal hash functions; zeros for an empty set."""
    out = np.zeros((len(sets), number), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    multipliers = mix(np.arange(1, number + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(number + 1, 2 * number + 1, dtype=np.uint64))
    sizes = np.array([len(sets[i]) for i in full])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(full):  # some hundred thousand shingles at a time stay in the processor's cache
        upto = max(at + 1, int(np.searchsorted(begins, begins[at] + 200_000, "right")) - 1)
        values = np.concatenate([sets[i] for i in full[at:upto]])
        heads = begins[at:upto] - begins[at]
        for j in range(number):
            hashed = ((values * multipliers[j] + shifts[j]) >> np.uint64(32)).astype(np.uint32)
            out[full[at:upto], j] = np.minimum.reduceat(hashed, heads)
        at = upto
    return out


def fingerprints(sets: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    number = ROWS_PER_BAND * BANDS

    def run(batches):
        for batch in batches:
            sets = text_sets(batch.column("text"), width)
            least = minima(sets, number)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(fingerprints(sets), pa.binary()),
                    lists(least.view(np.int32).ravel(), np.full(len(sets), number), pa.int32()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "fingerprint", "minima"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = text_sets(batch.column("text"), width)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fingerprints(sets), pa.binary()),
                    lists(values, np.array([len(s) for s in sets], int), pa.int64()),
                ],
                names=["fingerprint", "shingles"],
            )

    return docs.select("text").mapInArrow(run, SET)


def both_ends(pairs: DataFrame, nodes: DataFrame, columns: list[str], number: int | None = None) -> DataFrame:
    """The pairs with each end's columns, as ``<column>_a`` and ``<column>_b``.

    If their ``number`` is known and small, the pairs go to the nodes.
    """
    for end in ("a", "b"):
        if number is not None and number <= 200_000:
            pairs = F.broadcast(pairs)
        own = [F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]]
        pairs = pairs.join(nodes.select(*own), end)
    return pairs


def rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each node (``node``, ``component``), as many as any linked set must share one of.

    Sets whose overlap is ``percent`` of their union or more share at least
    that part of either set, so they share one of the first shingles beyond it
    in any common order. Counted here among the nodes still apart, the rare
    ones come first: a copy with many changes of its own then meets nothing.
    ``at`` is the shingle's place in the order.
    """
    rows = nodes.join(sets, "node").select("node", "component", "n_shingles", F.explode("shingles").alias("key"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    ordered = rows.join(held, "key").groupBy("node", "component", "n_shingles")
    ordered = ordered.agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("all"))
    number = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1).cast("int")
    first = ordered.select("node", "component", "n_shingles", F.posexplode(F.slice("all", F.lit(1), number)))
    return first.where("col.held > 1").select("col.key", "node", "component", "n_shingles", F.col("pos").alias("at"))


def enough_left(percent: int) -> Column:
    """Whether two sets can be linked if the shingle at hand is the first that they share.

    They then share no more than what either has from that place on.
    """
    left = F.least(F.col("n_shingles_a") - F.col("at_a"), F.col("n_shingles_b") - F.col("at_b"))
    return left * (100 + percent) >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs`` (``doc_id``, ``text``).

    A document is the set of its distinct shingles of ``width`` words (runs of
    anything but ASCII white space, A-Z in lower case); a shorter one is a
    single shingle. Two documents are linked if their sets overlap by
    ``similarity`` or more of their union; ``component_id`` is the least doc_id
    of the documents reachable by links, and ``kept`` marks the one that bears
    it.

    Equal sets are one node. Nodes that agree in a band of minima are
    candidates; their minima, then their full sets are compared, so every link
    is exact; a link at the least similarity is missed with a probability of
    (1 - 0.8**4)**24, three in a million, and in a group of copies only if all
    paths are missed. Nodes that share bands but are still apart after a first
    round are joined by their rarest shingles instead of all with all.

    Null or blank texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id are separate documents, linked by their texts alone;
    a null doc_id never is a group's id unless all ids of the group are null,
    and then all its rows are kept. Other columns of ``docs`` are ignored; an
    empty table gives no rows.
    """
    rows = grouped(docs, width, similarity).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def text_hash(docs: DataFrame) -> Column:
    """By which the rows of one doc_id are told apart."""
    return F.xxhash64(docs["text"].isNull(), docs["text"])


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of near duplicates, as :func:`near_duplicates` links them, one row of ``docs``.

    It is the one with the least doc_id, null after all others, then the least
    hash of the text. Rows are kept or dropped by doc_id and text together, so
    rows of one doc_id with other texts, and rows without one, are documents
    like all others. Of rows without words those with equal doc_id and text stay once.
    """
    rows = grouped(docs, width, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    firsts = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("first"))
    kept = firsts.select("first.doc_id", "first.text_hash")
    kept = kept.union(rows.where("component IS NULL").select("doc_id", "text_hash").distinct())
    kept = kept.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("of_doc")) & (text_hash(docs) == F.col("of_hash"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def grouped(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component`` and ``component_id`` of each row.

    ``component`` numbers the groups and is null for rows without shingles; see :func:`near_duplicates`.
    """
    prepare(docs.sparkSession)
    percent = round(100 * similarity)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(docs).alias("text_hash"), "text")
    sketch = written(sketches(docs, width), "sketches")
    nodes = (
        sketch.where("n_shingles > 0")
        .groupBy("fingerprint")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("minima").alias("minima"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = written(nodes, "nodes")
    bands = F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, slice(minima, i * {ROWS_PER_BAND} + 1, {ROWS_PER_BAND})))"
    )
    members = shared_keys(nodes.select(F.explode(bands).alias("key"), "node"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", "fingerprint", "first_id", "n_shingles")
    chosen = docs.join(wanted.select("first_id").distinct(), docs.doc_id.eqNullSafe(F.col("first_id")), "left_semi")
    found = full_sets(chosen, width).dropDuplicates(["fingerprint"])
    sets = written(found.join(wanted, "fingerprint").select("node", "n_shingles", "shingles"), "sets")

    def accept(pairs: DataFrame) -> DataFrame:
        ends = both_ends(pairs, nodes, ["n_shingles", "minima"])
        sizes = [F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")]
        equal = F.size(F.filter(F.zip_with("minima_a", "minima_b", lambda x, y: x == y), lambda e: e))
        likely = ends.where(100 * sizes[0] >= percent * sizes[1]).where(equal >= LEAST_AGREEMENT * BANDS * ROWS_PER_BAND)
        ends = both_ends(likely.select("a", "b"), sets, ["shingles"])
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        union = F.size("shingles_a") + F.size("shingles_b") - common
        return ends.where(100 * common >= percent * union).select("a", "b")

    rare: list[DataFrame] = []

    def rest(rows: DataFrame) -> DataFrame:
        undecided = apart(rows).select("node", "component").distinct()
        rare.append(written(rare_shingles(undecided, sets, percent), "rare"))
        return pairs_apart(rare[0], enough_left(percent))

    groups = linked_by_keys(members, accept, rest)
    discard(members, sets, *rare)
    named = (
        nodes.join(groups, "node", "left")
        .select("fingerprint", "first_id", F.coalesce("component", "node").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(least, "component").select("fingerprint", "component", "component_id")
    own = ["doc_id", "text_hash", "n_shingles"]
    marked = sketch.where("n_shingles > 0").join(of_set, "fingerprint").select(*own, "component", "component_id")
    none = F.lit(None).cast("bigint").alias("component")
    return marked.union(sketch.where("n_shingles = 0").select(*own, none, F.col("doc_id").alias("component_id")))
