"""Near-duplicate documents by SimHash, paired through covering bit masks."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.components import components
from stocklens.llm.shared import discard, prepare, written

WIDTH = 3
RADIUS = 2
BITS = 64
SEED = 42
# Bytes of a text that are hashed and counted at a time, so that long texts take little more memory than their own.
SLAB = 1 << 17
BLANK = re.compile(rb"[ \t-\r]")
# Members of a table's bucket up to which they are compared with each other; larger buckets are cut into cells. A member
# of a larger bucket is put into some 360 cells, so that below this number comparing costs less.
COMPARED = 256

PRINTS = "doc_id bigint, n_shingles bigint, fingerprint bigint"


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """``2**(radius+1) - 1`` bit masks, such that of two numbers with ``radius`` or fewer unlike bits one mask hides all of these.

    Each bit position has a vector of ``radius + 1`` bits, not zero, and each
    mask belongs to another such vector; the mask keeps the positions whose
    vectors have an odd inner product with its own. The vectors of ``radius``
    positions span less than the whole space, so there is a vector to which
    all of them are orthogonal: its mask keeps none of the positions. The
    positions take the vectors in turn, hence every mask keeps a little more
    than half of the bits.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % vectors + 1) & own).bit_count() % 2)
        for own in range(1, vectors + 1)
    ]


def slabs_of_words(data: bytes, size: int = SLAB):
    """The words of a text in lists, from about ``size`` bytes each."""
    # Of bytes, lower() and split() know ASCII letters and white space only.
    at = 0
    while at < len(data):
        blank = BLANK.search(data, at + size)
        end = blank.start() if blank else len(data)
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(slabs, width: int):
    """XXH64 of the space-joined shingles, in arrays; fewer words are one shingle, no words none."""
    held: list[bytes] = []
    number = 0
    for words in slabs:
        held += words
        if len(held) >= width:
            joined = map(b" ".join, zip(*[held[j:] for j in range(width)], strict=False))
            yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(held) - width + 1)
            number += len(held) - width + 1
            held = held[len(held) - width + 1 :]
    if held and not number:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> tuple[int, int]:
    """The number of shingles and the SimHash: bits that more than half of the shingles' hashes have."""
    set_bits, number = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(slabs_of_words((text or "").encode()), width):
        unpacked = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += unpacked.sum(axis=0, dtype=np.uint32)
        number += len(hashes)
    most = np.packbits(2 * set_bits > number, bitorder="little")
    return number, int(most.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``fingerprint`` (as a signed number) of each row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column("text")]
            prints = np.array([p for _, p in found], np.uint64).view(np.int64)
            numbers = pa.array([n for n, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), numbers, pa.array(prints)], names=["doc_id", "n_shingles", "fingerprint"]
            )

    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    return docs.select(ids, F.col("text").cast("string").alias("text")).mapInArrow(run, PRINTS)


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def array_of(numbers: list[int]) -> Column:
    return F.array(*[F.lit(signed(n)).cast("bigint") for n in numbers])


def near_prints(prints: DataFrame, radius: int = RADIUS, compared: int = COMPARED) -> DataFrame:
    """Links ``a``, ``b`` that connect the same ``fingerprint`` values as all pairs with ``radius`` or fewer unlike bits.

    ``prints`` has distinct values. Every such pair agrees in some mask, so it
    meets in that table's bucket. Up to ``compared`` members of a bucket are
    compared with each other. A larger bucket, as thousands of near copies or
    alike short texts make it, is cut into cells instead: members that also
    agree in all but ``radius`` of the bits that the mask hides are within the
    radius whatever these bits are, and a cell has ``2**radius`` members at
    most. All pairs of the bucket within the radius meet in cells, too, and the
    work grows with the members and not with their pairs.
    """
    masks = covering_masks(radius)
    key = [F.col("table"), F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), F.col("fingerprint")]
    keys = prints.select("fingerprint", F.posexplode(array_of(masks)).alias("table", "mask")).select(*key)
    sizes = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(keys.join(sizes, ["table", "key"]), "buckets")

    few = shared.where(F.col("size") <= compared)
    one = few.select("table", "key", F.col("fingerprint").alias("a"))
    other = few.select(F.col("table").alias("of_table"), F.col("key").alias("of_key"), F.col("fingerprint").alias("b"))
    same = (F.col("table") == F.col("of_table")) & (F.col("key") == F.col("of_key"))
    unlike = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Compared inside the join, which passes on nothing but links.
    pairs = one.join(other, same & (F.col("a") < F.col("b")) & (unlike <= radius)).select("a", "b")

    everything = (1 << BITS) - 1
    hidden = []
    for mask in masks:
        free = [i for i in range(BITS) if not mask >> i & 1]
        hidden.append([everything ^ sum(1 << i for i in chosen) for chosen in combinations(free, radius)])
    many = shared.where(F.col("size") > compared)
    of_table = F.array(*[array_of(cells) for cells in hidden])[F.col("table")]
    cells = many.select("fingerprint", F.explode(of_table).alias("kept"))
    cells = cells.groupBy("kept", F.col("fingerprint").bitwiseAND(F.col("kept")).alias("cell"))
    # A cell met through several tables has the same members each time.
    members = cells.agg(F.sort_array(F.collect_set("fingerprint")).alias("members")).where(F.size("members") > 1)
    stars = members.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, 1 << radius)).alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``fingerprint`` (signed) and ``component_id`` for each row of ``docs`` (``doc_id``, ``text``).

    The words of a text are its runs of anything but ASCII white space, A-Z in
    lower case; its shingles are all runs of ``width`` words, repeats included;
    fewer words are one shingle. A bit of the fingerprint is one if more than
    half of the shingles' XXH64 values (seed 42) have it. Documents whose
    fingerprints differ in ``radius`` or fewer bits are linked;
    ``component_id`` is the least doc_id of those reachable by links.

    Equal fingerprints are one node, so copies cost nothing further. No pair
    within the radius is missed; see :func:`covering_masks`. Null and blank
    texts have no shingles and the fingerprint zero, and are linked as any
    other. Rows that repeat a doc_id give a row each; a null doc_id is a
    component's id only if all ids of the component are null. Other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = written(fingerprints(docs, width), "fingerprints")
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "prints")
    links = written(near_prints(prints.select("fingerprint"), radius), "links")
    groups = components(links)
    named = prints.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = written(named.join(least, "component").select("fingerprint", "component_id"), "components")
    discard(prints, links)
    return rows.join(of_print, "fingerprint").select("doc_id", "n_shingles", "fingerprint", "component_id")
