"""Token-budget batches inside length buckets whose borders keep padding least."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.shared import prepare, written
from stocklens.operators.ordered import sorted_chunks

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 16_384


def word_tokens(text: str = "text") -> Column:
    """Number of tokens of a text: its words (runs of anything but ASCII white space) and one end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)) + 1


def borders(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bucket borders (at most ``buckets``) with the least padding, by dynamic programming.

    ``histogram`` maps lengths to their numbers. Each length is padded to the
    next border; the last border is the greatest length. Of equally good
    choices the one with fewer buckets, then with smaller borders is taken.
    """
    lengths = np.array(sorted(n for n, times in histogram.items() if times), np.int64)
    if not len(lengths):
        return []
    times = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths.tolist()])])
    # Cost of a bucket of the lengths i … j: every one of them takes the length of j.
    best = lengths * times[1:]
    choice = [np.zeros(len(lengths), np.int64)]
    least, used = best[-1], 1
    for k in range(2, min(buckets, len(lengths)) + 1):
        following, chosen = best.copy(), np.zeros(len(lengths), np.int64)
        for j in range(k - 1, len(lengths)):
            cost = best[k - 2 : j] + lengths[j] * (times[j + 1] - times[k - 1 : j + 1])
            at = int(np.argmin(cost))
            following[j], chosen[j] = cost[at], at + k - 1
        choice.append(chosen)
        best = following
        if best[-1] < least:
            least, used = best[-1], k
    out, j = [], len(lengths) - 1
    for k in range(used - 1, -1, -1):
        out.append(int(lengths[j]))
        j = int(choice[k][j]) - 1
    return out[::-1]


def packed(
    docs: DataFrame,
    tokens: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """The sequences of all documents with their batch: one row per sequence.

    A document of more than ``max_tokens`` tokens becomes several sequences;
    ``piece`` numbers them and ``first_token`` is where they begin. ``bucket``
    is the length to which the sequence is padded, ``batch`` its batch, counted
    within the bucket, and ``slot`` its place there. A batch holds as many
    sequences as the budget has room for at the bucket's length, at least one,
    so padded batches do not exceed the budget; all but a bucket's last are
    full. The sequences of a bucket are dealt in an order drawn from doc_id.

    The histogram has ``max_tokens`` entries at most, whatever the data; the
    places come from one range-partitioned sort and a small table of offsets.
    ``tokens`` is the length of a row, by default :func:`word_tokens`; null and
    empty texts have just their end. Rows that repeat a doc_id, also null, are
    sequences of their own; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    # Stored at once, so that texts are read a single time.
    sizes = docs.select("doc_id", (word_tokens() if tokens is None else tokens).cast("bigint").alias("_tokens"))
    pieces = sizes.select("*", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("_tokens") - 1, F.lit(max_tokens).cast("bigint"))))
    sequences = written(
        pieces.select(
            "doc_id",
            F.col("pos").cast("bigint").alias("piece"),
            F.col("col").alias("first_token"),
            F.least(F.col("_tokens") - F.col("col"), F.lit(max_tokens)).alias("n_tokens"),
        ),
        "sequences",
    )
    histogram = {r.n_tokens: r["count"] for r in sequences.groupBy("n_tokens").count().collect()}
    bucket = F.lit(None).cast("bigint")
    for border in reversed(borders(histogram, buckets)):
        bucket = F.when(F.col("n_tokens") <= border, F.lit(border).cast("bigint")).otherwise(bucket)
    # The row's place in the scan parts rows that are equal otherwise, so that any number of them can be spread.
    order = ["bucket", F.xxhash64("doc_id"), "doc_id", "piece", "first_token", "n_tokens", "_tie"]
    rows = sorted_chunks(sequences.withColumns({"bucket": bucket, "_tie": F.monotonically_increasing_id()}), order)
    chunks = rows.groupBy("bucket", "_chunk").agg(F.min("_place").alias("_head"), F.count(F.lit(1)).alias("_size"))
    # One row per sort partition and bucket border.
    before = F.sum("_size").over(Window.partitionBy("bucket").orderBy("_chunk")) - F.col("_size")
    offsets = chunks.select("bucket", "_chunk", (before - F.col("_head")).alias("_offset"))
    placed = rows.join(F.broadcast(offsets), ["bucket", "_chunk"]).withColumn("_nth", F.col("_place") + F.col("_offset"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("bigint")
    return placed.select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "bucket",
        F.floor(F.col("_nth") / room).alias("batch"),
        (F.col("_nth") % room).alias("slot"),
    )
