"""Conversations as token ids with a loss mask, assembled segment by segment."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm.arrays import lists
from stocklens.llm.shared import prepare

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The template: reserved ids follow the vocabulary in this order.
RESERVED = ("<|begin|>", "<|role|>", "<|text|>", "<|end|>")
BEGIN, ROLE, TEXT, END = range(4)
LEARNED_ROLE = "assistant"

# First characters of control strings, of this template and other common ones, with what makes them one.
_CONTROL = re.compile(r"<(?=\||/?s>|<?/?SYS>>|unk>|pad>|bos>|eos>|start_of_turn>|end_of_turn>)|\[(?=/?INST\])")
_ESCAPE = re.compile(r"\\([be])")

ENCODED = "conv_id bigint, turn bigint, role_ids array<int>, text_ids array<int>, learned boolean"
ASSEMBLED = "conv_id bigint, turn bigint, first boolean, begin bigint, ids array<int>, mask array<boolean>"


def escape(text: str) -> str:
    r"""A backslash becomes ``\b``, and ``\e`` parts each control string behind its first character."""
    return _CONTROL.sub(lambda m: m[0] + "\\e", text.replace("\\", "\\b"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" if m[1] == "b" else "", text)


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes; it is as large as a vocabulary, whatever the data."""
    return bytes(spark.read.format("binaryFile").load(path if ":" in path else f"file://{path}").first().content)


class Codec:
    """Byte-level encoding of ordinary text; reserved ids never come out of it."""

    _made: dict[int, Codec] = {}

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.reserved = max(self.ranks.values()) + 1

    @staticmethod
    def of(ranks: bytes) -> Codec:
        """One per process and vocabulary."""
        key = hash(ranks)
        if key not in Codec._made:
            Codec._made[key] = Codec(ranks)
        return Codec._made[key]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(escape(text))

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()


def encoded(turns: DataFrame, sent) -> DataFrame:
    """Each turn's role and text as ids, row by row."""

    def run(batches):
        codec = Codec.of(sent.value)
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            role_ids = [codec.encode(r) for r in roles]
            text_ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            learned = [r == LEARNED_ROLE for r in roles]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array(role_ids, kind),
                    pa.array(text_ids, kind),
                    pa.array(learned, pa.bool_()),
                ],
                names=["conv_id", "turn", "role_ids", "text_ids", "learned"],
            )

    columns = [
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ]
    return turns.select(*columns).mapInArrow(run, ENCODED)


def formatted(turns: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """One row per turn: its ids, their loss mask, and the place of its first id in the conversation.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``. Role and text
    are encoded apart from each other, with control strings and backslashes in
    them escaped, and reserved ids are spliced in between: one that begins the
    conversation, and one in front of a role, in front of a text and behind it.
    The mask covers the text of assistant turns; its borders are prefix sums
    over the segments' lengths. Rows come in order within a conversation, and
    a conversation is in one partition, read as a stream and never gathered.

    Null roles and texts are empty; a null conv_id is a conversation too; a
    null turn comes first, and turns of one number in the order of their ids.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(turns.sparkSession)
    sent = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    def run(batches):
        reserved = Codec.of(sent.value).reserved
        now, place, begun = None, 0, False
        for batch in batches:
            ids, masks, firsts, begins = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role_ids", "text_ids", "learned")]
            for conversation, role, text, learned in zip(*columns, strict=True):
                first = not begun or conversation != now
                if first:
                    now, place, begun = conversation, 0, True
                segments = [[reserved + BEGIN]] * first
                segments += [[reserved + ROLE], role, [reserved + TEXT], text, [reserved + END]]
                ends = np.cumsum([len(s) for s in segments])
                mask = np.zeros(ends[-1], bool)
                mask[ends[-3] : ends[-2]] = learned
                ids.append([i for s in segments for i in s])
                masks.append(mask)
                firsts.append(first)
                begins.append(place)
                place += int(ends[-1])
            sizes = np.array([len(i) for i in ids], int)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array(firsts, pa.bool_()),
                    pa.array(begins, pa.int64()),
                    lists(np.array([i for one in ids for i in one], np.int32), sizes, pa.int32()),
                    lists(np.concatenate([*masks, np.zeros(0, bool)]), sizes, pa.bool_()),
                ],
                names=["conv_id", "turn", "first", "begin", "ids", "mask"],
            )

    rows = encoded(turns, sent).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids").mapInArrow(run, ASSEMBLED)


READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_back(assembled: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Per conversation what the ids of :func:`formatted` say: its turns, the text under the mask, and its length.

    Reads the rows in the order in which they come, a turn at a time.
    """
    spark = prepare(assembled.sparkSession)
    sent = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))

    def run(batches):
        codec = Codec.of(sent.value)
        state = None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "first", "ids", "mask")]
            for conversation, first, ids, mask in zip(*columns, strict=True):
                if first:
                    if state:
                        done.append(state)
                    state = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                marks = [i for i, one in enumerate(ids) if one >= codec.reserved]
                role_at, text_at, end_at = marks[-3:]
                role, text = codec.decode(ids[role_at + 1 : text_at]), codec.decode(ids[text_at + 1 : end_at])
                learned = unescape(codec.decode([i for i, m in zip(ids, mask, strict=True) if m]))
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(role) + len(text) + sum(len(RESERVED[ids[i] - codec.reserved]) for i in marks)
            yield told(done)
        yield told([state] if state else [])

    def told(states: list) -> pa.RecordBatch:
        rows = [(c, n, a.hexdigest(), k, b.hexdigest(), f) for c, n, a, k, b, f in states]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [one.split()[0] for one in READ.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return assembled.mapInArrow(run, READ)
