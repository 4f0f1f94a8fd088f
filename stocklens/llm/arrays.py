"""Words and their hashes for whole Arrow columns of text, with numpy.

Texts are handled as UTF-8 bytes: every separator and every folded letter is
ASCII, so bytes and code points give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes hashed at a time: the working arrays stay small for texts of any length.
BLOCK = 1 << 18

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
WORD_BREAKS = BLANKS

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER = _powers(_BASE, BLOCK)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins (one entry more). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    places = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    places = places[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[places[0] : places[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, places - places[0]


def word_spans(
    data: np.ndarray, places: np.ndarray, breaks: np.ndarray = WORD_BREAKS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each text.

    A word is a longest run of bytes that ``breaks`` does not mark, inside one text.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = places[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts + 1]
    end[cuts - 1] = inside[cuts]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, places))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``fold`` maps bytes first. Spans are in order and do not overlap."""
    values = _OF_BYTE[fold]
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        length = int(ends[upto - 1] - base)
        power, inverse = (_POWER, _INVERSE) if length <= BLOCK else (_powers(_BASE, length), _INVERSE)
        sums = np.zeros(length + 1, np.uint64)
        np.cumsum(values[data[base : base + length]] * power[:length], out=sums[1:])
        first = starts[done:upto] - base
        out[done:upto] = (sums[ends[done:upto] - base] - sums[first]) * inverse[first]
        done = upto
    return mix(out)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``width`` words, sorted; a shorter text is one shingle, none has none."""
    spread = [mix(hashes + np.uint64(j + 1)) * np.uint64(2 * j + 1) for j in range(width)]
    windows = max(0, len(hashes) - width + 1)
    full = np.zeros(windows, np.uint64)
    for j in range(width):
        full += spread[j][j : j + windows]
    full = mix(full)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(full[at : at + n - width + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for j in range(n):
                short += spread[j][at + j]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def merged(batches, rows: int = 40_000):
    """The rows of several Arrow batches at a time, for work whose cost is per batch. For narrow rows only."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from all values and the length of each list."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
