"""Words of Arrow string batches, found and hashed with numpy.

One pass handles about a megabyte of text at once, so the working arrays stay small whatever the length of
a document. All hashes are 64-bit, the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
LONG_WORD = 256

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Separators `\x20 \x09-\x0D`; all other bytes belong to words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a batch: index of the row, first and past-the-end byte in ``data``, hash; first word of each row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 8 * PIECE_BYTES:
            return up, down
        _powers[base] = up, down
    return _powers[base]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 2 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer row is a slice of its own."""
    _, offsets = raw(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; equal bytes, equal hash. Spans are in order and don't overlap."""
    import hashlib

    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a > 4 * PIECE_BYTES:
            i = j  # one word of several megabytes; hashed below
            continue
        up, down = powers(_BYTE_BASE, b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data[a:b]] * up[: b - a], out=total[1:])
        s = start[i:j] - a
        out[i:j] = (total[end[i:j] - a] - total[s]) * down[s]
        i = j
    out = mix(out ^ (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD):  # sums of powers are weak on long texts made to collide
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def scan(column: pa.Array, separator: np.ndarray = WHITE, lower: bool = False) -> Words:
    """The words of every row: longest runs of bytes that are not separators, within one row."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] |= inside[edges + 1]
    closes[edges - 1] |= inside[edges]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(row, start, end, hash_spans(data, start, end), np.searchsorted(row, np.arange(len(offsets))), data)


def roll(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries; entry i is the run that starts at i."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    count = len(words) - n + 1
    return mix((total[n:] - total[:count]) * down[:count] ^ _U(n))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark longs."""
    return x.view(np.int64)
