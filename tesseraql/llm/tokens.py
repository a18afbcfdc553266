"""Vectorised tokenising and hashing of Arrow text columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text; as every
other byte of a code point is above 0x7F, that equals the same rule on characters.
A null text counts as empty.  Texts are handled in chunks of about ``CHUNK`` bytes (one
longer text is a chunk of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits all depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


class _Places:
    """Odd multipliers for places of blocks, made as long as words ask for."""

    def __init__(self, seed: int):
        self.seed, self.table = seed, stream(seed, 256) | U(1)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = stream(self.seed, 2 * n) | U(1)
        return self.table


#: Words are hashed by blocks of BLOCK bytes; FILLED keeps the bytes of a block that a word fills.
BLOCK = 8
FILLED = np.array([(1 << 8 * k) - 1 for k in range(BLOCK + 1)], np.uint64)
_PLACES = _Places(102)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each chunk of a text column."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """Words of a chunk: starts and ends in bytes, first word of each document (``first``)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        inside = ~SPACE[raw]
        self.inside = inside
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offs[offs < len(raw)]
        before[edge] = False
        edge = offs[offs > 0] - 1
        after[edge] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased first if asked for."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        padded = np.zeros(len(self.raw) + BLOCK, np.uint8)
        padded[: len(self.raw)] = LOWER[self.raw] if lower else self.raw
        block = np.ndarray(len(self.raw) + 1, np.dtype("<u8"), padded, strides=(1,))  # of every place, unaligned
        blocks = (size + BLOCK - 1) // BLOCK
        places = _PLACES.upto(int(blocks.max()))
        total = mix((block[self.starts] & FILLED[np.minimum(size, BLOCK)]) * places[0])
        long = np.flatnonzero(blocks > 1)
        if len(long):
            more = blocks[long] - 1
            at = np.cumsum(more) - more
            word = np.repeat(long, more)
            k = np.arange(len(word)) - np.repeat(at, more) + 1
            value = block[self.starts[word] + BLOCK * k] & FILLED[np.minimum(size[word] - BLOCK * k, BLOCK)]
            total[long] += np.add.reduceat(mix(value * places[k]), at)
        return mix(total + size.astype(np.uint64))

    def documents(self) -> np.ndarray:
        """The document of each word, as a number in the chunk."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))


def plain(column: pa.Array) -> pa.Array:
    """Text with nulls as empty strings."""
    return column.fill_null("") if column.null_count else column
