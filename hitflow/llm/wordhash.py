"""Vectorised word hashing over Arrow text columns, shared by the text operators.

Every function works on one bounded block of documents inside a Spark task. A word hash is a
64-bit polynomial over the word's bytes followed by a mixing step; a hash of consecutive words
is a polynomial over their word hashes. Both come from prefix sums, so the cost is a few array
passes per byte, and the values are the same in every task and on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BYTE_BASE = U64(0x9E3779B97F4A7C15)
_BYTE_BASE_2 = U64(0x94D049BB133111EB)
_WORD_BASE = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))

#: Separator bytes of the two word definitions in use: ASCII white space, and every ASCII byte
#: other than digits and letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=4)
def _byte_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * _BYTE_BASE)
    if fold:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the powers of its inverse."""
    key = (int(base), inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        step = U64(pow(int(base), -1, 1 << 64)) if inverse else base
        size = 1 << max(10, (n - 1).bit_length() if n > 1 else 10)
        out = np.empty(size, U64)
        out[0] = 1
        filled = 1
        while filled < size:
            jump = U64(pow(int(step), filled, 1 << 64))
            out[filled : 2 * filled] = out[:filled] * jump
            filled *= 2
        have = _POWERS[key] = out
    return have[:n]


@dataclass
class Words:
    """The words of a block of documents, in order."""

    doc: np.ndarray  # document number of each word
    first: np.ndarray  # index of each document's first word, and the total at the end
    hash: np.ndarray  # uint64 per word
    start: np.ndarray  # byte offset of each word in the block
    end: np.ndarray
    codes: np.ndarray  # a code of each byte of the block, case folded where asked for

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def second(self) -> np.ndarray:
        """A word hash of another base: words that collide in one do not in the other, but by chance."""
        return _word_hashes(self.codes, self.start, self.end, _BYTE_BASE_2)

    def grams(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words that lies in one document; `which` 1 gives hashes of other bases."""
        h = self.hash if which == 0 else self.second
        if len(h) < n:
            return np.empty(0, np.int64), np.empty(0, U64)
        base = _WORD_BASE[which]
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * _powers(base, len(h)), out=total[1:])
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(h) - n + 1])
        value = (total[at + n] - total[at]) * _powers(base, len(h), inverse=True)[at]
        return at, mix(value + U64(n))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def words_of(column: pa.Array, separators: np.ndarray = SPACE, fold: bool = False) -> Words:
    """Split each text into maximal runs of non-separator bytes; fold lower-cases A-Z only."""
    buf, off = text_bytes(column)
    n = len(off) - 1
    inside = ~separators[buf]
    starts, ends = inside.copy(), inside.copy()
    if len(buf):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = off[:-1][off[:-1] < len(buf)]
        starts[cut] = inside[cut]
        cut = off[1:][off[1:] > 0] - 1
        ends[cut] = inside[cut]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(off, s, "right") - 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=n), out=first[1:])
    codes = _byte_table(fold)[buf]
    return Words(doc, first, _word_hashes(codes, s, e, _BYTE_BASE), s, e, codes)


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _powers(base, len(codes)), out=total[1:])
    value = (total[end] - total[start]) * _powers(base, max(len(codes), 1), inverse=True)[start]
    return mix(value + (end - start).astype(U64))


def blocks(batch: pa.RecordBatch | pa.Table, column: str, most: int = 1 << 20):
    """Cut a batch into slices of about `most` bytes of text (a longer text is a slice of its own). Memory that a slice leaves free goes back."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total, start, n = np.concatenate([[0], np.cumsum(size)]), 0, len(size)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop
