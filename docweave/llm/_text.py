"""Whole-batch text primitives: Arrow string columns as byte arrays, words, and their hashes.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. All of these are
single bytes in UTF-8, so words are found on bytes, for a whole Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled together; a longer document is handled by itself, in blocks of words.
SLICE_BYTES = 1 << 19

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15 | 1
_ODD_2 = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if size > SLICE_BYTES + 1:
            return made[0][:n], made[1][:n]
        _powers[base] = tuple(made)
    a, b = _powers[base]
    return a[:n], b[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, past last) document of runs of at most limit bytes, or of one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


class Words:
    """The words of a run of documents: byte spans, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = _IS_WORD[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Document i has the words bounds[i]..bounds[i+1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, base: int = _ODD) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the same in any batch."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            first = self.starts[at]
            end = max(at + 1, int(np.searchsorted(self.ends, first + SLICE_BYTES, "right")))
            block = self.data[first : self.ends[end - 1]]
            up, down = powers(base, len(block) + 1)
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTE[block] * up[:-1], out=total[1:])
            s, e = self.starts[at:end] - first, self.ends[at:end] - first
            out[at:end] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = end
        return out

    def window_hashes(self, h: np.ndarray, k: int, base: int = _ODD_2) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether they lie in one document."""
        n = len(h)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        at, step = 0, SLICE_BYTES // 2
        while at <= n - k:
            part = h[at : min(n, at + step + k - 1)]
            up, down = powers(base, len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[:-1], out=total[1:])
            m = len(part) - k + 1
            out[at : at + m] = mix((total[k:] - total[:m]) * down[:m])
            at += m
        last = np.repeat(self.bounds[1:], self.counts)
        return out, np.arange(n) + k <= last


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def without_marks(words: Words) -> Words:
    """The words less the ASCII marks at either end, however many; words of marks alone go."""
    other = np.flatnonzero(~_MARK[words.data])
    at, before = np.searchsorted(other, words.starts), np.searchsorted(other, words.ends)
    stay = at < before
    out = Words.__new__(Words)
    out.data, out.offsets, out.starts, out.ends = words.data, words.offsets, other[at[stay]], other[before[stay] - 1] + 1
    out.bounds = np.concatenate([[0], np.cumsum(stay)])[words.bounds]
    return out


def runs(batch: pa.RecordBatch, text: str = "text", lower: bool = False, limit: int = SLICE_BYTES):
    """(first, past last, Words) for runs of a batch's documents."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    for a, b in slices(offsets, limit):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
