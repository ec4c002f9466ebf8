"""Token ids kept as wavelet matrices: one compressed file per shard of documents.

A shard holds whole documents in ascending order of id. Its file is a header, the documents' ids
and lengths, and one plane of bits per bit of a token id, each with counts of ones per 512 bits.
From the file alone one can read any token, count a token in a range, and find its k-th place.
Files are binary rows written through Spark, so any store that Spark can write will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._store import keep, small_batches
from docweave.llm._tokens import shared_encoder

_MAGIC = b"DWWM0001"
SHARDS = "part int, seq int, n_docs long, n_tokens long, file binary"


class WaveletMatrix:
    """A sequence of integers below 2**bits as bit planes with rank and select."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray]):
        self.n, self.bits, self.planes = n, bits, planes
        self._words = [np.frombuffer(p.tobytes(), "<u8") for p in planes]
        counts = [np.bitwise_count(w).astype(np.int64) for w in self._words]
        self.supers = [np.concatenate([[0], np.cumsum(c.reshape(-1, 8).sum(1))]) for c in counts]
        self.zeros = [n - int(s[-1]) for s in self.supers]

    @staticmethod
    def planes_of(values: np.ndarray, bits: int) -> list[np.ndarray]:
        n, planes, padded = len(values), [], -(-len(values) // 512) * 64 or 64
        for k in range(bits - 1, -1, -1):
            one = (values >> values.dtype.type(k) & values.dtype.type(1)).astype(bool)
            plane = np.zeros(padded, np.uint8)
            packed = np.packbits(one, bitorder="little")
            plane[: len(packed)] = packed
            planes.append(plane)
            values = np.concatenate([values[~one], values[one]]) if k else values
        assert all(len(p) * 8 >= n for p in planes)
        return planes

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        return cls(len(values), bits, cls.planes_of(values, bits))

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        words, block, word = self._words[level], at >> 9, at >> 6
        total = self.supers[level][block].copy()
        for j in range(7):
            i = (block << 3) + j
            inside = i < word
            total[inside] += np.bitwise_count(words[i[inside]])
        rest = (at & 63).astype(np.uint64)
        partial = rest > 0
        total[partial] += np.bitwise_count(words[word[partial]] & ((np.uint64(1) << rest[partial]) - np.uint64(1)))
        return total

    def access(self, at) -> np.ndarray:
        """The values at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = (self._words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._rank1(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            out = out << 1 | one
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([lo, hi], np.int64))
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                lo, hi = lo - int(a), hi - int(b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often value stands in [lo, hi)."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def select(self, value: int, k) -> np.ndarray:
        """Positions of the k-th occurrences (from 0) of value."""
        first, past = self._range(value, 0, self.n)
        at = first + np.atleast_1d(np.asarray(k, np.int64))
        if len(at) and (at.min() < first or at.max() >= past):
            raise IndexError("there are not so many occurrences")
        for level in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - level) & 1)
            goal = at - self.zeros[level] if one else at
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
            while (lo < hi).any():  # the last position with so many before it
                mid = (lo + hi + 1) >> 1
                ones = self._rank1(level, np.minimum(mid, self.n))
                before = ones if one else mid - ones
                up = before <= goal
                lo, hi = np.where(up & (lo < hi), mid, lo), np.where(~up & (lo < hi), mid - 1, hi)
            at = lo
        return at

    def occurrences(self, value: int) -> np.ndarray:
        return self.select(value, np.arange(self.count(value)))

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out, z = np.empty(self.n, kind), self.zeros[level]
            out[~one] = now[:z]
            out[one] = now[z:] | kind(1 << (self.bits - 1 - level))
            now = out
        return now


def write_shard(doc_ids: list[int | None], lengths: list[int], values: np.ndarray, bits: int) -> bytes:
    """A shard's file. A null id is kept as such."""
    planes = WaveletMatrix.planes_of(values, bits)
    packer = zstandard.ZstdCompressor(level=1)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    parts = [packer.compress(x) for x in (ids, nulls, np.array(lengths, "<u4").tobytes(), *(p.tobytes() for p in planes))]
    return _MAGIC + struct.pack("<QQB", len(values), len(doc_ids), bits) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(parts)


def read_shard(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths in tokens, and the tokens."""
    if file[:8] != _MAGIC:
        raise ValueError("not a wavelet shard")
    n, docs, bits = struct.unpack_from("<QQB", file, 8)
    sizes = struct.unpack_from(f"<{bits + 3}Q", file, 25)
    at, parts = 25 + 8 * (bits + 3), []
    for size in sizes:
        parts.append(zstandard.decompress(file[at : at + size]))
        at += size
    nulls = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=docs).astype(bool)
    ids = [None if z else d for d, z in zip(np.frombuffer(parts[0], "<i8").tolist(), nulls, strict=True)]
    return ids, np.frombuffer(parts[2], "<u4").astype(np.int64), WaveletMatrix(n, bits, [np.frombuffer(p, np.uint8) for p in parts[3:]])


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, bits: int = 16, shard_tokens: int = 1 << 20, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents in ascending order of id and write their shards; returns the table of shards.

    A shard ends with the document that takes it to shard_tokens. Null and empty texts are the end
    id alone; equal ids stand next to each other; no rows give no shards; other columns aren't read.
    """

    def encode(batches):
        from pyspark import TaskContext

        encoder, end = shared_encoder(tokenizer), int(end_id).to_bytes(4, "little")
        kind, part, seq = np.uint16 if bits <= 16 else np.uint32, TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def shard():
            row = [[part], [seq], [len(ids)], [total], [write_shard(ids, lengths, np.concatenate(held), bits)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_docs", "n_tokens", "file"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(encoder.ids(text.as_py()) + end, "<u4")
                if int(tokens.max()) >> bits:
                    raise ValueError(f"token id {tokens.max()} doesn't fit into {bits} bits")
                tokens = tokens.astype(kind)
                ids.append(doc)
                lengths.append(len(tokens))
                held.append(tokens)
                total += len(tokens)
                if total >= shard_tokens:
                    yield shard()
                    ids, lengths, held, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return keep(ordered.mapInArrow(encode, SHARDS), "wavelet")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before it), n_tokens, and the crc of its ids.

    One row per document that was written: null ids stay null, repeated ids are rows of their own in the order in
    which they were written; no shards give no rows; other columns aren't read.
    """

    def decode(batches):
        for batch in batches:
            for part, seq, file in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                ids, lengths, matrix = read_shard(file.as_buffer().to_pybytes())
                tokens = matrix.values().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"])

    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "seq", "n_tokens")
    # one row a partition, however many shards: the only step in one task
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("_before"))
    inside = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("_within"))
    base = inside.join(parts, "part").select("part", "seq", (F.col("_before") + F.col("_within")).alias("_base"))
    rows = shards.select("part", "seq", "file").mapInArrow(decode, "part int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    # a small table, so that a reader's second look doesn't undo the planes again
    return keep(rows.join(base, ["part", "seq"]).select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"), "tokens")
