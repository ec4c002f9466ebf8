"""Katz backoff language model of order three: Good-Turing discounts, exactly normalised backoff weights.

Counting and lookup are one exchange per order. Blocks of documents send their distinct n-grams, packed, to the
partition of the n-gram's context. There the training counts of all blocks are added up, that part of the count
table is made, and every block is told what it asked for: counts, and what the backoff weights of its contexts
are made of. Text moves in compact blocks and
tables never move to one machine.

Every word of the training rows is itself; one class stands for words never seen, with Good-Turing's share of
unseen words. P(w|uv) is d(c) c(uvw)/c(uv) where the triple was seen in training, else alpha(uv) P(w|v); P(w|v)
is the same of pairs, with the unigrams P(w) below it. The alphas make each P(.|uv) and P(.|v) add up to one. A
text's first word has one word before it, the end of a text. Contexts of over a thousandth of all tokens are
spread over partitions; only for these are parts added up on the driver.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import drop, keep, small_batches
from docweave.llm._text import mix, runs

END_HASH = int(mix(np.array([0xE4D], np.uint64))[0])
#: Turns in which triples are counted and texts are scored.
TURNS = 2
#: Counts up to this are discounted.
CUTOFF = 5
_COMPRESS = zstandard.ZstdCompressor(level=3)
_DECOMPRESS = zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each in its narrowest type, compressed by planes of bytes."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            top = int(a.max(initial=0))
            if a.dtype.kind == "u" or int(a.min(initial=0)) >= 0:
                a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        body = _COMPRESS.compress(np.ascontiguousarray(planes).reshape(-1))
        parts.append(a.dtype.str.encode().ljust(4) + len(body).to_bytes(8, "little") + body)
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        kind, n = np.dtype(blob[at : at + 4].decode().strip()), int.from_bytes(blob[at + 4 : at + 12], "little")
        planes = np.frombuffer(_DECOMPRESS.decompress(blob[at + 12 : at + 12 + n]), np.uint8).reshape(kind.itemsize, -1)
        a = np.empty(planes.shape[::-1], np.uint8)
        for i, plane in enumerate(planes):
            a[:, i] = plane
        out.append(a.reshape(-1).view(kind))
        at += 12 + n
    return out


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct whole numbers in order, a place of each, and which of them is at each place.

    Number and place are sorted as one number where they fit in 64 bits: several times as fast as to sort places.
    """
    n, x = len(x), x.astype(np.uint64)
    bits = np.uint64(n.bit_length())
    if int(x.max(initial=0)).bit_length() + int(bits) <= 64:
        x <<= bits
        x |= np.arange(n, dtype=np.uint64)
        x.sort()
        place = (x & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        x >>= bits
    else:
        place = np.argsort(x)
        x = x[place]
    new = np.ones(n, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    at = np.empty(n, np.int64)
    at[place] = np.cumsum(new) - 1
    return x[new], place[new], at


def _grams(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers of 32 bits in order: their two parts, a place of each, and which is at each place."""
    words, bits = None, int(word.max(initial=0)).bit_length()
    if int(context.max(initial=0)).bit_length() + bits + len(word).bit_length() > 64:
        words, _, word = _unique(word)
        bits = len(words).bit_length()
    gram, where, at = _unique(context.astype(np.uint64) << np.uint64(bits) | word.astype(np.uint64))
    context, word = (gram >> np.uint64(bits)).astype(np.int64), (gram & np.uint64((1 << bits) - 1)).astype(np.int64)
    return context, word if words is None else words[word].astype(np.int64), where, at


def _among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which numbers of x are among few sorted ones."""
    if not len(few):
        return np.zeros(len(x), bool)
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _requests(block: int, bucket: np.ndarray, pack) -> list[tuple]:
    """One row per run of a bucket, with what pack(first, past last) makes of it."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    if not len(edges):
        return []
    return [(block, int(bucket[a]), pack(a, b)) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True)]


def _blocks(docs: DataFrame, folds: int, fold: int, block_tokens: int, bits: int) -> DataFrame:
    """Rows of two kinds: a block's body (documents and tokens), and its requests for unigram counts."""

    def build(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def emit(block):
            tokens, n = np.concatenate(hashes), np.concatenate(sizes)
            train = np.repeat(np.array([not held_out(d, folds, fold) for d in ids]), n)
            unique, local = np.unique(tokens, return_inverse=True)
            counts = np.bincount(local[train], minlength=len(unique))
            doc = np.array([0 if d is None else d for d in ids], np.int64).view(np.uint64)
            null = np.array([d is None for d in ids], np.uint8)
            rows = _requests(block, (unique >> np.uint64(64 - bits)).astype(np.int64), lambda a, b: _pack(unique[a:b], counts[a:b]))
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * (1 + len(rows))), pa.array([None, *(r[1] for r in rows)], pa.int32()), pa.array([None, *(r[2] for r in rows)], pa.binary()), pa.array([_pack(doc, null, n, local)] + [None] * len(rows), pa.binary())],
                names=["block", "bucket", "ask", "body"],
            )

        total = 0
        for batch in batches:
            for a, b, words in runs(batch, lower=True, limit=1 << 19):
                h, counts = words.hashes(), words.counts
                n = counts + 1
                out = np.empty(len(h) + b - a, np.uint64)
                ends = np.cumsum(n) - 1
                word = np.ones(len(out), bool)
                word[ends] = False
                out[word], out[ends] = h, END_HASH
                ids += batch.column(0).slice(a, b - a).to_pylist()
                sizes.append(n)
                hashes.append(out)
                total += len(out)
                if total >= block_tokens:
                    yield emit(part << 32 | seq)
                    ids, sizes, hashes, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield emit(part << 32 | seq)

    return docs.mapInArrow(build, "block long, bucket int, ask binary, body binary")


def _exchange(asked: DataFrame, table, shape: str) -> DataFrame:
    """asked: block, bucket, ask. Rows (block, bucket, told), and one with a null block per bucket.

    table(bucket, asks) gives the answers in order of the asks, and the columns of the null block's row.
    """

    def add_up(rows: pa.Table) -> pa.Table:
        bucket, blocks = rows.column("bucket")[0].as_py(), rows.column("block").to_pylist()
        told, extra = table(bucket, [_unpack(x.as_py()) for x in rows.column("ask")])
        n = len(blocks)
        columns = {"block": pa.array([*blocks, None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "told": pa.array([*told, None], pa.binary())}
        return pa.table(columns | {k: pa.array([None] * n + [v], pa.list_(pa.int64())) for k, v in extra.items()})

    return asked.groupBy("bucket").applyInArrow(add_up, f"block long, bucket int, told binary, {shape}")


def _answers(told: DataFrame, name: str) -> DataFrame:
    return told.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "told"))).alias(name))


def _told(answers) -> list[np.ndarray]:
    """A block's answers in the order in which it asked."""
    parts = [_unpack(x["told"]) for x in answers]
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]


def discounts(n: dict[int, int]) -> np.ndarray:
    """Good-Turing d(1..CUTOFF) from counts of counts, by Katz; d(0) is unused.

    Where counts of counts are too few for a value in (0, 1], that count loses a half instead.
    """
    out = np.ones(CUTOFF + 1)
    common = (CUTOFF + 1) * n.get(CUTOFF + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, CUTOFF + 1):
        value = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common) if n.get(r) and common < 1 else 0.0
        out[r] = value if 0 < value < 1 else (r - 0.5) / r
    return out


@dataclass
class Hot:
    """Contexts that are spread over partitions, under a thousand: sorted, with their numbers of n-grams of count
    1..CUTOFF and parts of the lower order's counts."""

    contexts: np.ndarray
    sums: np.ndarray | None = None

    def whole(self, context: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sums of contexts, a column each, those of hot ones over all partitions."""
        at = _among(context, self.contexts)
        sums[:, at] = self.sums[np.searchsorted(self.contexts, context[at])].T
        return sums


def by_count(whose: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """How many n-grams of count 1..CUTOFF each of n contexts has: a row for each count."""
    kinds = CUTOFF + 2
    return np.bincount(whose * kinds + np.minimum(c, CUTOFF + 1), minlength=n * kinds).reshape(n, kinds)[:, 1 : CUTOFF + 1].T


def lower_parts(whose: np.ndarray, c: np.ndarray, n: int, split: bool) -> list[np.ndarray]:
    """Counts of the lower order, by context, in parts that stay whole numbers when added up: those that are discounted by count, and the rest."""
    rest = np.bincount(whose, weights=np.where(c > CUTOFF, c, 0) if split else c, minlength=n).astype(np.int64)
    return [*(by_count(whose, c, n) if split else ()), rest]


def lower_mass(parts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """The discounted counts that sums of such parts come to."""
    return parts[0] if len(parts) == 1 else (discount[1:] * np.arange(1, CUTOFF + 1)) @ parts[:CUTOFF] + parts[CUTOFF]


def backoff(context: np.ndarray, kinds: np.ndarray, share: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha of contexts and what divides their n-grams' discounted counts, from their training count, their
    n-grams of count 1..CUTOFF, and the share that the lower order gives to all words seen after them.

    Where no n-gram is discounted one count is added to the context and left to words not seen after it. So a
    context's discounted counts and its backoff add up to one: the class of words never seen has a
    share in every lower order, and some of it is always left. Contexts never seen leave all to the lower order.
    """
    lost = ((1 - discount[1:]) * np.arange(1, CUTOFF + 1)) @ kinds
    none = lost <= 0
    whole = np.maximum(context, 1) + none
    alpha = np.where(none, 1.0, lost) / whole / np.maximum(1 - share, 1e-15)
    return np.where(context > 0, alpha, 1.0), whole


@dataclass
class Level:
    """Distinct n-grams of a block in order of bucket, context and word."""

    at: np.ndarray  # n-gram of each position
    where: np.ndarray  # a position of each n-gram
    bucket: np.ndarray
    context: np.ndarray
    word: np.ndarray
    runs: np.ndarray  # first n-gram of each run of one bucket and context

    def asks(self, block: int, seen: np.ndarray, lower: np.ndarray) -> list[tuple]:
        """Rows for the table: contexts, how many words of each, the words, training counts here, counts of the lower order."""

        def pack(a, b):
            run = self.runs[np.searchsorted(self.runs, a) : np.searchsorted(self.runs, b)]
            sizes = np.diff(run, append=b)
            return _pack(self.context[run], self.word[a:b], np.concatenate([sizes, seen[a:b], lower[a:b]]))

        return _requests(block, self.bucket, pack)

    def spread(self, of_runs: np.ndarray) -> np.ndarray:
        return np.repeat(of_runs, np.diff(self.runs, append=len(self.context)))


def _buckets(context: np.ndarray, word: np.ndarray, contexts: np.ndarray, words: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """By context; the n-grams of a hot one are spread by their word. context and word are places among contexts and words."""

    def bucket(context, salt):
        return (mix((context * 131 + salt).astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)

    out = bucket(contexts, 0)[context]
    at = np.flatnonzero(_among(contexts, hot)[context])
    out[at] = bucket(contexts[context[at]], words[word[at]] % 64 + 1)
    return out


def _level(context: np.ndarray, word: np.ndarray, contexts: np.ndarray, words: np.ndarray, bucket: np.ndarray) -> Level:
    """context, word: those of each position by their places among contexts and words."""
    context, word, where, at = _grams(context, word)
    bucket = bucket[where]
    order = np.argsort(bucket, kind="stable")  # of 16 bits: by digits
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bucket, context, word = bucket[order].astype(np.int64), contexts[context[order]], words[word[order]]
    runs = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(context, prepend=-1) != 0))
    return Level(place[at], where[order], bucket, context, word, runs)


def _table(split: bool, hot: np.ndarray, often_over: float):
    """The part of a count table that one partition makes, and its answers. split: whether the lower order's counts
    are discounted. Pairs of counts over often_over are reported: they are hot contexts of triples."""

    def table(_bucket_no, asks):
        asks = [(a[0].astype(np.int64), a[2][: len(a[0])].astype(np.int64), a[1], *a[2][len(a[0]) :].reshape(2, -1)) for a in asks]
        context = np.concatenate([a[0] for a in asks])
        first, second, _, local = _grams(context >> 32, context & 0xFFFFFFFF)
        contexts, n = first << 32 | second, len(first)
        of_asks = np.split(local, np.cumsum([len(a[0]) for a in asks])[:-1])
        whose, word, where, at = _grams(np.repeat(local, np.concatenate([a[1] for a in asks])), np.concatenate([a[2] for a in asks]))
        c = np.bincount(at, weights=np.concatenate([a[3] for a in asks]), minlength=len(word)).astype(np.int64)
        lower = np.concatenate([a[4] for a in asks])[where].astype(np.int64)
        seen = c > 0
        sums = np.stack([*by_count(whose, c, n), *lower_parts(whose[seen], lower[seen], n, split)])
        sums = sums.astype(np.int32 if sums.max(initial=0) < 1 << 31 else np.int64)
        often = contexts[whose[c > often_over]] << 32 | word[c > often_over]
        told, cut = [], np.cumsum([0] + [len(a[2]) for a in asks])
        for k in range(len(asks)):
            mine = at[cut[k] : cut[k + 1]]
            # all sums as one array: a message is small, and every array costs the tables of its code
            x, y = _pack(c[mine]), _pack(np.take(sums, of_asks[k], 1).reshape(-1))
            told.append(len(x).to_bytes(8, "little") + x + y)
        parts = np.flatnonzero(_among(contexts, hot))
        kinds = np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
        return told, {"kinds": kinds.tolist(), "often": often.tolist(), "context": contexts[parts].tolist(), "parts": sums[:, parts].T.reshape(-1).tolist()}

    return table


_EXTRA = "kinds array<long>, often array<long>, context array<long>, parts array<long>"


def _summary(told: DataFrame, hot: np.ndarray, split: bool) -> tuple[np.ndarray, Hot, np.ndarray]:
    """Discounts, sums over the parts of hot contexts, and the numbers of frequent n-grams: all of bounded size."""
    sums, k = told.where("block is null"), CUTOFF + (CUTOFF + 1 if split else 1)
    d = discounts({r + 1: int(x or 0) for r, x in enumerate(sums.agg(*(F.sum(F.col("kinds")[i]) for i in range(CUTOFF + 1))).first())})
    often = np.sort(np.array([int(r[0]) for r in sums.select(F.explode("often")).collect()], np.int64))
    each = sums.where("size(context) > 0").select(F.explode(F.expr(f"transform(sequence(0, size(context) - 1), i -> struct(context[i] as c, slice(parts, i * {k} + 1, {k}) as k))")).alias("x"))
    added = {int(r["c"]): r for r in each.groupBy("x.c").agg(*(F.sum(F.expr(f"x.k[{i}]")).alias(f"k{i}") for i in range(k))).collect()}
    parts = np.array([[added[h][f"k{i}"] if h in added else 0.0 for i in range(k)] for h in hot.tolist()]).reshape(-1, k)
    return d, Hot(hot, parts), often


def _heard_counts(answers) -> np.ndarray:
    """What a block was told: the count of each n-gram."""
    return np.concatenate([_unpack(b[8 : 8 + int.from_bytes(b[:8], "little")])[0] for b in (x["told"] for x in answers)]).astype(np.int64)


def _heard_sums(answers, width: int) -> np.ndarray:
    """And the sums of each run, a column each."""
    return np.concatenate([_unpack(b[8 + int.from_bytes(b[:8], "little") :])[0].reshape(width, -1) for b in (x["told"] for x in answers)], 1).astype(float)


@dataclass
class Model:
    """What every block needs: its size doesn't depend on the corpus."""

    total: int  # training tokens
    types: int  # training words
    unseen: int  # Good-Turing's count of all words never seen
    hot: list[Hot]  # by order of the context
    discount: list[np.ndarray]  # of pairs, of triples


class Block:
    """Documents, tokens, and the levels that have been answered so far."""

    def __init__(self, body: bytes, uni, model: Model, bits: tuple[int, int]):
        doc, null, n, local = _unpack(body)
        self.model, self.bits, self.n = model, bits, n.astype(np.int64)
        self.ids = [None if z else d for d, z in zip(doc.view(np.int64).tolist(), null.tolist(), strict=True)]
        counts, number = _told(uni)
        self.words, _, rank = _unique(number)
        self.words = self.words.astype(np.int64)
        # each word by its place among the block's
        self.count, self.word = counts[local], rank[local]
        self.starts = np.cumsum(self.n) - self.n
        # a document's first token follows the end of a text, which is every document's last token
        before, self.before_count = np.empty_like(self.word), np.empty_like(self.count)
        before[1:], self.before_count[1:] = self.word[:-1], self.count[:-1]
        end = self.n[0] - 1
        before[self.starts], self.before_count[self.starts] = self.word[end], self.count[end]
        self.pairs = _level(before, self.word, self.words, self.words, _buckets(before, self.word, self.words, self.words, bits[0], model.hot[0].contexts))
        self.lower = np.where(self.words[self.word] == 0, model.unseen, self.count)[self.pairs.where]

    def seen(self, level: Level, positions, folds: int, fold: int) -> np.ndarray:
        train = np.repeat(np.array([not held_out(d, folds, fold) for d in self.ids]), self.n)[positions]
        return np.bincount(level.at[train], minlength=len(level.context))

    def hear_triples(self, answers, turn: int | None = None) -> None:
        """The triples: those whose first two words were seen in training. With a turn, those that are asked in it."""
        p = self.pairs
        self.c2 = _heard_counts(answers)
        inner = np.ones(len(self.word), bool)
        inner[self.starts] = False
        inner[1:] &= self.c2[p.at[:-1]] > 0
        self.positions = np.flatnonzero(inner)
        context, contexts = p.at[self.positions - 1], p.context << 32 | p.word
        bucket = _buckets(context, self.word[self.positions], contexts, self.words, self.bits[1], self.model.hot[1].contexts)
        if turn is not None:
            mine = bucket % TURNS == turn
            self.positions, context, bucket = self.positions[mine], context[mine], bucket[mine]
        self.triples = _level(context, self.word[self.positions], contexts, self.words, bucket)

    def hear_pairs(self, answers) -> None:
        """Probabilities of pairs."""
        m, p = self.model, self.pairs
        sums = m.hot[0].whole(p.context[p.runs], _heard_sums(answers, CUTOFF + 1))
        alpha, whole = backoff(self.before_count[p.where[p.runs]], sums[:CUTOFF], lower_mass(sums[CUTOFF:], m.discount[0]) / (m.total + m.unseen), m.discount[0])
        self.whole = p.spread(whole)
        direct = m.discount[0][np.where(self.c2 <= CUTOFF, self.c2, 0)] * self.c2 / self.whole
        self.p2 = np.where(self.c2 > 0, direct, p.spread(alpha) * self.lower / (m.total + m.unseen))

    def log_probabilities(self, answers) -> np.ndarray:
        """Of each token, by its longest context that was seen."""
        out = np.log10(self.p2)[self.pairs.at]
        if len(self.positions):
            m, t, c3 = self.model, self.triples, _heard_counts(answers)
            sums = m.hot[1].whole(t.context[t.runs], _heard_sums(answers, 2 * CUTOFF + 1))
            place = self.positions[t.where]  # of each triple
            pair = self.pairs.at[place]
            first = pair[t.runs]
            alpha, whole = backoff(self.c2[self.pairs.at[place[t.runs] - 1]], sums[:CUTOFF], lower_mass(sums[CUTOFF:], m.discount[0]) / self.whole[first], m.discount[1])
            direct = m.discount[1][np.where(c3 <= CUTOFF, c3, 0)] * c3 / t.spread(whole)
            out[self.positions] = np.log10(np.where(c3 > 0, direct, t.spread(alpha) * self.p2[pair]))[t.at]
        return out


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2, block_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) % folds is `fold` are held out of training; a null id is trained on.
    A null or empty text is its end alone. Equal rows each count. Without training rows counts are 0.
    No rows give no rows; other columns of docs aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # one partition of a table for about a million requests
    tokens = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    bits = max(4, math.ceil(math.log2(max(1, tokens / 4 / (1 << 21)))))
    pair_bits, triple_bits = bits + 1, max(5, math.ceil(math.log2(max(1, tokens / (1 << 20)))))
    blocks = keep(_blocks(docs, folds, fold, block_tokens, bits), "blocks")

    def unigram_table(bucket, asks):
        keys, at = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([a[1] for a in asks]), minlength=len(keys)).astype(np.int64)
        seen = counts[counts > 0]
        if len(seen) >= 1 << (32 - bits):
            raise ValueError("more words than numbers of 32 bits")
        # numbers from 1 on, small ones for frequent words; words not seen in training have 0
        top = np.argsort(-counts, kind="stable")[: len(seen)]
        number = np.zeros(len(keys), np.int64)
        number[top] = (np.arange(len(top)) << bits | bucket) + 1
        cut = np.cumsum([0] + [len(a[0]) for a in asks])
        told = [_pack(counts[at[a:b]], number[at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        top = top[counts[top] * 1000 > seen.sum()]
        return told, {"totals": [int(seen.sum()), len(seen), int((seen == 1).sum())], "words": number[top].tolist(), "counts": counts[top].tolist()}

    told_1 = keep(_exchange(blocks.where("ask is not null").select("block", "bucket", "ask"), unigram_table, "totals array<long>, words array<long>, counts array<long>"), "unigrams")
    sums = told_1.where("block is null")
    total, types, once = (int(x or 0) for x in sums.agg(*(F.sum(F.col("totals")[i]) for i in range(3))).first())
    frequent = sums.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where(F.col("x.counts") * 1000 > total).collect()  # under 1,000
    none = np.zeros(0, np.int64)
    unset = Hot(none, np.zeros((0, 2 * CUTOFF + 1)))
    model = Model(total, types, max(once, 1), [Hot(np.sort(np.array([r["x"]["words"] for r in frequent], np.int64))), unset], [np.ones(CUTOFF + 1)] * 2)
    known = keep(blocks.where("body is not null").select("block", "body").join(_answers(told_1, "uni"), "block"), "bodies")
    drop(blocks, told_1)
    levels = (pair_bits, triple_bits)

    def asking(step):
        def ask(batches):
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() if i != 1 else batch.column(i) for i in range(batch.num_columns)), strict=True):
                    rows = step(row[0], Block(row[1].as_py(), row[2], model, levels), *row[3:])
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "bucket", "ask"])

        return ask

    def pairs_of(block, b):
        return b.pairs.asks(block, b.seen(b.pairs, slice(None), folds, fold), b.lower)

    asked = known.mapInArrow(asking(pairs_of), "block long, bucket int, ask binary")
    told_2 = keep(_exchange(asked, _table(False, model.hot[0].contexts, total / 1000), _EXTRA), "pairs")
    d2, hot_1, often = _summary(told_2, model.hot[0].contexts, False)
    model.hot, model.discount = [hot_1, Hot(often, np.zeros((len(often), 2 * CUTOFF + 1)))], [d2, model.discount[1]]
    bodies, known = known, keep(known.join(_answers(told_2, "bi"), "block"), "bodies")
    drop(bodies, told_2)

    def triples_of(turn):
        def asks(block, b, bi):
            b.hear_triples(bi, turn)
            return b.triples.asks(block, b.seen(b.triples, b.positions, folds, fold), b.c2[b.pairs.at[b.positions[b.triples.where]]])

        return asks

    # in turns, each for some of the buckets, so that requests of a part only are on disk at a time
    told_3, parts = None, []
    for turn in range(TURNS):
        asked = known.select("block", "body", "uni", "bi").mapInArrow(asking(triples_of(turn)), "block long, bucket int, ask binary")
        part = keep(_exchange(asked, _table(True, often, math.inf), _EXTRA), f"triples-{turn}")
        parts.append(part)
        told_3 = part if told_3 is None else told_3.union(part)
    d3, hot_2, _ = _summary(told_3, often, True)
    model.hot, model.discount = [hot_1, hot_2], [d2, d3]

    def score(batches):
        for batch in batches:
            for body, uni, bi, tri in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                b = Block(body.as_py(), uni, model, levels)
                b.hear_triples(bi)
                b.hear_pairs(bi)
                logp = b.log_probabilities(tri)
                base = np.log10(b.count + 1) - math.log10(model.total + model.types + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, pa.int64()), pa.array([held_out(d, folds, fold) for d in b.ids], pa.bool_()), pa.array(b.n), pa.array(np.add.reduceat((b.count > 0).astype(np.int64), b.starts)), pa.array(np.full(len(b.n), model.total)), pa.array(np.add.reduceat(base, b.starts)), pa.array(np.add.reduceat(logp, b.starts))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    # in turns again: the bodies of a part of the blocks only are on their way at a time
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = None
    for turn in range(TURNS):
        mine = F.pmod(F.xxhash64("block"), F.lit(TURNS)) == turn
        whole = known.where(mine).join(_answers(told_3.where(mine), "tri"), "block", "left").select("body", "uni", "bi", "tri")
        part = keep(whole.mapInArrow(score, shape), f"scores-{turn}")
        out = part if out is None else out.union(part)
    drop(known, *parts)
    return out
