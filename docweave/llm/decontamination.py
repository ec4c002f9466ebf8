"""Benchmark decontamination: training passages query a BM25 index of the test items.

The inverted index holds, for each term, items in blocks with the term's weight in each and the
greatest weight per block; an item's weights are divided by the score that its own text gets, so one
threshold serves all items. Every passage of every text is a query (half overlapping, long enough to
hold the longest item whole). As in block-max WAND, bounds come before scores: the sum of term
maxima dismisses passages, the sums of block maxima dismiss blocks, and only blocks left are scored.
All items at or above the threshold are retrieved and then verified: the share of the question's and
of the answer's five-word shingles that stand in the passage, or for parts shorter than five words
whether they stand there as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import row_type, small_batches, with_rows
from docweave.llm._text import Words, column_bytes, runs, without_marks

K1, B = 1.2, 0.75
SHINGLE = 5
#: Items in an index, which a worker holds; more items are more indexes, each of which all texts query.
INDEX_ITEMS = 50_000
#: Characters of its items, about (one item is never split); the driver holds one shard at a time.
INDEX_CHARACTERS = 32 << 20


def _shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of `size` words; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    words = Words.__new__(Words)
    words.bounds = np.array([0, len(h)])
    k = min(size, len(h))
    return np.unique(words.window_hashes(h, k)[0][: len(h) - k + 1] + np.uint64(k))


class Index:
    """items: (id, text). A null or empty text has no terms and is never retrieved.

    With by_parts an item's weights are divided by the score of its question instead of its whole
    text, so that the question alone reaches any threshold up to one; `scale` leads back.
    """

    def __init__(self, items: list[tuple[int, str | None]], block: int = 16, by_parts: bool = False):
        self.ids = np.array([i for i, _ in items], np.int64)
        data, offsets = column_bytes(pa.array([t for _, t in items], pa.large_string()))
        words = without_marks(Words(data, offsets, True))
        h, n = words.hashes(), words.counts
        item = words.doc()
        self.longest = int(n.max(initial=0))
        cut = np.maximum(1, np.ceil(n * 0.75).astype(int))
        pair, at, tf = np.unique(np.stack([h, item.astype(np.uint64)], 1), axis=0, return_inverse=True, return_counts=True) if len(h) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.terms, start, df = np.unique(pair[:, 0], return_index=True, return_counts=True)
        of = pair[:, 1].astype(np.int64)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[of] / max(n.mean(), 1e-9))) if len(of) else np.zeros(0)
        own = np.bincount(of, weights=weight, minlength=len(items))
        asked = np.bincount(at.reshape(-1), weights=np.arange(len(h)) < (words.bounds[:-1] + cut)[item], minlength=len(of)) > 0
        norm = np.bincount(of, weights=np.where(asked, weight, 0.0), minlength=len(items)) if by_parts else own
        self.scale = norm / np.maximum(own, 1e-300)
        self.item, self.weight = of, weight / norm[of] if len(of) else weight
        self.start = np.append(start, len(of))
        self.block = block
        self.blocks = -(-len(items) // block)
        # postings of each term lie in order of item, so the entries of a block are a run
        term_of = np.repeat(np.arange(len(self.terms)), df)
        key = term_of * max(self.blocks, 1) + of // block
        edges = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_max = np.maximum.reduceat(self.weight, edges) if len(edges) else np.zeros(0)
        self.block_of, self.block_run = (key[edges] % max(self.blocks, 1)), np.append(edges, len(of))
        self.block_start = np.searchsorted(term_of[edges], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        # terms of many items: a passage has each at most once, so their maxima add up to a constant
        self.common = df > max(2, len(items) // 50)
        self.common_sum = float(self.term_max[self.common].sum())
        self.question = [_shingles(h[a : a + c]) for a, c in zip(words.bounds[:-1], cut, strict=True)]
        self.answer = [_shingles(h[a + c : b]) for a, b, c in zip(words.bounds[:-1], words.bounds[1:], cut, strict=True)]
        self.n_question, self.n_answer, self.n_whole = np.minimum(cut, n), n - np.minimum(cut, n), n
        self.whole = [_shingles(h[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """The term of each hash, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def retrieve(self, term: np.ndarray, first: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above `least`. term: of each word; passages: first word and size."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not len(self.terms) or not len(first):
            return none
        value = np.where(term >= 0, self.term_max[term], 0.0)
        frequent = (term >= 0) & self.common[term]
        sums = [np.concatenate([[0], np.cumsum(np.where(x, value, 0.0))]) for x in (~frequent, frequent)]
        rare, often = (s[first + size] - s[first] for s in sums)
        left = np.flatnonzero(rare + np.minimum(often, self.common_sum) >= least - 1e-9)
        if not len(left):
            return none
        # the distinct terms of the passages left
        owner = np.repeat(left, size[left])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size[left]) - size[left], size[left]) + first[owner]
        known = term[place] >= 0
        key = np.unique(owner[known] * len(self.terms) + term[place[known]])
        passage, t = key // len(self.terms), key % len(self.terms)
        n = self.block_start[t + 1] - self.block_start[t]
        entry = np.repeat(self.block_start[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell, at = np.unique(np.repeat(passage, n) * self.blocks + self.block_of[entry], return_inverse=True)
        bound = np.bincount(at, weights=self.block_max[entry], minlength=len(cell))
        stay = (bound >= least - 1e-9)[at]
        entry, where = entry[stay], cell[at[stay]] // self.blocks
        n = self.block_run[entry + 1] - self.block_run[entry]
        posting = np.repeat(self.block_run[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair, at = np.unique(np.repeat(where, n) * len(self.ids) + self.item[posting], return_inverse=True)
        score = np.bincount(at, weights=self.weight[posting], minlength=len(pair))
        good = score >= least - 1e-9
        return pair[good] // len(self.ids), pair[good] % len(self.ids), score[good]


def passages(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of half-overlapping passages over all words."""
    n, step = np.diff(bounds), max(1, size // 2)
    count = np.where(n > 0, np.maximum(1, -(-(n - size + step) // step)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][doc] + k * step
    return first, np.minimum(size, bounds[1:][doc] - first), doc


def _share(part: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(part, there, assume_unique=True).mean()) if len(part) else 1.0


def _part_share(part: np.ndarray, n: int, h: np.ndarray, there: np.ndarray) -> float:
    """The share of a part of n words in a passage of words h and five-word shingles `there`."""
    return _share(part, there if n >= SHINGLE else _shingles(h, max(1, int(n))))


def _indexes(items: DataFrame, item_col: str, item_text: str, by_parts: bool, passage_words: int):
    """(Index, words of a passage) for shards of the items, each bounded in items and in characters."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null and item_id is not null")
    n, size = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    shards = max(1, -(-n // INDEX_ITEMS), -(-(size or 0) // INDEX_CHARACTERS))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        index = Index(sorted((r["item_id"], r["text"]) for r in part.collect()), by_parts=by_parts)
        yield index, max(passage_words, 2 * index.longest)


def _leaks(index: Index, size: int, words: Words, least: float, overlap: float, by_parts: bool):
    """(document, item, score, overlaps of question, answer and whole) of verified passages."""
    words = without_marks(words)
    h = words.hashes()
    first, n, doc = passages(words.bounds, size)
    for p, i, s in zip(*index.retrieve(index.term_ids(h), first, n, least), strict=True):
        passage = h[first[p] : first[p] + n[p]]
        there = _shingles(passage)
        question = _part_share(index.question[i], index.n_question[i], passage, there)
        share = _part_share(index.whole[i], index.n_whole[i], passage, there) if by_parts else _share(index.whole[i], there)
        s = float(s * index.scale[i])
        if (share >= overlap and s >= least - 1e-9) or (by_parts and question >= overlap):
            yield int(doc[p]), int(index.ids[i]), s, question, _part_share(index.answer[i], index.n_answer[i], passage, there), share


def contaminated_passages(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.8, passage_words: int = 128, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", by_parts: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap, overlap), one per document and item found.

    An item is found in a passage whose BM25 score reaches `least` of the item's score of itself and
    that holds at least `overlap` of the item's shingles; the passage of most overlap is reported.
    The first three quarters of an item's words are its question, the rest its answer; parts of fewer
    than five words are one shingle of their own length. With by_parts both parts are verified on
    their own: the question suffices with any answer or none (an item is found where the score reaches
    `least` of the question's score of itself and at least `overlap` of the question's shingles
    stand), while an answer tells only together with so much of the question that the whole item
    reaches `overlap`; items of fewer than five words are then found as they are, and the passage of
    most overlap of question or item is reported. A-Z are lower-cased and marks at words' ends
    dropped. Null and empty texts and items find nothing; rows with one id count as that id's
    passages; no rows or items give no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
    found = None
    for index, size in _indexes(items, item_col, item_text, by_parts, passage_words):

        def search(batches, index=index, size=size):
            for batch in batches:
                ids = batch.column(0)
                out = [(ids[a + doc].as_py(), *rest) for a, _, words in runs(batch, lower=True) for doc, *rest in _leaks(index, size, words, least, overlap, by_parts)]
                columns = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])

        part = docs.mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    most = [F.greatest("question_overlap", "overlap")] if by_parts else []
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "overlap"), F.struct(*most, "overlap", "score"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_contaminated_rows(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.8, passage_words: int = 128, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, in whose own text no item nor the question of one is found.

    Each row is judged by its text alone, so null and repeated ids change nothing; columns may have any names.
    """
    small_batches(docs.sparkSession)
    for index, size in _indexes(items, item_col, item_text, True, passage_words):

        def clean(batches, index=index, size=size):
            for batch in batches:
                for a, b, words in runs(batch, lower=True):
                    leaky = np.zeros(b - a, bool)
                    leaky[[x[0] for x in _leaks(index, size, words, least, overlap, True)]] = True
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(~leaky))], names=["row"])

        docs = with_rows(docs, text_col).mapInArrow(clean, row_type(docs)).select("row.*")
    return docs
