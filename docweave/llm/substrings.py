"""Substring dedup: runs of `words` words that an earlier document holds too are found and cut.

1. Every document names anchors: in each run of `words` words, the phrase of `phrase` words with the
   least hash. Equal runs name equal phrases, and only about 2/(words - phrase) of all phrases are
   named. Documents with equal word sequences are one content, which its smallest id stands for.
2. A phrase that two contents or more name, by hash and word by word (a byte each), is a confirmed
   passage. Passages are dealt to shards by ranges of their hash, and an Aho-Corasick automaton is
   compiled of each shard's passages, whichever documents they are from.
3. Documents stream through the automata of the shards that hold passages they named. Only what an automaton finds is an
   occurrence. Runs whose phrase of least hash stands at an occurrence are candidates; their 128-bit
   hashes decide, over the whole corpus, which ones start in a document with a smaller id.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import drop, keep, skew_split, small_batches
from docweave.llm._text import Words, column_bytes, runs

_SECOND = 0xC2B2AE3D27D4EB4F | 1
_PLACE = np.uint64((1 << 28) - 1)


def _sequence_hash(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash per document of its sequence of word hashes."""
    out = np.empty(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out[i] = int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
    return out


def named_phrases(words: Words, h: np.ndarray, length: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all phrases; per run of `length` words the place of the phrase it names; which runs lie in one document."""
    g, _ = words.window_hashes(h, phrase)
    n, span = len(h), length - phrase + 1
    if n < length:
        return g, np.zeros(n, np.int64), np.zeros(n, bool)
    least = (g & ~_PLACE) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: n - span + 1], least[span - size : span - size + n - span + 1])
    chosen = np.zeros(n, np.int64)
    chosen[: n - length + 1] = (least[: n - length + 1] & _PLACE).astype(np.int64)
    return g, chosen, np.arange(n) + length <= np.repeat(words.bounds[1:], words.counts)


def _prints(h: np.ndarray) -> np.ndarray:
    """One byte a word: the alphabet of the automata."""
    return (h >> np.uint64(56)).astype(np.uint8)


def _survey(docs: DataFrame, length: int, phrase: int) -> DataFrame:
    def survey(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b, words in runs(batch):
                h1, h2 = words.hashes(), words.hashes(_SECOND)
                g, chosen, inside = named_phrases(words, h1, length, phrase)
                doc = words.doc()
                picks = np.unique(chosen[inside])
                # one row per phrase and document
                order = np.lexsort((g[picks], doc[picks]))
                picks = picks[order]
                new = np.ones(len(picks), bool)
                new[1:] = (g[picks][1:] != g[picks][:-1]) | (doc[picks][1:] != doc[picks][:-1])
                picks = picks[new]
                ends = np.searchsorted(doc[picks], np.arange(b - a + 1)).astype(np.int32)
                prints = _prints(h1)[picks[:, None] + np.arange(phrase)]
                texts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(phrase), len(picks), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())
                named = pa.StructArray.from_arrays([pa.array(g[picks].view(np.int64)), texts], names=["gram", "print"])
                sha = [hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).hexdigest() for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(_sequence_hash(h1, words.bounds)), pa.array(_sequence_hash(h2, words.bounds)), pa.array(sha), pa.ListArray.from_arrays(pa.array(ends), named)], names=["doc_id", "n_words", "c1", "c2", "sha", "named"])

    return docs.mapInArrow(survey, "doc_id long, n_words long, c1 long, c2 long, sha string, named array<struct<gram:long,print:binary>>")


def compiled(passages: list[bytes]) -> ahocorasick.Automaton | None:
    """The automaton of a shard's passages, each written as one byte a word."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in passages:
        automaton.add_word(p.decode("latin-1"), 1)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton | None, prints: np.ndarray, bounds: np.ndarray, phrase: int) -> np.ndarray:
    """For each word of some documents whether a passage of the automaton begins there (one word more at the end)."""
    found = np.zeros(len(prints) + 1, bool)
    text = prints.tobytes().decode("latin-1")
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if automaton is not None and e - s >= phrase:
            ends = np.fromiter((at for at, _ in automaton.iter(text, s, e)), np.int64)
            found[ends - phrase + 1] = True
    return found


#: Passages of a shard, whose automaton takes about 80 MB, and characters that stream through one compiled automaton.
SHARD_PASSAGES, STREAM = 100_000, 32 << 20


def _locate(dealt: DataFrame, length: int, phrase: int) -> DataFrame:
    """dealt: part, kind, print of a passage (kind 0) or doc_id, text, carry of a document (kind 1); a part's passages come first.

    Runs whose phrase of least hash stands where the part's automaton finds a passage; the text goes along if `carry`.
    """

    def locate(batches):
        part, passages, automaton = None, [], None
        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(parts, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0)).tolist()
            for s, e in zip(edges, [*edges[1:], len(parts)], strict=True):
                if parts[s] != part:
                    part, passages, automaton = parts[s], [], None
                if kinds[s] == 0:
                    passages += batch.column(2).slice(s, e - s).to_pylist()
                    continue
                if passages:
                    passages, automaton = [], compiled(passages)
                docs = batch.slice(s, e - s)
                carry = docs.column(5).to_pylist()
                for a, b, words in runs(docs):
                    h1, h2 = words.hashes(), words.hashes(_SECOND)
                    bounds = words.bounds
                    found = occurrences(automaton, _prints(h1), bounds, phrase)
                    _, chosen, inside = named_phrases(words, h1, length, phrase)
                    runs_of = np.flatnonzero(inside & found[chosen])
                    w1 = words.window_hashes(h1, length)[0].view(np.int64)[runs_of]
                    w2 = words.window_hashes(h2, length)[0].view(np.int64)[runs_of]
                    ends = np.searchsorted(runs_of, bounds).astype(np.int32)
                    at = (runs_of - bounds[words.doc()[runs_of]]).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at, w1, w2)]
                    texts = [words.data[words.offsets[i] : words.offsets[i + 1]].tobytes() if carry[a + i] else None for i in range(b - a)]
                    yield pa.RecordBatch.from_arrays([docs.column(3).slice(a, b - a), pa.array(_sequence_hash(h1, bounds)), pa.array(texts, pa.binary()), *lists], names=["doc_id", "c1", "words", "at", "w1", "w2"])

    return dealt.mapInArrow(locate, "doc_id long, c1 long, words binary, at array<int>, w1 array<long>, w2 array<long>")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for words, at in zip(batch.column(2), batch.column(3), strict=True):
                parts = words.as_py().split()
                gone = np.zeros(len(parts) + 1, np.int64)
                start = np.unique(at.values.to_numpy())
                np.add.at(gone, start, 1)
                np.add.at(gone, start + length, -1)
                drop = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                out[0].append(int(drop.sum()))
                out[1].append(hashlib.sha256(b" ".join(p for p, d in zip(parts, drop.tolist(), strict=True) if not d)).hexdigest())
                out[2].append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], spans)], names=["doc_id", "c1", "n", "kept", "spans"])

    return rows.mapInArrow(cut, "doc_id long, c1 long, n long, kept string, spans array<struct<start:int,end:int>>")


def repeated_passages(docs: DataFrame, length: int = 50, phrase: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, removed (ranges of words).

    A word is removed if a run of `length` words over it also starts in a document with a smaller
    id; all judged on the input. Null and empty texts have no words. Rows with a null id are neither
    earlier nor later than any: they stay whole. Equal rows get equal results; other columns of docs
    aren't read; no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = keep(_survey(docs, length, phrase), "survey")
    contents = survey.where("doc_id is not null").groupBy("c1", "c2", "n_words").agg(F.min("doc_id").alias("stands"))
    rows = keep(survey.select("doc_id", "c1", "c2", "n_words", "sha").join(contents, ["c1", "c2", "n_words"], "left"), "documents")
    # one content, one document: its smallest id
    firsts = survey.join(contents.select("c1", "c2", F.col("stands").alias("doc_id")), ["c1", "c2", "doc_id"], "left_semi").where(F.size("named") > 0)
    names = firsts.select("doc_id", F.explode("named").alias("x")).select("doc_id", "x.gram", "x.print")
    confirmed = names.groupBy("gram", "print").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram", "print")
    passages = keep(confirmed, "passages")
    # shards are ranges of the passages' hashes; a shard's documents are those that named one of its passages
    shards = max(1, -(-passages.count() // SHARD_PASSAGES))
    splits = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // (shards * STREAM)))
    shard = F.floor(F.shiftrightunsigned("gram", 33) * F.lit(shards) / F.lit(1 << 31)).cast("int")
    wanted = names.join(passages, ["gram", "print"]).groupBy("doc_id").agg(F.sort_array(F.collect_set(shard)).alias("shards"))
    part = F.col("shard") * F.lit(splits) + F.col("split")
    none = {"print": F.lit(None).cast("binary"), "doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "carry": F.lit(False)}

    def dealt(frame: DataFrame, kind: int, **columns) -> DataFrame:
        return frame.select(part.cast("int").alias("part"), F.lit(kind).alias("kind"), *(columns.get(k, v).alias(k) for k, v in none.items()))

    routed = docs.join(wanted, "doc_id").withColumn("split", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(splits))).select("doc_id", "text", "split", F.col("shards")[0].alias("own"), F.explode("shards").alias("shard"))
    compiled_for = passages.withColumn("shard", shard).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    streams = dealt(compiled_for, 0, **{"print": F.col("print")}).union(dealt(routed, 1, doc_id=F.col("doc_id"), text=F.col("text"), carry=F.col("shard") == F.col("own")))
    streams = streams.repartition(max(4 * shards * splits, 8), "part").sortWithinPartitions("part", "kind")
    found = keep(_locate(streams, length, phrase).where("size(at) > 0 or words is not null"), "occurrences")
    drop(survey, passages)
    candidates = found.where("size(at) > 0").select("doc_id", "c1", F.explode(F.arrays_zip("at", "w1", "w2")).alias("x")).select("doc_id", "c1", "x.at", "x.w1", "x.w2")
    # a table of its own, so that the join has a shuffle on either side and windows of very many documents are split
    first = keep(candidates.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "windows")
    with skew_split(spark):
        gone = keep(candidates.join(first.hint("merge"), ["w1", "w2"]).where("first < doc_id").groupBy("doc_id", "c1").agg(F.collect_list("at").alias("at")), "repeated")
    drop(first)
    cut = _cut(found.where("words is not null").select("doc_id", "c1", "words").join(gone, ["doc_id", "c1"]), length).dropDuplicates(["doc_id", "c1"])
    copy = (F.col("stands") < F.col("doc_id")) & (F.col("n_words") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return rows.join(cut, ["doc_id", "c1"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("removed"),
    )
