"""Exact Jaccard join of word n-gram sets by a token-group matrix.

Documents with equal sets are one content. Under a global order of tokens (frequent ones last, else
by hash) two contents that link share tokens in short prefixes: the larger's first
n - ceil(t n) + 1, the smaller's first n - ceil(2t/(1+t) n) + 1; with `more` further tokens each
they share as many more. These tokens are the columns of the matrix.

1. Groups: a content joins the content with which it shares the most prefix tokens among those that
   stand for a token. A group is opened in chunks of bounded size, each with the group's head;
   links found there connect similar contents into larger groups.
2. Matrix: for each token the groups whose union of prefixes holds it, with the sizes there and the
   parities on which all members agree (bit k of a content: whether an odd number of its tokens falls
   on k). A query content differs from every member by at least as many tokens as it differs from
   these parities in bits; it shares at most as many prefix tokens with a member as with the union.
   Groups of other contents are opened only if both bounds allow a link.

Contents connected already need no further comparison; all others are settled by the bound or by
exact intersection. Frequent tokens only change the order, and so the cost, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from docweave.llm._graph import components
from docweave.llm._store import drop, keep, row_type, small_batches, with_rows
from docweave.llm._text import Words, mix, runs, slices

_SECOND = 0xA0761D6478BD642F | 1
_THIRD = 0xE7037ED1A0B428DB
_HOT = np.uint64(1 << 63)


def _need(n, num: int, den: int):
    """Least overlap of a set of n with a smaller one that links: ceil(num n / den)."""
    return -(-num * n // den)


def _need_equal(n, num: int, den: int):
    """Least overlap of a set of n with a larger one that links."""
    return -(-2 * num * n // (num + den))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes (63 bits) of each document, joined, and where each begins.

    A document of fewer words has its whole sequence as its one n-gram.
    """
    h = words.hashes()
    grams, inside = words.window_hashes(h, size)
    counts = words.counts
    n = np.where(counts >= size, counts - size + 1, counts > 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((counts > 0) & (counts < size))
    token, long = np.empty(bounds[-1], np.uint64), np.ones(bounds[-1], bool)
    for d in short.tolist():
        x = np.array([counts[d]], np.uint64)
        for k in range(int(words.bounds[d]), int(words.bounds[d + 1])):
            x = mix(x * np.uint64(31) + h[k : k + 1])
        token[bounds[d]] = x[0]
    long[bounds[short]] = False
    token[long] = grams[inside]
    token >>= np.uint64(1)
    _sort_parts(token, bounds)
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    new[bounds[:-1][n > 0]] = True
    return token[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def _sort_parts(x: np.ndarray, bounds: np.ndarray) -> None:
    """Sort each document's part in place: much cheaper than one sort by document and value."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            x[a:b].sort()


def _sums(token: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(token + np.uint64(salt)))]).astype(np.uint64)
    n = np.diff(bounds).astype(np.uint64)
    return mix((total[bounds[1:]] - total[bounds[:-1]]) + n * np.uint64(0x9E3779B97F4A7C15))


def _content(token: np.ndarray, bounds: np.ndarray, clashes: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit key of each set (0 for the empty set); it doesn't depend on the order of its tokens.

    Keys in `clashes`, which two sets have by chance, are replaced by keys that a second sum tells apart.
    """
    key = _sums(token, bounds, _SECOND)
    key[np.diff(bounds) == 0] = 0
    key = key.view(np.int64)
    if clashes is not None and len(clashes):
        at = np.isin(key, clashes)
        key[at] = mix(key[at].view(np.uint64) ^ _check(token, bounds)[at].view(np.uint64)).view(np.int64)
    return key


def _check(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A second, independent key: with the first one 128 bits."""
    return _sums(token, bounds, _THIRD).view(np.int64)


#: 64-bit words of the parities.
PARITY = 4


def _parities(token: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each set 64 * PARITY bits: whether an odd number of its tokens falls on each."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    bit = mix(token ^ np.uint64(_THIRD)) >> np.uint64(64 - 6 - (PARITY - 1).bit_length())
    one = np.uint64(1) << (bit & np.uint64(63))
    out = []
    for k in range(PARITY):
        x = np.zeros(len(bounds) - 1, np.uint64)
        if len(some):
            x[some] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), bounds[some])
        out.append(x.view(np.int64))
    return out


_BITS = [f"b{k}" for k in range(PARITY)]


def _sets(docs: DataFrame, size: int, clashes: np.ndarray | None = None) -> DataFrame:
    def sets(batches):
        for batch in batches:
            for a, b, words in runs(batch, lower=True):
                token, bounds = shingle_sets(words, size)
                columns = [np.diff(bounds).astype(np.int64), _content(token, bounds, clashes), _check(token, bounds), *_parities(token, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns)], names=["doc_id", "n", "content", "check", *_BITS])

    return docs.mapInArrow(sets, "doc_id long, n long, content long, check long, " + ", ".join(f"{b} long" for b in _BITS))


def _known_sets(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """The table of sets, and the keys that different sets have in common: n**2 / 2**65 are to be expected of n sets."""
    sets = keep(_sets(docs, size), "sets")
    twice = sets.groupBy("content").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("content").collect()
    clashes = np.array([r["content"] for r in twice], np.int64)
    return (keep(_sets(docs, size, clashes), "sets") if len(clashes) else sets), clashes


def _frequent(docs: DataFrame, size: int, most: int) -> np.ndarray:
    """Up to `most` tokens found in many documents, rarer first.

    Tasks count with bounded memory and report what they saw repeatedly; this only orders tokens, so
    it needs to be neither exact nor complete, and its size is `most` for any corpus.
    """
    room, block = 1 << 19, 1 << 21

    def count(batches):
        token, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        floor, waiting, size_ = 1, [], 0

        def merged():
            new = np.sort(np.concatenate(waiting))
            edges = np.flatnonzero(np.diff(new, prepend=new[0] + np.uint64(1)))
            both = np.concatenate([token, new[edges]])
            weight = np.concatenate([n, np.diff(edges, append=len(new))])
            by = np.argsort(both, kind="stable")
            both, weight = both[by], weight[by]
            edges = np.flatnonzero(np.diff(both, prepend=both[0] + np.uint64(1)))
            return both[edges], np.add.reduceat(weight, edges)

        def pruned(token, n, floor):
            while len(token) > room:
                floor += 1
                token, n = token[n >= floor], n[n >= floor]
            return token, n, floor

        for batch in batches:
            for _, _, words in runs(batch, lower=True):
                waiting.append(shingle_sets(words, size)[0])
                size_ += len(waiting[-1])
                if size_ >= block:
                    token, n, floor = pruned(*merged(), floor)
                    waiting, size_ = [], 0
        if size_:
            token, n, floor = pruned(*merged(), floor)
        stay = n >= max(floor, 3)
        token, n = token[stay], n[stay]
        if len(token) > most:
            top = np.argpartition(-n, most)[:most]
            token, n = token[top], n[top]
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    top = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "token").limit(most)
    table = top.toArrow()
    token, n = (table.column(c).to_numpy() for c in ("token", "n"))
    return token[np.lexsort((token, n))].view(np.uint64)


def _prefixes(docs: DataFrame, size: int, num: int, den: int, more: float, frequent: np.ndarray, clashes: np.ndarray) -> DataFrame:
    ranked = np.argsort(frequent)
    known = frequent[ranked]

    def prefixes(batches):
        for batch in batches:
            for _a, _b, words in runs(batch, lower=True):
                token, bounds = shingle_sets(words, size)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                content = _content(token, bounds, clashes)
                # frequent tokens have the highest bit and their rank, so that they come last
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    token = np.where(known[at] == token, _HOT | ranked[at].astype(np.uint64), token)
                    _sort_parts(token, bounds)
                place = np.arange(len(token)) - bounds[owner]
                extra = (n * more).astype(np.int64)
                probe, index = n - _need(n, num, den) + 1 + extra, n - _need_equal(n, num, den) + 1 + extra
                stay = place < probe[owner]
                token, owner, place = token[stay], owner[stay], place[stay]
                hot = token >= _HOT
                token[hot] = frequent[(token[hot] ^ _HOT).astype(np.int64)]
                columns = [token.view(np.int64), content[owner], n[owner].astype(np.int32), place < index[owner], hot]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "content", "n", "index", "hot"])

    return docs.mapInArrow(prefixes, "token long, content long, n int, index boolean, hot boolean")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _compare(role: list[int], content: list[int], sets: list[np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of one opened group, as a forest, and the members that they don't connect to the head.

    Heads and members are compared with each other unless connected; queries with all members.
    """
    n = [len(s) for s in sets]
    members = [i for i, r in enumerate(role) if r < 2]
    forest, links = _Forest(len(sets)), []

    def test(a: int, b: int) -> None:
        if content[a] == content[b] or forest.find(a) == forest.find(b) or den * min(n[a], n[b]) < num * max(n[a], n[b]):
            return
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if both * den >= num * (n[a] + n[b] - both):
            forest.join(a, b)
            links.append((content[a], content[b]))

    # the head first: most members need no more
    for m in members[1:]:
        test(members[0], m)
    left = [m for m in members if forest.find(m) != forest.find(members[0])] + [i for i, r in enumerate(role) if r == 2]
    if left and len(members) <= 8:
        for q in left:
            for m in members:
                test(m, q)
    elif left:
        # the group's union with its members by token
        token, owner = np.concatenate([sets[m] for m in members]), np.repeat(np.arange(len(members)), [n[m] for m in members])
        by = np.argsort(token, kind="stable")
        token, owner = token[by], owner[by]
        union, start = np.unique(token, return_index=True)
        start = np.append(start, len(token))
        sizes, root = np.array([n[m] for m in members]), np.array([content[m] for m in members])
        for q in left:
            at = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
            at = at[union[at] == sets[q]]
            if len(at) < _need(n[q], num, den):
                continue
            lengths = start[at + 1] - start[at]
            which = owner[np.repeat(start[at], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
            overlap = np.bincount(which, minlength=len(members))
            for m in np.flatnonzero((overlap * den >= num * (n[q] + sizes - overlap)) & (root != content[q])).tolist():
                if forest.join(q, members[m]):
                    links.append((content[members[m]], content[q]))
    apart = [content[m] for m in members if forest.find(m) != forest.find(members[0])]
    return links, apart


def _open_groups(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """rows: gid, chunk, chunks, role (0 head, 1 member, 2 query), content, packed. Links (a, b); and
    (a, null) for members that their chunk left apart from the head of a group of several chunks."""

    def opened(batches):
        open_ = zstandard.ZstdDecompressor()

        def settle(rows: list[tuple]):
            raw = [open_.decompress(r[5]) for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            data, sets = np.frombuffer(b"".join(raw), np.uint8), []
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)
                token, bounds = shingle_sets(words, size)
                sets += [token[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            links, gids = [], []
            at = 0
            while at < len(rows):
                end, seen, take = at, set(), []
                while end < len(rows) and rows[end][:2] == rows[at][:2]:
                    if (rows[end][3] == 2, rows[end][4]) not in seen:
                        seen.add((rows[end][3] == 2, rows[end][4]))
                        take.append(end)
                    end += 1
                if any(rows[i][3] < 2 for i in take):
                    found, apart = _compare([rows[i][3] for i in take], [rows[i][4] for i in take], [sets[i] for i in take], num, den)
                    links += found
                    if rows[at][2] > 1:
                        links += [(a, None) for a in apart]
                    gids += [rows[at][0]] * (len(links) - len(gids))
                at = end
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64()), pa.array(gids, pa.int64())], names=["a", "b", "gid"])

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            cut = len(held)
            while cut and held[cut - 1][:2] == held[-1][:2]:
                cut -= 1
            if cut:
                yield settle(held[:cut])
                held = held[cut:]
        if held:
            yield settle(held)

    dealt = rows.select("gid", "chunk", "chunks", "role", "content", "packed").repartition("gid", "chunk").sortWithinPartitions("gid", "chunk", "role", "content")
    return dealt.mapInArrow(opened, "a long, b long, gid long")


#: Members of a chunk, and n-grams in it: about so many, but for a single larger member.
CHUNK, CHUNK_GRAMS = 256, 1 << 20


def _chunked(members: DataFrame, contents: DataFrame) -> DataFrame:
    """members (gid, content): a chunk of bounded size for each, however large its group."""
    members = members.join(contents.select("content", "n"), "content")
    parts = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_GRAMS)).cast("int")
    sizes = members.groupBy("gid").agg(parts.alias("chunks"), F.min("content").alias("head"))
    return members.drop("n").join(sizes, "gid").withColumn("chunk", F.pmod(F.xxhash64("content"), F.col("chunks")).cast("int"))


def _differs_too_much(num: int, den: int) -> str:
    """Whether a query (n, q0..) and all members of a group (hi, and0.., or0..) differ in more bits than a link allows tokens."""
    bits = " + ".join(f"bit_count((q{k} ^ and{k}) & ~(and{k} ^ or{k}))" for k in range(PARITY))
    return f"({bits}) * {num + den} > (n + least(hi, n)) * {den - num}"


def _classes(docs: DataFrame, size: int, num: int, den: int, more: float, frequent: int) -> tuple[DataFrame, np.ndarray]:
    """docs (doc_id, text): rows doc_id, n, content, label; equal labels are one class. And the clashing keys."""
    made: list[DataFrame] = []  # tables that the result doesn't read

    def table(df: DataFrame, name: str) -> DataFrame:
        made.append(keep(df, name))
        return made[-1]

    sets, clashes = _known_sets(docs, size)
    contents = table(sets.where("n > 0").select("content", "n", *_BITS).dropDuplicates(["content"]), "contents")
    hot = _frequent(docs, size, frequent)
    tokens = _prefixes(docs, size, num, den, more, hot, clashes)
    kept_tokens = table(_shared_tokens(tokens), "tokens")

    # groups: the content that stands for most of one's tokens
    stands = kept_tokens.groupBy("token").agg(F.min("content").alias("gid"))
    shared = kept_tokens.join(stands, "token").where("content <> gid").groupBy("content", "gid").agg(F.count("*").alias("s"))
    # those that share a good part of the prefix are likely to link; the matrix settles the others
    likely = shared.join(contents.select("content", "n"), "content").where("20 * s >= n")
    best = table(likely.groupBy("content").agg(F.max_by("gid", F.struct("s", -F.col("gid"))).alias("gid")), "groups")
    members = best.union(best.select(F.col("gid").alias("content"), "gid").distinct())

    packed = table(_packed(docs, size, kept_tokens.select("content").distinct(), clashes), "texts")
    chunks = _chunked(members, contents)
    rows = chunks.join(packed, "content").select("gid", "chunk", "chunks", F.when(F.col("content") == F.col("head"), 0).otherwise(1).alias("role"), "content", "packed")
    # the head goes to every chunk
    each_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    heads = chunks.select("gid", "head", "chunks").distinct().where("chunks > 1").select("gid", F.col("head").alias("content"), "chunks", each_chunk)
    heads = heads.join(packed, "content").select("gid", "chunk", "chunks", F.lit(0).alias("role"), "content", "packed")
    opened = table(_open_groups(rows.union(heads), size, num, den), "links")
    links = opened.where("b is not null").select("a", "b")
    labels = components(links)

    # the matrix: which groups hold a token, with what sizes and parities
    labelled = table(kept_tokens.join(labels.withColumnRenamed("node", "content"), "content", "left").select("token", "content", "n", "index", F.coalesce("label", "content").alias("grp")), "labelled")
    # tokens that the same contents hold are one column, which counts for as many tokens: the pairs that a
    # column brings together then don't grow with the number of tokens that two contents share
    of, holders = ["column", "check", "df"], [F.bit_xor(F.xxhash64(F.lit(k), "content", "index")) for k in (1, 2)]
    by_token = labelled.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y"), F.count("*").alias("df"), holders[0].alias("column"), holders[1].alias("check"))
    several = table(by_token.where("x <> y").drop("x", "y"), "several")
    columns = labelled.join(several, "token").groupBy(*of, "content").agg(F.count("*").alias("w"), *(F.first(c).alias(c) for c in ("n", "index", "grp")))
    crossing = table(columns.join(contents.drop("n"), "content"), "crossing")
    agree = [f(b).alias(f"{name}{k}") for k, b in enumerate(_BITS) for f, name in ((F.bit_and, "and"), (F.bit_or, "or"))]
    matrix = crossing.where("index").groupBy(*of, "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), *agree)
    # a link needs `need` shared tokens: contents with fewer ask nothing, and the others leave out columns
    # that most documents hold, up to half of that number of tokens, and need the rest
    need = F.floor(F.ceil(F.col("n") * num / den) * F.lit(more)) + 1
    mine = Window.partitionBy("content")
    ranked = crossing.withColumn("need", need).withColumn("there", F.sum("w").over(mine)).withColumn("sum", F.sum("w").over(mine.orderBy(F.desc("df"), "column", "check").rowsBetween(Window.unboundedPreceding, 0)))
    asking = ranked.where((F.col("there") >= F.col("need")) & (F.col("sum") > F.floor(F.col("need") / 2)))
    queries = asking.select(*of, "content", "w", "n", "need", F.col("grp").alias("own"), *(F.col(b).alias(f"q{k}") for k, b in enumerate(_BITS)))
    sizes_fit = (F.col("own") != F.col("grp")) & (F.col("lo") <= F.col("n")) & (F.col("hi") * den >= F.col("n") * num)
    fits = sizes_fit & ~F.expr(_differs_too_much(num, den))
    shared_with = queries.join(matrix, of).where(fits).groupBy("content", "own", "grp", "need").agg(F.sum("w").alias("s"))
    asked = shared_with.where(F.col("s") >= F.col("need") - F.floor(F.col("need") / 2)).select("content", "own", F.col("grp").alias("gid"), "s")
    asked = table(asked, "asked")
    held = table(labelled.select("content", F.col("grp").alias("gid")).distinct().join(asked.select("gid").distinct(), "gid", "left_semi"), "held")

    def ask(questions: DataFrame, group: DataFrame) -> DataFrame:
        return _ask(questions, group, contents, packed, size, num, den)

    # one question for each pair of groups first: a link between them spares all others
    first = asked.groupBy("own", "gid").agg(F.max_by("content", F.struct("s", "content")).alias("content")).select("content", "gid")
    links = table(links.union(ask(first, held)), "links")
    labels = components(links)

    def label(frame, column, name):
        return frame.join(labels.select(F.col("node").alias(column), F.col("label").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    still = label(label(asked.join(first.withColumn("done", F.lit(True)), ["content", "gid"], "left").where("done is null"), "own", "x"), "gid", "y").where("x <> y").select("content", "gid")
    # members that a large group's chunks left apart are questions to all its chunks
    apart = label(label(opened.where("b is null").select(F.col("a").alias("content"), "gid").distinct(), "content", "x"), "gid", "y").where("x <> y").select("content", "gid")
    more_links = ask(table(still, "still"), held).union(ask(table(apart, "apart"), members))
    labels = components(table(links.union(more_links), "links"))
    drop(*made)
    classes = sets.join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "content")))
    return classes.select("doc_id", "n", "content", "label"), clashes


def similarity_classes(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, more: float = 0.03, frequent: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of `size`-word n-grams,
    A-Z lower-cased. component_id is the smallest id that links reach. Null texts and texts without
    words have no n-grams and link with nothing; rows with equal sets link whatever their ids; null
    ids don't count as smallest; no rows give no rows; other columns of docs aren't read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, _ = _classes(docs, size, num, den, more, frequent)
    least_id = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(least_id, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, more: float = 0.03, frequent: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, less all but one of each similarity class.

    The row of smallest id stays; of rows that have one id and equal n-grams any one. A null id counts
    as greater than all others. Rows without words (null, empty or blank texts) are in no class and
    all stay. Columns may have any names.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, clashes = _classes(slim, size, num, den, more, frequent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("x")
    winners = rows.where("n > 0").groupBy("label").agg(first).select(F.col("x.doc_id").alias("w_id"), F.col("x.content").alias("w_content"))

    def key(batches):
        for batch in batches:
            for a, b, words in runs(batch, lower=True):
                token, bounds = shingle_sets(words, size)
                columns = [*(batch.column(i).slice(a, b - a) for i in (0, 2)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_content(token, bounds, clashes))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "content"])

    whole = with_rows(docs, text_col).withColumn("doc_id", F.col("row")[id_col].cast("long"))
    keyed = whole.mapInArrow(key, row_type(docs, ("doc_id", LongType()), ("n", LongType()), ("content", LongType()))).withColumn("single", F.when(F.col("n") == 0, F.monotonically_increasing_id()))
    chosen = keyed.join(winners, (keyed["content"] == winners["w_content"]) & keyed["doc_id"].eqNullSafe(winners["w_id"]), "left").where("n = 0 or w_content is not null")
    return chosen.dropDuplicates(["doc_id", "content", "single"]).select("row.*")


def _shared_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of two contents or more, once for each. Frequent ones have many rows and need no test.

    A token that isn't known as frequent has less than one row in `frequent`, far less than a task's share.
    """
    w = Window.partitionBy("token")
    rare = tokens.where("not hot").withColumn("x", F.min("content").over(w)).withColumn("y", F.max("content").over(w)).where("x <> y")
    both = rare.select("token", "content", "n", "index").union(tokens.where("hot").select("token", "content", "n", "index"))
    return both.groupBy("token", "content").agg(F.first("n").alias("n"), F.first("index").alias("index"))


def _packed(docs: DataFrame, size: int, wanted: DataFrame, clashes: np.ndarray) -> DataFrame:
    """One compressed text for each wanted content."""

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for _a, _b, words in runs(batch, lower=True):
                token, bounds = shingle_sets(words, size)
                o = words.offsets
                texts = [packer.compress(words.data[o[i] : o[i + 1]].tobytes()) for i in range(len(o) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(_content(token, bounds, clashes)), pa.array(texts, pa.binary())], names=["content", "packed"])

    return docs.mapInArrow(pack, "content long, packed binary").join(wanted, "content", "left_semi").groupBy("content").agg(F.first("packed").alias("packed"))


def _ask(asked: DataFrame, members: DataFrame, contents: DataFrame, packed: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Open each asked group, in chunks of members by chunks of queries."""
    group = _chunked(members, contents)
    weight = asked.join(contents.select("content", "n"), "content")
    n = weight.groupBy("gid").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_GRAMS)).cast("int").alias("parts"))
    chunks = group.select("gid", "chunks").distinct()
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = group.join(n, "gid").select("gid", "content", "chunk", "parts", each.alias("part"), F.lit(1).alias("role"))
    part = F.pmod(F.xxhash64("content", F.lit(7)), F.col("parts")).cast("int").alias("part")
    each_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    queries = asked.join(n, "gid").join(chunks, "gid").select("gid", "content", each_chunk, "parts", part, F.lit(2).alias("role"))
    both = rows.union(queries).join(packed, "content").select("gid", (F.col("chunk") * F.col("parts") + F.col("part")).alias("chunk"), F.lit(1).alias("chunks"), "role", "content", "packed")
    return _open_groups(both, size, num, den).where("b is not null").select("a", "b")
