"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of its own vector and the mean of its characters' vectors (runs of three to
five characters, and those at its start), for words and runs known from training. What of a word is
past its first `PIECE` bytes makes further inputs, overlapping so that no run is lost: text without
white space is read whole as well. Windows of `span`
words, half overlapping, cover each whole text; the network reads a window both ways, attention
pools its states into a logit, and a document's score is its windows' greatest, calibrated.

Labels mark documents, not windows: after a pass in which every window carries its document's label,
training repeats on each document's highest window only.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import row_type, small_batches, with_rows
from docweave.llm._text import Words, column_bytes, mix, runs, slices, without_marks

DIM, HIDDEN = 12, 8
#: Bytes of an input, and of the overlap of a long word's inputs: the longest run less one.
PIECE, OVERLAP = 40, 4
#: Bytes of distinct words, character runs, and words of documents that are worked on together.
BLOCK = 1 << 16
_PIECE_SALT = np.uint64(0x7E57A11CE0FF5E75)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tokens:
    """The words of some documents without marks at their ends; distinct ones, and each document's sequence.

    A word of over PIECE bytes is followed by pieces of the rest of it, which count as words here.
    """

    def __init__(self, words: Words):
        inner = without_marks(words)
        count = 1 + np.maximum(0, -(-(inner.ends - inner.starts - PIECE) // (PIECE - OVERLAP)))
        total = np.concatenate([[0], np.cumsum(count)])
        self.bounds = total[inner.bounds]
        nth = np.arange(total[-1]) - np.repeat(total[:-1], count)
        starts = np.repeat(inner.starts, count) + nth * (PIECE - OVERLAP)
        ends = np.minimum(np.repeat(inner.ends, count), starts + PIECE)
        hashes = np.repeat(inner.hashes(), count)
        rest = Words.__new__(Words)
        rest.data, rest.starts, rest.ends = inner.data, starts[nth > 0], ends[nth > 0]
        hashes[nth > 0] = rest.hashes() ^ _PIECE_SALT
        self.hash, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        #: Whether it is the start of a word.
        self.front = nth[first] == 0
        s, e = starts[first], ends[first]
        size = e - s
        self.begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.chars = words.data[np.repeat(s - self.begin[:-1], size) + np.arange(self.begin[-1])] if len(s) else np.zeros(0, np.uint8)

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        """Of many documents, slice by slice, so that only the result grows with their bytes; as if read at once."""
        parts = [cls(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True)) for a, b in slices(offsets)]
        if len(parts) < 2:
            return parts[0] if parts else cls(Words(data, offsets, True))
        out = cls.__new__(cls)
        out.hash, first, back = np.unique(np.concatenate([t.hash for t in parts]), return_index=True, return_inverse=True)
        ends = np.cumsum([len(t.hash) for t in parts])
        out.at = np.concatenate([back[end - len(t.hash) : end].astype(np.int32)[t.at] for t, end in zip(parts, ends, strict=True)])
        out.bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t.bounds) for t in parts]))])
        out.front = np.concatenate([t.front for t in parts])[first]
        sizes = np.concatenate([np.diff(t.begin) for t in parts])
        starts, size = (np.cumsum(sizes) - sizes)[first], sizes[first]
        out.begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        out.chars = np.concatenate([t.chars for t in parts])[np.repeat(starts - out.begin[:-1], size) + np.arange(out.begin[-1])]
        return out

    def grams(self, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character runs of the distinct words first..last, and the word of each."""
        begin = self.begin[first : len(self.hash) + 1 if last is None else last + 1]
        chars, begin, starts = self.chars[begin[0] : begin[-1]], begin - begin[0], self.front[first:last]
        n = len(chars)
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        end = begin[1:][owner] if n else np.zeros(0, np.int64)
        place = np.arange(n)
        b = chars.astype(np.uint64) + np.uint64(1)
        out, whose = [], []
        h = np.zeros(n, np.uint64)
        for k in range(min(5, n)):
            h[: n - k] = h[: n - k] * np.uint64(1_000_003) + b[k:]
            if k >= 2:
                inside = place + k < end
                out.append(mix(h[inside] + np.uint64(k << 56)))
                whose.append(owner[inside])
                front = begin[:-1][starts & (np.diff(begin) > k)]
                out.append(mix(h[front] + np.uint64((k + 16) << 56)))
                whose.append(owner[front])
        return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, np.int64), *whose]) + first


def windows(bounds: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, size and document of half-overlapping windows that cover every document; one at least."""
    n = np.diff(bounds)
    step = span // 2
    count = np.maximum(1, -(-(n - step) // step))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][doc] + k * step
    return first, np.minimum(span, n[doc] - k * step), doc


@dataclass
class Network:
    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    span: int = 32

    @classmethod
    def fresh(cls, words: np.ndarray, grams: np.ndarray, span: int, seed: int = 7) -> Network:
        """words, grams: sorted hashes."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)

        def table(n):
            out = np.empty((n, DIM), np.float32)
            for a in range(0, n, BLOCK):
                part = out[a : a + BLOCK]
                part[:] = 0.1 * rng.normal(size=part.shape).astype(np.float32)
            return out

        p = {"Ew": table(len(words) + 1), "Ec": table(len(grams) + 1), "v": draw(2 * HIDDEN), "w": draw(2 * HIDDEN), "b": np.array([-1.0], np.float32)}
        p["Ew"][-1] = p["Ec"][0] = 0
        for d in "fb":
            p |= {f"W{d}": draw(DIM, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": draw(HIDDEN, 3 * HIDDEN)}
        return cls(words, grams, p, span=span)

    def inputs(self, t: Tokens):
        """For distinct words: id of the word, ids of its known runs, and the word of each run."""
        ident = _places(self.words, t.hash)
        ident[ident < 0] = len(self.words)
        gids, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a, b in slices(t.begin, BLOCK):
            g, owner = t.grams(a, b)
            gid = _places(self.grams, g)
            by = np.flatnonzero(gid >= 0)
            by = by[np.argsort(owner[by], kind="stable")]
            gids.append((gid[by] + 1).astype(np.int32))
            owners.append(owner[by].astype(np.int32))
        return ident, np.concatenate(gids), np.concatenate(owners)

    def vectors(self, ident, gid, owner) -> np.ndarray:
        x = self.p["Ew"][ident]
        if len(owner):
            edges = np.concatenate([[0], 1 + np.flatnonzero(owner[1:] != owner[:-1]), [len(owner)]])
            for a, b in slices(edges, BLOCK):
                start, own, n = edges[a], edges[a:b], np.diff(edges[a : b + 1])
                x[owner[own]] += np.add.reduceat(self.p["Ec"][gid[start : edges[b]]], own - start, axis=0) / n[:, None]
        return x

    def _read(self, pre: np.ndarray, U: np.ndarray, live: np.ndarray, keep: bool):
        """States of one direction. pre: steps x windows x 3 HIDDEN; live: whether a step has a word."""
        steps, batch, _ = pre.shape
        h, H = np.zeros((batch, HIDDEN), np.float32), HIDDEN
        out, cache = np.empty((steps, batch, H), np.float32), []
        for t in range(steps):
            zr = _sigmoid(pre[t, :, : 2 * H] + h @ U[:, : 2 * H])
            z, r = zr[:, :H] * live[t][:, None], zr[:, H:]
            c = np.tanh(pre[t, :, 2 * H :] + (r * h) @ U[:, 2 * H :])
            if keep:
                cache.append((h, zr, r, c, z))
            h = h + z * (c - h)
            out[t] = h
        return out, cache

    def forward(self, x: np.ndarray, index: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows. x: distinct words' vectors; index: steps x windows of them."""
        p = self.p
        states, caches = [], []
        for d in "fb":
            pre = (x @ p[f"W{d}"] + p[f"c{d}"])[index]
            pre, on = (pre, live) if d == "f" else (pre[::-1], live[::-1])
            s, cache = self._read(pre, p[f"U{d}"], on, keep)
            states.append(s if d == "f" else s[::-1])
            caches.append(cache)
        h = np.concatenate(states, 2)
        e = np.where(live, h @ p["v"], -30.0)
        a = np.exp(e - e.max(0))
        a = (a / a.sum(0)).astype(np.float32)
        pooled = np.einsum("tb,tbh->bh", a, h)
        return pooled @ p["w"] + p["b"][0], (h, a, pooled, caches)

    def backward(self, x, index, live, saved, dlogit: np.ndarray):
        p, (h, a, pooled, caches) = self.p, saved
        H, g = HIDDEN, {}
        g["w"], g["b"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * p["w"]
        da = np.einsum("bh,tbh->tb", dpool, h)
        de = a * (da - (a * da).sum(0)) * live
        g["v"] = np.einsum("tb,tbh->h", de, h)
        dh_all = a[:, :, None] * dpool + de[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        for j, d in enumerate("fb"):
            U, part = p[f"U{d}"], dh_all[:, :, j * H : (j + 1) * H]
            part = part if d == "f" else part[::-1]
            on = live if d == "f" else live[::-1]
            carry, dU = np.zeros_like(part[0]), np.zeros_like(U)
            dpre = np.empty((*part.shape[:2], 3 * H), np.float32)
            for t in range(len(part) - 1, -1, -1):
                h0, zr, r, c, z = caches[j][t]
                dh = carry + part[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h0) * on[t][:, None] * zr[:, :H] * (1 - zr[:, :H])
                drh = dc @ U[:, 2 * H :].T
                dr = drh * h0 * r * (1 - r)
                dpre[t] = np.concatenate([dz, dr, dc], 1)
                dU[:, : 2 * H] += h0.T @ dpre[t][:, : 2 * H]
                dU[:, 2 * H :] += (r * h0).T @ dc
                carry = dh * (1 - z) + drh * r + dpre[t][:, : 2 * H] @ U[:, : 2 * H].T
            dpre = dpre if d == "f" else dpre[::-1]
            g[f"U{d}"], g[f"c{d}"] = dU, dpre.sum((0, 1))
            flat = np.zeros((len(x), 3 * H), np.float32)
            np.add.at(flat, index.reshape(-1), dpre.reshape(-1, 3 * H))
            g[f"W{d}"] = x.T @ flat
            dx += flat @ p[f"W{d}"].T
        return g, dx

    def logits(self, t: Tokens, inputs: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each window's logit, and its first word and document. inputs: those of t, where they are known."""
        x = np.concatenate([self.vectors(*(inputs or self.inputs(t))), np.zeros((1, DIM), np.float32)])
        first, size, doc = windows(t.bounds, self.span)
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), 2048):
            index, live = _steps(t.at, first[a : a + 2048], size[a : a + 2048], self.span, len(x) - 1)
            out[a : a + 2048] = self.forward(x, index, live)[0]
        return out, first, doc

    def scores(self, words: Words) -> np.ndarray:
        """One calibrated score a document."""
        t = Tokens(words)
        logit, _, doc = self.logits(t)
        top = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(t.bounds) - 1))) if len(logit) else np.zeros(0)
        return _sigmoid(self.scale[0] * top.astype(float) + self.scale[1])


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each in sorted `known`, or -1."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's weights."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=weights, minlength=len(distinct))


def _spread(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries start[w]..start[w + 1] of each w, and the place of its w in `of`."""
    n = start[of + 1] - start[of]
    return np.repeat(start[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(of)), n)


def _steps(at, first, size, span, pad):
    steps = np.arange(span)[:, None]
    live = steps < size
    index = np.where(live, first + steps, 0)
    return np.where(live, at[index], pad) if len(at) else np.full(index.shape, pad), live


class _Adam:
    """Adam; of a table of vectors only the rows of a step are touched."""

    def __init__(self, p, rate):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict, rows: dict):
        self.t += 1
        for k, x in g.items():
            self._move(k, slice(None), x)
        for k, (at, x) in rows.items():
            ids, back = np.unique(at, return_inverse=True)
            total = np.zeros((len(ids), x.shape[1]), np.float32)
            np.add.at(total, back, x)
            self._move(k, ids, total + 1e-5 * self.p[k][ids])

    def _move(self, k, at, x):
        m, s = self.m[k][at] * 0.9 + 0.1 * x, self.s[k][at] * 0.99 + 0.01 * x * x
        self.m[k][at], self.s[k][at] = m, s
        self.p[k][at] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)


def train(texts: list[str | None], toxic: list[int], weight: list[float], span: int = 32, rounds: int = 6, seed: int = 7) -> Network:
    """Fit on texts and labels; a fifth of them is kept for calibration. weight: of each row there.

    Without both labels the network scores near the share of label 1.
    """
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    t, y = Tokens.read(data, offsets), np.array(toxic, np.float32)
    df = np.zeros(len(t.hash), np.int64)
    for a, b in slices(t.bounds, BLOCK):
        pairs = np.unique(np.repeat(np.arange(b - a), np.diff(t.bounds[a : b + 1])) * len(t.hash) + t.at[t.bounds[a] : t.bounds[b]])
        df += np.bincount(pairs % max(1, len(t.hash)), minlength=len(t.hash))
    known = t.hash[df >= 3]
    found = []
    for a, b in slices(t.begin, BLOCK):
        g, owner = t.grams(a, b)
        g, n = _sums(g, df[owner])
        cut = np.searchsorted(g, np.arange(1, 16, dtype=np.uint64) << np.uint64(60))
        found.append(list(zip(np.split(g, cut), np.split(n, cut), strict=True)))
    grams = [np.zeros(0, np.uint64)]
    for parts in zip(*found, strict=True):  # one range of hashes after the other
        g, n = _sums(*map(np.concatenate, zip(*parts, strict=True)))
        grams.append(g[n >= 5])
    del found
    net = Network.fresh(known, np.concatenate(grams), span, seed)
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    prior = np.log((share + 0.01) / (1.01 - share))
    if len(y) == 0 or y.min() == y.max():
        net.scale = (0.0, float(prior))
        return net
    rng = np.random.default_rng(seed)
    hold = rng.random(len(y)) < 0.2
    inputs = ident, gid, gown = net.inputs(t)
    gstart = np.searchsorted(gown, np.arange(len(ident) + 1, dtype=gown.dtype))
    first, size, doc = windows(t.bounds, span)
    adam = _Adam(net.p, 0.01)

    def learn(chosen: np.ndarray, balance: float, steps: int):
        """A pass in batches of 256 windows, or as many passes in batches of 64 as make so many steps."""
        size_ = 256 if len(chosen) >= 256 * steps else 64
        parts = [x for _ in range(max(1, -(-steps * size_ // max(1, len(chosen))))) for x in np.array_split(rng.permutation(chosen), max(1, len(chosen) // size_))]
        for part in parts:
            index, live = _steps(t.at, first[part], size[part], span, len(ident))
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(live.shape)
            real = used[used < len(ident)]
            pick, local = _spread(gstart, real)
            x = net.vectors(ident[real], gid[pick], local)
            if len(real) < len(used):
                x = np.concatenate([x, np.zeros((1, DIM), np.float32)])
            logit, saved = net.forward(x, index, live, True)
            target = y[doc[part]]
            w = np.where(target > 0, balance, 1.0)
            grads, dx = net.backward(x, index, live, saved, ((_sigmoid(logit) - target) * w / len(part)).astype(np.float32))
            word = ident[real]
            some = word < len(net.words)
            count = np.bincount(local, minlength=len(real))
            adam.step(grads, {"Ew": (word[some], dx[: len(real)][some]), "Ec": (gid[pick], dx[local] / count[local][:, None])})

    used = ~hold[doc]
    learn(np.flatnonzero(used), 2.0, 150)
    for r in range(rounds):
        logit = net.logits(t, inputs)[0]
        order = np.lexsort((-logit, doc))
        top = order[np.searchsorted(doc, np.arange(len(y)))]
        # a clean document's other windows are clean as well: some of them, chosen anew, keep the rest honest
        extra = rng.choice(np.flatnonzero(used & (y[doc] == 0)), min(len(y), int((used & (y[doc] == 0)).sum())), replace=False)
        adam.rate = 0.01 if r < rounds - 2 else 0.003
        learn(np.unique(np.concatenate([top[~hold], extra])), 2.0, 40)
    logit = net.logits(t, inputs)[0]
    top = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(y)))).astype(float)
    cal = hold if hold.sum() >= 100 and 0 < y[hold].sum() < hold.sum() else np.ones(len(y), bool)
    w = np.array(weight)[cal]
    a, b = 1.0, 0.0
    for _ in range(500):
        d = (_sigmoid(a * top[cal] + b) - y[cal]) * w / w.sum()
        a, b = max(0.05, a - 0.5 * float(d @ top[cal])), b - 2.0 * float(d.sum())
    net.scale = (a, b)
    return net


def _saved(net: Network) -> bytes:
    out = io.BytesIO()
    np.savez(out, words=net.words, grams=net.grams, scale=np.array(net.scale), span=net.span, **{f"p_{k}": v for k, v in net.p.items()})
    return out.getvalue()


def _loaded(data: bytes) -> Network:
    x = np.load(io.BytesIO(data))
    return Network(x["words"], x["grams"], {k[2:]: x[k] for k in x.files if k.startswith("p_")}, tuple(x["scale"].tolist()), int(x["span"]))


def _held(id_column: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = 1600, sample_bytes: int = 24 << 20, span: int = 32) -> Network:
    """The network of docs (doc_id, text) and labels (doc_id, toxic), trained by one task of an executor.

    At most `sample` / 2 rows of each label are examples, those of least hash of the id, as long as
    their texts come to `sample_bytes` (texts that don't fit are left out whole). Of rows with one id the
    least text is the example. The driver receives the network: vectors of words and character runs of the
    examples, fewer than their bytes.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").dropDuplicates(["doc_id"]).where(~_held("doc_id", folds, fold))
    share = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    drawn = None
    for y in (0, 1):
        # a cut-off that leaves about four times as many rows comes before their order
        part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, (2 * sample + 100) / max(1, share.get(y, 0))) * (1 << 30))
        few = told.where((F.col("toxic") == y) & part).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample // 2)
        drawn = few if drawn is None else drawn.union(few)
    # at most `sample` ids, so the broadcast has a fixed bound; the texts follow
    examples = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def learn(batches):
        rows, size = [], 0
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = text.as_buffer().size if text.is_valid else 0
                if size + n <= sample_bytes:
                    rows.append((text.as_py() or "", y))
                    size += n
        there = {y: sum(r[1] == y for r in rows) for y in (0, 1)}
        net = train([r[0] for r in rows], [r[1] for r in rows], [share[r[1]] / there[r[1]] for r in rows], span)
        yield pa.RecordBatch.from_arrays([pa.array([_saved(net)], pa.binary())], names=["model"])

    made = examples.repartition(1).sortWithinPartitions("h", "doc_id").select("toxic", "text").mapInArrow(learn, "model binary").collect()
    return _loaded(made[0]["model"]) if made else train([], [], [], span)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = 1600, span: int = 32, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(id as text) % folds is not `fold`, from a bounded
    sample of them (see fit); scoring covers every window of every text. Rows with a null label are no
    examples; a null id is never held out. Null and empty texts are one window without words. Equal
    texts have equal scores; no rows give no rows; other columns of docs aren't read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    net = fit(docs, labels, folds, fold, sample, span=span)

    def score(batches):
        for batch in batches:
            for a, b, words in runs(batch, lower=True, limit=1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(net.scores(words))], names=["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double").select("doc_id", _held("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def drop_toxic_rows(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = 1600, span: int = 32, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose own text scores below `least`.

    Each row is judged by its text alone, so null and repeated ids change nothing; columns may have any names.
    """
    small_batches(docs.sparkSession)
    net = fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), labels, folds, fold, sample, span=span)

    def clean(batches):
        for batch in batches:
            for a, b, words in runs(batch, lower=True, limit=1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(net.scores(words) < least))], names=["row"])

    return with_rows(docs, text_col).mapInArrow(clean, row_type(docs)).select("row.*")
