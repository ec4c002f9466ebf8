"""Secrets in text: fixed rules, and a battery of randomness tests with control of false discoveries.

Every run of 16 or more key characters that mixes letters with digits, or upper with lower case
inside, is a candidate. Its encoding (hex, base32, letters and digits, base64) is inferred, and
three tests ask whether its characters look drawn at random from that alphabet: chi-squared
uniformity, runs about the middle of the alphabet, and serial correlation. Fisher's method joins
their p-values into one score. How often ordinary text scores as well depends on length and encoding, so the
letters of all texts, without blanks and cut into pieces of every length class, are scored as words
and as keys of mixed case; they give the null distribution of each length and kind of encoding. The
Benjamini-Hochberg procedure over all candidates then fixes one threshold for each.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import keep, small_batches

KINDS = ("assign", "access", "hex", "random")

# The rules that every deployment must report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")

#: Length classes by lower bound, and score classes of -log2(1 - score) that the histogram keeps.
LENGTHS = np.array([16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128])
SCORES = 64

_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed rules, by start, then kind as listed."""
    out = []
    low = text.lower() if len(text.lower()) == len(text) else text
    if any(w in low for w in _ASSIGN_WORDS) or low is text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _normal_sf(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = np.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


def is_word(t: str) -> bool:
    return (t[1:].islower() and t.isalpha()) or (t.isalpha() and t.isupper())


def encoding(t: str) -> str:
    """The first alphabet that has all of a candidate's characters."""
    there = set(t)
    return next((a for a in _ALPHABETS if there <= set(a)), _ALPHABETS[-1] + "+/")


#: Kinds of encodings: of one case (hex, base32), and of mixed case.
SINGLE, MIXED = 0, 1


def randomness(tokens: list[str], alphabets: list[str]) -> np.ndarray:
    """The joint p-value of the battery for each token in an alphabet.

    A small p-value speaks against characters drawn at random.
    """
    score = np.zeros(len(tokens))
    groups: dict[str, list[int]] = {}
    for i, a in enumerate(alphabets):
        groups.setdefault(a, []).append(i)
    for alphabet, members in groups.items():
        code = np.zeros(128, np.int64)
        for i, c in enumerate(alphabet):
            code[ord(c)] = i
        size = len(alphabet)
        for at in range(0, len(members), 2048):
            part = members[at : at + 2048]
            texts = [tokens[i].lower() if alphabet is _LETTERS else tokens[i] for i in part]
            lengths = np.array([len(t) for t in texts])
            v = code[np.frombuffer("".join(texts).encode("ascii"), np.uint8)]
            owner = np.repeat(np.arange(len(part)), lengths)
            n = lengths.astype(float)
            seen = np.bincount(owner * size + v, minlength=len(part) * size).reshape(len(part), size)
            chi = (seen.astype(float) ** 2).sum(1) * size / n - n
            d = size - 1
            p_chi = _normal_sf(((np.maximum(chi, 0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
            high = v >= size / 2
            inner = owner[1:] == owner[:-1]
            turns = np.bincount(owner[1:][inner & (high[1:] != high[:-1])], minlength=len(part)) + 1
            n1 = np.bincount(owner, weights=high, minlength=len(part))
            mean = 2 * n1 * (n - n1) / n + 1
            var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
            p_runs = np.where((n1 == 0) | (n1 == n), 2.0 ** (1 - n), np.minimum(1, 2 * _normal_sf(np.abs(turns - mean) / np.sqrt(var))))
            mid = v - (np.bincount(owner, weights=v, minlength=len(part)) / n)[owner]
            power = np.bincount(owner, weights=mid * mid, minlength=len(part))
            lag = np.bincount(owner[1:][inner], weights=(mid[1:] * mid[:-1])[inner], minlength=len(part))
            r = np.where(power > 0, lag / np.maximum(power, 1e-9), 1.0)
            p_serial = np.minimum(1, 2 * _normal_sf(np.abs(r + 1 / n) * np.sqrt(n)))
            half = -sum(np.log(np.clip(p, 1e-300, 1)) for p in (p_chi, p_runs, p_serial))
            score[part] = np.exp(-half) * (1 + half + half * half / 2)
    return score


_PIECE = re.compile("[A-Za-z]+")


def ordinary(text: str) -> list[str]:
    """The letters of a whole text without what is between them, in pieces of each length class by turns."""
    letters, out, at, k = "".join(_PIECE.findall(text)), [], 0, 0
    while at + LENGTHS[k] <= len(letters):
        out.append(letters[at : at + LENGTHS[k]])
        at, k = at + int(LENGTHS[k]), (k + 1) % len(LENGTHS)
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Runs of key characters, without the signs at their ends."""
    out = []
    for m in _RUN.finditer(text):
        t = m[0].strip("+/_-")
        if len(t) >= 16:
            s = m.start() + m[0].index(t)
            out.append((s, s + len(t), t))
    return out


def _mixed(t: str) -> bool:
    return any(c.isdigit() for c in t) + any(c.islower() for c in t) + any(c.isupper() for c in t[1:]) >= 2


def _score_class(p: np.ndarray) -> np.ndarray:
    """Higher: closer to random. p in (0, 1]; half a power of two a class."""
    return np.clip(SCORES - 1 + np.floor(2 * np.log2(np.maximum(p, 1e-30))), 0, SCORES - 1).astype(np.int64)


def thresholds(counts: dict[tuple[int, int, bool], int], rate: float) -> dict[int, int]:
    """The least score class taken as random in each class: Benjamini-Hochberg at `rate`.

    counts: pieces by (class, score class, ordinary). Classes are those of length, of encodings of one
    case, then of mixed case. A class with few ordinary pieces also counts those of shorter classes:
    shorter ones score higher, so this errs to caution.
    """
    null: dict[int, np.ndarray] = {}
    held = np.zeros(SCORES)
    for k in range(2 * len(LENGTHS)):
        if k == len(LENGTHS):
            held = np.zeros(SCORES)
        own = np.array([counts.get((k, s, True), 0) for s in range(SCORES)], float)
        held = own if own.sum() >= 1000 else held + own
        null[k] = (np.cumsum(held[::-1])[::-1] + 1) / (held.sum() + 1)
    tests = sorted((null[k][s], n, k, s) for (k, s, word), n in counts.items() if not word and n)
    total, taken, limit = sum(n for _, n, _, _ in tests), 0, -1.0
    for p, n, _, _ in tests:
        taken += n
        if p <= rate * taken / total:
            limit = p
    return {k: int(np.argmax(null[k] <= limit)) if (null[k] <= limit).any() else SCORES for k in null}


def _scan(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, found, owner = [], [], []
            for i, text in enumerate(texts):
                text = text.as_py() or ""
                rows.append([[], [], [], [], [], base_spans(text)])
                for s, e, t in candidates(text):
                    if not is_word(t) and _mixed(t):
                        found.append(t)
                        owner.append((i, s, e))
            alphabets = [encoding(t) for t in found]
            kinds = [SINGLE if len(a) <= 32 else MIXED for a in alphabets]
            for (i, s, e), k, c in zip(owner, _length_class(found, kinds), _score_class(randomness(found, alphabets)).tolist(), strict=True):
                for column, value in zip(rows[i], (s, e, k, c), strict=False):
                    column.append(value)
            # of ordinary pieces only the counts matter: one row's lists hold those of a batch
            null: dict[tuple[int, int], int] = {}
            for a in range(0, len(texts), 64):
                pieces = [p for t in texts.slice(a, 64) for p in ordinary(t.as_py() or "")]
                for kind, alphabet in ((SINGLE, _LETTERS), (MIXED, _ALPHABETS[4])):
                    for key in zip(_length_class(pieces, [kind] * len(pieces)), _score_class(randomness(pieces, [alphabet] * len(pieces))).tolist(), strict=True):
                        null[key] = null.get(key, 0) + 1
            counts = [[{"k": k, "c": c, "n": n} for (k, c), n in sorted(null.items())]] + [[]] * (len(rows) - 1) if rows else []
            columns = [pa.array([r[j] for r in rows], pa.list_(pa.int32())) for j in range(4)]
            columns.append(pa.array(counts, pa.list_(pa.struct([("k", pa.int32()), ("c", pa.int32()), ("n", pa.int64())]))))
            base = [pa.array([[x[j] for x in r[5]] for r in rows], pa.list_(t)) for j, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, *columns, *base], names=["doc_id", "s", "e", "k", "c", "null", "bs", "be", "bk"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(scan, "doc_id long, s array<int>, e array<int>, k array<int>, c array<int>, null array<struct<k:int,c:int,n:bigint>>, bs array<int>, be array<int>, bk array<string>")


def _length_class(tokens: list[str], kinds: list[int]) -> list[int]:
    return ((np.searchsorted(LENGTHS, [len(t) for t in tokens], "right") - 1) + np.array(kinds, np.int64) * len(LENGTHS)).tolist()


def find_secrets(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its base spans and all spans, as arrays of (kind, start, end) in code points.

    Spans of the tests never replace base ones and don't overlap them. A null or empty text has no
    spans; equal documents have equal spans; no rows give no rows; other columns aren't read.
    """
    found = keep(_scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))), "secrets")
    seen = found.select(F.explode(F.arrays_zip("k", "c")).alias("x")).groupBy("x.k", "x.c").agg(F.count("*").alias("n")).withColumn("w", F.lit(False))
    null = found.select(F.explode("null").alias("x")).groupBy("x.k", "x.c").agg(F.sum("x.n").alias("n")).withColumn("w", F.lit(True))
    least = thresholds({(r["k"], r["c"], r["w"]): r["n"] for r in seen.union(null).collect()}, rate)  # at most 22 * 64 * 2 rows

    def choose(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                base = list(zip(row["bs"], row["be"], row["bk"], strict=True))
                extra = [(s, e, "random") for s, e, k, c in zip(row["s"], row["e"], row["k"], row["c"], strict=True) if c >= least[k] and not any(s < y and x < e for x, y, _ in base)]
                both = sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2])))
                out[0].append(row["doc_id"])
                for column, spans in ((out[1], base), (out[2], both)):
                    column.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], kind)], names=["doc_id", "base", "spans"])

    return found.mapInArrow(choose, "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")


def written(spans: str):
    """Spans as text: kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The counts of base spans by kind, the hash of the base spans, and all spans as text and their number.

    One row per row of found, whatever its id; no spans are the empty text and its hash.
    """
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def spans_sha256(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
