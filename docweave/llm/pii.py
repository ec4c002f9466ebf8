"""Personal data in text: fixed rules, and a span classifier trained by weak supervision.

Candidates are what the fixed rules find and what merely looks alike: numbers with separators,
numbers of a card's length, dotted quads out of range, addresses written with "at" and "dot".
Five labelers (regular expressions, a gazetteer of words nearby, the context's form, checksums, the
shape of digit groups) vote for, against or not at all. Expectation-maximisation estimates each
labeler's reliability per kind from how votes agree over all documents, without any labels, and
gives each vote pattern a probability. A logistic classifier learns these probabilities from span
features; alike candidates it holds likely enough are added to the fixed rules' spans. Patterns
and features are few, so both fits see exact counts over the whole corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.llm._store import keep, row_type, small_batches, with_rows

KINDS = ("email", "ip", "card", "phone")

# The rules that every deployment must report.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+_-])\(?[0-9][0-9().\x20/-]{5,24}[0-9](?![0-9A-Za-z_])")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}")
_NATIONAL = re.compile(r"(?:\(?[0-9]{3}\)?[ .-])?[0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ /-][0-9 -]{5,10}")
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")
#: Words that speak for each kind when they stand shortly before, and words that speak against all.
_GAZETTEER = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
}
_AGAINST = ("version", "isbn", "page", "invoice", "order", "part", "no.", "$", "€", "%", "token", "key", "id")
LABELERS = 5
ABSTAIN, FOR, AGAINST = 0, 1, 2


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the greedy address pattern matches, found from each @ so that long runs cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the fixed rules by kind as listed, then start; and the matches they drop."""
    good, bad = [], []
    if "@" in text:
        good += [(s, e, "email") for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return good, bad
    for m in _IP.finditer(text):
        ok = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))
        (good if ok else bad).append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        n = len(d := _digits(m[0])) if m.end() - m.start() <= 64 else 0
        if 16 <= n <= 19:
            (good if _luhn(d) else bad).append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                good.append((*m.span(), "phone"))
    return good, bad


def votes(text: str, start: int, end: int, kind: str, base: bool) -> tuple[int, int]:
    """The labelers' votes as a number in base 3, and the span's features as bits."""
    span, before = text[start:end], text[max(0, start - 32) : start].lower()
    digits = _digits(span)
    v = [ABSTAIN] * LABELERS
    v[0] = FOR if base or (kind == "phone" and _NATIONAL.fullmatch(span)) or (kind == "email" and " " not in span) else AGAINST if _DATE.fullmatch(span) or kind in ("ip", "card") else ABSTAIN
    near = before.split()[-4:]
    v[1] = FOR if any(w.strip(".:,;") in _GAZETTEER[kind] or (len(g) > 3 and g in w) for w in near for g in _GAZETTEER[kind]) else AGAINST if any(a in w for w in near for a in _AGAINST) else ABSTAIN
    left, right = text[start - 1 : start], text[end : end + 1]
    v[2] = AGAINST if left in ("$", "€", "#", "/", "=", "_") or right in ("%", "$", "€", "/", "=", "_") else FOR if (not left or left.isspace() or left in "(\"'|:") and (not right or right.isspace() or right in ".,;)\"'|") else ABSTAIN
    if kind == "card":
        v[3] = FOR if _luhn(digits) else AGAINST
    elif kind == "ip":
        v[3] = FOR if all(len(p) <= 3 and int(p) < 256 for p in span.split(".")) else AGAINST
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    if kind == "phone":
        v[4] = AGAINST if _DATE.fullmatch(span) or max(groups, default=0) > 10 or len(groups) > 6 else FOR if 7 <= len(digits) <= 15 and len(groups) >= 2 and groups[-1] in (2, 3, 4) else ABSTAIN
    elif kind == "card":
        v[4] = FOR if groups in ([4, 4, 4, 4], [16]) else ABSTAIN
    elif kind == "email":
        v[4] = FOR if "." in span or "dot" in span else AGAINST
    code = sum(x * 3**i for i, x in enumerate(v))
    signs = ["(" in span, "-" in span, "." in span, " " in span, "+" in span, "/" in span, len(digits) >= 10, len(digits) >= 16, len(groups) >= 3, v[1] == FOR, v[1] == AGAINST, v[2] == AGAINST, bool(_DATE.fullmatch(span)), v[3] == FOR, v[3] == AGAINST, v[4] == FOR]
    return code, sum(1 << i for i, s in enumerate(signs) if s)


FEATURES = 16


def alike(text: str, base: list[tuple[int, int, str]], dropped: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates beyond the fixed rules that overlap no base span."""
    found = [x for x in dropped]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_digits(m[0]))
            if 7 <= n <= 15:
                found.append((*m.span(), "phone"))
    low = text.lower()
    if "at" in low and "dot" in low:
        found += [(*m.span(), "email") for m in _SPELT.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1])):
        if not any(s < y and x < e for x, y, _ in base) and not (out and s < out[-1][1]):
            out.append((s, e, k))
    return out


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Dawid-Skene by expectation-maximisation over counts of (kind, vote pattern).

    Returns each kind's share of true spans, P(vote | truth) by kind, labeler and truth, and the
    probability of each pattern. It starts from the majority of votes.
    """
    patterns = sorted(counts)
    v = np.array([[p // 3**i % 3 for i in range(LABELERS)] for _, p in patterns], np.int64).reshape(-1, LABELERS)
    kind = np.array([k for k, _ in patterns], np.int64)
    n = np.array([counts[p] for p in patterns], float)
    checked = np.isin(kind, [KINDS.index("ip"), KINDS.index("card")])
    q = np.clip(0.5 + 0.2 * ((v == FOR).sum(1) - (v == AGAINST).sum(1)), 0.05, 0.95)
    prior, table = np.full(len(KINDS), 0.5), np.full((len(KINDS), LABELERS, 2, 3), 1 / 3)
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kind == k
            w = np.stack([n[own] * (1 - q[own]), n[own] * q[own]])
            prior[k] = (w[1].sum() + 1) / (w.sum() + 2)
            for i in range(LABELERS):
                for truth in (0, 1):
                    # a labeler is taken to be better than chance until its votes say otherwise
                    guess = [2.0, 4.0, 1.0] if truth else [2.0, 1.0, 4.0]
                    seen = np.bincount(v[own, i], weights=w[truth], minlength=3) + guess
                    table[k, i, truth] = seen / seen.sum()
        logit = np.log(prior[kind] / (1 - prior[kind]))
        for i in range(LABELERS):
            logit = logit + np.log(table[kind, i, 1, v[:, i]] / table[kind, i, 0, v[:, i]])
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # a card or an address whose checks fail is taken to be none, whatever the other labelers say
        q = np.where(checked & (v[:, 3] == AGAINST), np.minimum(q, 0.02), q)
    return prior, table, dict(zip(patterns, q.tolist(), strict=True))


def fit_classifier(rows: list[tuple[int, int, float, int]], steps: int = 400) -> np.ndarray:
    """Logistic weights on kind and features from (kind, features, probability, count) by gradient steps."""
    x = np.array([_inputs(k, f) for k, f, _, _ in rows]).reshape(-1, len(KINDS) + FEATURES)
    y, n = np.array([r[2] for r in rows]), np.log1p(np.array([r[3] for r in rows], float))
    w = np.zeros(len(KINDS) + FEATURES)
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 1.0 * (x.T @ (n * (p - y)) / n.sum() + 1e-4 * w)
    return w


def _inputs(kind: int, features: int) -> list[float]:
    return [float(kind == k) for k in range(len(KINDS))] + [float(features >> i & 1) for i in range(FEATURES)]


def _scan(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base, dropped = base_spans(text)
                spans = [(*x, True) for x in base] + [(*x, False) for x in alike(text, base, dropped)]
                told = [votes(text, *x) for x in spans]
                for column, value in zip(out, ([x[0] for x in spans], [x[1] for x in spans], [KINDS.index(x[2]) for x in spans], [t[0] for t in told], [t[1] for t in told], [x[3] for x in spans]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int32() if i < 5 else pa.bool_())) for i, x in enumerate(out))], names=["doc_id", "s", "e", "k", "v", "f", "b"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(scan, "doc_id long, s array<int>, e array<int>, k array<int>, v array<int>, f array<int>, b array<boolean>")


def _weights(scanned: DataFrame) -> np.ndarray:
    """The span classifier of all candidates; the driver sees counts by kind, votes and features alone."""
    # at most 4 * 3**5 * 2**16 rows in principle, a few hundred in fact
    seen = scanned.select(F.explode(F.arrays_zip("k", "v", "f")).alias("x")).groupBy("x.k", "x.v", "x.f").count().collect()
    by_votes: dict[tuple[int, int], int] = {}
    for r in seen:
        by_votes[r["k"], r["v"]] = by_votes.get((r["k"], r["v"]), 0) + r["count"]
    q = reliabilities(by_votes)[2] if by_votes else {}
    return fit_classifier(sorted((r["k"], r["f"], q[r["k"], r["v"]], r["count"]) for r in seen))


def _likely(kind: int, features: int, weights: np.ndarray, least: float) -> bool:
    return 1 / (1 + np.exp(-np.dot(_inputs(kind, features), weights))) >= least


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def find_pii(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base spans and all spans as arrays of (kind, start, end) in code points.

    Added spans never overlap base ones. A null or empty text has no spans; equal documents have
    equal spans; no rows give no rows; other columns aren't read.
    """
    found = keep(_scan(_texts(docs, id_col, text_col)), "pii")
    weights = _weights(found)

    def choose(batches):
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out: list[list] = [[], [], []]
            for row in batch.to_pylist():
                spans = list(zip(row["k"], row["s"], row["e"], row["f"], row["b"], strict=True))
                chosen = [x for x in spans if x[4] or _likely(x[0], x[3], weights, least)]
                out[0].append(row["doc_id"])
                for column, part in ((out[1], [x for x in chosen if x[4]]), (out[2], chosen)):
                    column.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e, _, _ in sorted(part)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], shape), pa.array(out[2], shape)], names=["doc_id", "base", "spans"])

    return found.mapInArrow(choose, "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span (start, end, kind) replaced by <kind>; overlapping spans go together under the first one's kind."""
    parts, at = [], 0
    merged: list[list] = []
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in merged:
        parts += [text[at:s], f"<{kind}>"]
        at = e
    return "".join([*parts, text[at:]])


def mask_pii(docs: DataFrame, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced by its kind in angle brackets; all rows and columns stay.

    A row's own text is searched and cut in one pass, so null and repeated ids change nothing, and
    columns may have any names. A null text stays null. The text column becomes a string.
    """
    rows = with_rows(docs, text_col)
    weights = _weights(_scan(rows.select(F.lit(None).cast("long").alias("doc_id"), "text")))

    def mask(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base, dropped = base_spans(text)
                    more = [x for x in alike(text, base, dropped) if _likely(KINDS.index(x[2]), votes(text, *x, False)[1], weights, least)]
                    if base or more:
                        texts[i] = masked(text, base + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    done = rows.mapInArrow(mask, row_type(docs, ("text", StringType())))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
