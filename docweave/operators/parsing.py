"""Raw model output to typed records, greedy folds over a document, and segmentation.

These run as Arrow functions per batch or per document: they scan with state that resets.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.grouped import per_key, records

_FENCE = re.compile(r"^\s*```[a-z]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_NUMBER = re.compile(r"(?<![^\W_])[+-]?[0-9](?:[0-9.,:/%-]*[0-9%])?")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"(\[]?[A-Z0-9])")

RECORDS = "doc_id long, seq int, kind string, x0 int, y0 int, x1 int, y1 int, text string"


def unfenced(raw: str) -> str:
    m = _FENCE.match(raw)
    return m[1] if m else raw


def top_level_objects(s: str):
    """Balanced {...} pieces outside strings; an unclosed last one is left out."""
    depth, start, quoted, skip = 0, 0, False, False
    for i, c in enumerate(s):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield s[start : i + 1]


def _decoded(piece: str):
    for text in (piece, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", piece)):
        try:
            return json.loads(text, strict=False)
        except ValueError:
            continue
    return None


def _half_even(x) -> int | None:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        return None
    return round(x)


def normalized_record(entry) -> tuple | None:
    """(x0, y0, x1, y1, text, type) of an object with either of the key names, null if it has no box or text."""
    if not isinstance(entry, dict):
        return None
    box, text = entry.get("bbox_2d", entry.get("bbox")), entry.get("text_content", entry.get("text"))
    if not isinstance(box, list) or len(box) != 4 or not isinstance(text, str):
        return None
    corners = [_half_even(v) for v in box]
    if None in corners:
        return None
    kind = entry.get("type")
    return (*corners, text.strip(), kind.lower() if isinstance(kind, str) else None)


def parse_records(raw: str | None) -> list[tuple]:
    """All records: the whole text as JSON if it is, else each complete object in it."""
    s = unfenced(raw or "")
    try:
        whole = json.loads(s)
    except ValueError:
        whole = None
    entries = whole if isinstance(whole, list) else [_decoded(p) for p in top_level_objects(s)]
    return [r for r in map(normalized_record, entries) if r]


def is_table_text(text: str) -> bool:
    """A pipe table with a delimiter row among its first lines, as wide as its header."""
    rows = [[c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in text.split("\n") if line.strip()][:8]
    return any(all(re.fullmatch(":?-+:?", c) for c in row) and len(row) == len(before) >= 2 for before, row in zip(rows, rows[1:]))


def record_kind(text: str, kind: str | None) -> str:
    """In order: key-value by declared type, image sentinel, table, text."""
    return "kv" if kind == "kv" else "image" if text == "<image>" else "table" if is_table_text(text) else "text"


def raw_records(reads: DataFrame) -> DataFrame:
    """reads: (doc_id, raw). One row per record, in order of emission."""

    def parse(batches):
        for batch in batches:
            out = [(d, i, record_kind(r[4], r[5]), *r[:5]) for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, r in enumerate(parse_records(raw))]
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return reads.select("doc_id", "raw").mapInArrow(parse, RECORDS)


def numeric_tokens(text: str) -> list[str]:
    """Number-like tokens that don't begin within a word, left to right; letters that follow end them."""
    return [m[0] for m in _NUMBER.finditer(text)]


def has_repeated_content(text: str | None, run: int = 18, triple: int = 8, pair: int = 30) -> bool:
    """One token `run` times on end, or a window of three `triple` times, or of two `pair` times, at strides of the window."""
    tokens = _TOKEN.findall((text or "").casefold())
    for size, most in ((1, run), (3, triple), (2, pair)):
        windows = [tuple(tokens[i : i + size]) for i in range(0, len(tokens) - size + 1, size)]
        length = 1
        for a, b in zip(windows, windows[1:]):
            length = length + 1 if a == b else 1
            if length >= most and any(c.isalnum() for t in b for c in t):
                return True
    return False


def signature(secret: bytes, message_id: str, at: int, body: str) -> str:
    import base64

    return "v1," + base64.b64encode(hmac.new(secret, f"{message_id}.{at}.{body}".encode(), hashlib.sha256).digest()).decode()


def repeated_content(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([has_repeated_content(t) for t in batch.column(1).to_pylist()], pa.bool_())], names=["doc_id", "flag"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, flag boolean")


def number_tokens(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([numeric_tokens(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, tokens array<string>")


def signed(events: DataFrame, secret: bytes) -> DataFrame:
    """events: (event_id, at, body)."""

    def scan(batches):
        for batch in batches:
            ids, at, body = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(secret, str(i), a, b) for i, a, b in zip(ids, at, body, strict=True)])], names=["event_id", "signature"])

    return events.select("event_id", "at", "body").mapInArrow(scan, "event_id long, signature string")


def _per_document(e: DataFrame, f, schema: str) -> DataFrame:
    shape = _arrow_schema(schema)

    def group(table: pa.Table, bounds: list[int]):
        rows = records(table)
        for a, b in zip(bounds, bounds[1:]):
            yield from (tuple(x.values()) for x in f(sorted(rows[a:b], key=lambda r: (r["page_no"], r["idx"]))))

    return per_key(e.select("doc_id", "page_no", "idx", "text"), group, shape, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def context_batches(e: DataFrame, most: int = 2000, overhead: int = 24) -> DataFrame:
    """Elements packed in order into batches of at most `most` characters, each costing `overhead` more."""

    def pack(rows):
        out, size, no = [], None, -1
        for r in rows:
            cost = len(r["text"]) + overhead
            if size is None or size + cost > most:
                no, size = no + 1, 0
                out.append({"doc_id": r["doc_id"], "batch_no": no, "n_chunks": 0, "n_chars": 0})
            size += cost
            out[-1]["n_chunks"] += 1
            out[-1]["n_chars"] += len(r["text"])
        return out

    return _per_document(e, pack, "doc_id long, batch_no int, n_chunks int, n_chars long")


def split_text(text: str, most: int) -> list[tuple[int, int]]:
    """Contiguous parts of at most `most` characters where lines and sentences allow, as half-open offsets."""
    units, at = [], 0
    for line in text.split("\n"):
        if line:
            cuts = [0, *(m.end() for m in _SENTENCE.finditer(line))] if len(line) > most else [0]
            units += [(at + a, at + b) for a, b in zip(cuts, [*cuts[1:], len(line)])]
        at += len(line) + 1
    parts: list[list[int]] = []
    for a, b in units:
        if parts and b - parts[-1][0] <= most:
            parts[-1][1] = b
        else:
            parts.append([a, b])
    return [(a, a + len(text[a:b].rstrip())) for a, b in parts]
