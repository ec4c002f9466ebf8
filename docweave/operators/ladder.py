"""The whole ladder by which a value is grounded in its document, one document a task.

leaves: leaf_id, doc_id, value, quote, cited (places of chunks, from 0), kind (declared type), members,
datetime (declared as a normalized date or time). chunks: doc_id, page_no, idx, text. The rungs are tried in
order; the first that finds a chunk is the value's anchor. Cited chunks come before others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.grounding import CONTAINED, LONG_PROSE, SHOWN, SUPPORT, SUPPORTS

# What a checked and an empty box look like in a source and in a quote, and their number in an option.
MARKED = re.compile(r"(?<!\w)\[\s*[xX✓✔]\s*\](?!\w)|[☑☒✓✔]")
MARKED_QUOTE = re.compile(r"(?<!\w)[\[(]\s*[xX✓✔]\s*[\])](?!\w)|[☑☒✓✔]")
EMPTY = re.compile(r"(?<!\w)\[\s*\](?!\w)|☐")
SELECTORS = {0xFE0E: None, 0xFE0F: None}
OPTION_BOXES, TOLERANT = 2, (8, 200)


def flat(text: str) -> str:
    return " ".join(text.split()).casefold()


def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def boxes_written(text: str) -> str:
    """Checked and empty boxes as [x] and [ ]."""
    return flat(EMPTY.sub("[ ]", MARKED_QUOTE.sub("[x]", text.translate(SELECTORS))))


def canonical(value: str) -> str:
    """A number without the zeros after its decimal point."""
    return value.rstrip("0").rstrip(".") if re.fullmatch(r"-?\d+\.\d+", value) else value


def run_pattern(text: str) -> re.Pattern | None:
    """Letters and digits of a text in order, with a few signs between, at neither end within a longer run."""
    words = re.findall("[A-Za-z0-9]+", text)
    inner = r"[\W_]{0,8}".join(r"[\W_]{0,2}".join(w) for w in words)
    return re.compile(f"(?<![A-Za-z0-9]){inner}(?![A-Za-z0-9])", re.I) if words else None


def digit_forms(value: str) -> set[str]:
    """The digits that a source may print for a date or time: with a short year, with a clock of twelve hours."""
    forms = {digits(value)}
    if m := re.match(r"\s*\d{2}(\d{2}-\d{1,2}-\d{1,2}.*)", value, re.S):
        forms.add(digits(m[1]))
    if (m := re.match(r"\s*(\d{1,2}):(\d{2}.*)", value, re.S)) and int(m[1]) <= 23:
        forms.add(digits(f"{int(m[1]) % 12 or 12}:{m[2]}"))
    return forms - {""}


def in_order(needle: str, hay: str) -> bool:
    rest = iter(hay)
    return all(c in rest for c in needle)


@dataclass
class Source:
    """A document's chunks, and its pages as one text each."""

    texts: list[str]
    pages: list[int]
    flat: list[str] = field(init=False)

    def __post_init__(self):
        self.flat = [flat(t) for t in self.texts]

    def joined(self, texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
        """Each page's text, and (first, past last, chunk) of what it is made of."""
        for page in sorted(set(self.pages)):
            own = [i for i, p in enumerate(self.pages) if p == page]
            starts = accumulate((len(texts[i]) + 1 for i in own), initial=0)
            yield " ".join(texts[i] for i in own), [(s, s + len(texts[i]), i) for s, i in zip(starts, own, strict=False)]


@dataclass
class Leaf:
    value: str
    quote: str = ""
    cited: tuple[int, ...] = ()
    kind: str | None = None
    members: tuple[str, ...] = ()
    datetime: bool = False


def rungs(leaf: Leaf, source: Source) -> Iterator[tuple[str, Callable[[], int | None]]]:
    """Names and searches, in order. A search gives a chunk or None."""
    n = len(source.texts)
    order = list(dict.fromkeys([*(i for i in leaf.cited if 0 <= i < n), *range(n)]))
    quote, value = flat(leaf.quote), flat(leaf.value)

    def first(holds: Callable[[int], bool]) -> int | None:
        return next((i for i in order if holds(i)), None)

    def across(texts: list[str], find: Callable[[str], tuple[int, int] | None]) -> Iterator[list[int]]:
        for text, spans in source.joined(texts):
            if place := find(text):
                yield [i for a, b, i in spans if a < place[1] and b > place[0]]

    def in_page() -> int | None:
        find = lambda t: (t.index(quote), t.index(quote) + len(quote)) if quote in t else None
        for touched in across(source.flat, find):
            if touched:
                return next((i for i in touched if value and value in source.flat[i]), touched[0])
        return None

    if quote:
        yield "quote", lambda: first(lambda i: quote in source.flat[i])
        yield "page_quote", in_page
    if len(value) >= CONTAINED and not value.isdigit():
        yield "contained", lambda: first(lambda i: value in source.flat[i])
    pattern = run_pattern(leaf.value)
    if pattern and TOLERANT[0] <= sum(map(len, re.findall("[A-Za-z0-9]+", leaf.value))) <= TOLERANT[1]:
        yield "separators", lambda: first(lambda i: bool(pattern.search(source.texts[i])))
        find = lambda t: m.span() if (m := pattern.search(t)) else None
        yield "page_separators", lambda: next((x[0] for x in across(source.texts, find) if x), None)
    if leaf.kind == "boolean":
        yes, shown = value == "true", boxes_written(leaf.quote)
        told = [shown.count("[x]"), shown.count("[ ]")]
        if len(shown) >= CONTAINED and (not any(told) or told[0 if yes else 1]):
            yield "checkbox_quote", lambda: first(lambda i: shown in boxes_written(source.texts[i]))
        if not leaf.quote.strip():

            def one_option() -> int | None:
                for i in (i for i in leaf.cited if 0 <= i < n):
                    text = source.texts[i].translate(SELECTORS)
                    on, off = len(MARKED.findall(text)), len(EMPTY.findall(text))
                    if 1 <= on + off <= OPTION_BOXES and (off == 0 if yes else on == 0):
                        return i
                return None

            yield "checkbox", one_option


def exemption(leaf: Leaf, source: Source) -> str | None:
    """Why a value that has no anchor need not have one."""
    if leaf.members and leaf.value in leaf.members:
        return "enum"
    if leaf.kind in ("number", "integer"):
        try:
            zero = float(leaf.value) == 0
        except ValueError:
            zero = False
        if zero:
            return "zero-default"
        d = digits(canonical(leaf.value))
        if d and any(d in digits(t) for t in source.texts):
            return "digits"
    elif re.fullmatch("[0-9]+", leaf.value) and any(map(run_pattern(leaf.value).search, source.texts)):
        return "digits"
    if leaf.datetime:
        lines = [d for t in source.texts for line in t.splitlines() if (d := digits(line))]
        if any(in_order(f, line) for f in digit_forms(leaf.value) for line in lines):
            return "date-digits"
    return None


def grounded(leaf: Leaf, source: Source, exempt: bool) -> tuple[str | None, list[int], str | None]:
    """(rung or exemption, anchor and supporting chunks in order, evidence of the anchor)."""
    for name, search in rungs(leaf, source):
        anchor = search()
        if anchor is None:
            continue
        places = [anchor]
        if len(leaf.value) >= LONG_PROSE:
            whole = flat(leaf.value)
            more = (i for i, t in enumerate(source.texts) if i != anchor and len(t) >= SUPPORT and source.flat[i] in whole)
            places += [i for i, _ in zip(more, range(SUPPORTS - 1), strict=False)]
        text = leaf.quote.strip() if name in ("quote", "page_quote") else source.texts[anchor]
        return name, sorted(places), text[:SHOWN]
    return (exemption(leaf, source) if exempt else None), [], None


GROUNDED = "leaf_id long, doc_id long, value string, grounded boolean, verified_by string, places array<int>, evidence string"


def ground(leaves: DataFrame, chunks: DataFrame, strict: bool = True, exempt: bool = True) -> DataFrame:
    """One row per leaf. Null and empty values are null and grounded; a value that nothing holds is
    ungrounded, and null if `strict`. `exempt`: schemas may excuse values (see exemption)."""
    names = [("leaf_id", pa.int64()), ("doc_id", pa.int64()), ("value", pa.string()), ("grounded", pa.bool_()), ("verified_by", pa.string()), ("places", pa.list_(pa.int32())), ("evidence", pa.string())]

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.to_pylist(), key=lambda r: (r["page_no"], r["idx"]))
        source, out = Source([r["text"] or "" for r in rows], [r["page_no"] for r in rows]), []
        for r in left.to_pylist():
            value = r["value"] or None
            name, places, evidence = None, [], None
            if value is not None:
                leaf = Leaf(value, r["quote"] or "", tuple(i for i in r["cited"] or () if i is not None), r["kind"], tuple(r["members"] or ()), bool(r["datetime"]))
                name, places, evidence = grounded(leaf, source, exempt)
            held = value is None or name is not None
            out.append((r["leaf_id"], r["doc_id"], value if held or not strict else None, held, name, places, evidence))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])

    more = {"kind": "string", "members": "array<string>", "datetime": "boolean", "cited": "array<int>"}
    asked = leaves.select("leaf_id", "doc_id", "value", "quote", *(F.col(c) if c in leaves.columns else F.lit(None).cast(t).alias(c) for c, t in more.items()))
    held = chunks.select("doc_id", "page_no", "idx", "text")
    return asked.groupBy("doc_id").cogroup(held.groupBy("doc_id")).applyInArrow(climb, GROUNDED)
