"""Gates over what a model wrote: runs of blank cells and rows, unclosed documents, repeats, and choices between reads.

All but the two scans for repeated words are expressions over one column. A null or empty read has no
runs, is closed, and no loop.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import currency_cents
from docweave.operators.grouped import values as listed
from docweave.operators.parsing import has_repeated_content

# Where rows end in raw output, what a blank run and a separator row look like, closing signs, and thresholds.
SEAM = r"\\r\\n|\r\n|\\n|\n"
BLANK_RUN = r"\|(?:[^\S\r\n]*\|)+"
BLANK_ROW = r"^[^|]*\|[\s|]*\|[^|]*$"
SEPARATOR_ROW = r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$"
PIPES = r"(?:\|[^\S\r\n]*)+"
CLOSING = r"""["'\]}\s,]+$"""
BLANK_ROWS, RUN_ANYWHERE, RUN_AT_END = 18, 16, 12
WINDOW_REPEATS, SEPARATOR_REPEATS, MARK_REPEATS, WORD_REPEATS, SEPARATORS = 6, 40, 24, 12, ("-", "_", ".")
RESTORED_CHARS, AT_RISK_RUN, XREF_WORDS, DICE = 4, 8, 3, 0.80
_DIGIT = re.compile("[0-9]")
DEMOTED, RESTORABLE = ("inconsistent", "low_coverage"), ("truncated",)


def _pipes(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))


def rows_of(raw: Column) -> Column:
    return F.split(F.coalesce(raw, F.lit("")), SEAM)


def _longest(texts: Column, less: int) -> Column:
    return F.coalesce(F.array_max(F.transform(texts, lambda t: _pipes(t) - less)), F.lit(0))


def blank_cell_run(raw: Column) -> Column:
    """The longest run of blank cells within one row, in cells."""
    return _longest(F.flatten(F.transform(rows_of(raw), lambda r: F.regexp_extract_all(r, F.lit(BLANK_RUN), 0))), 1)


def pipe_run(raw: Column) -> Column:
    """The longest run of pipes with nothing between them, in pipes."""
    return _longest(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(PIPES), 0), 0)


def blank_row_run(raw: Column) -> Column:
    """The longest run of rows of blank cells; lines without text don't end it, all others do."""
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, r):
        now = F.when(r.rlike(BLANK_ROW), s["now"] + 1).when(r.rlike(r"\S"), 0).otherwise(s["now"])
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(rows_of(raw), state, step, lambda s: s["most"])


def content_rows(raw: Column) -> Column:
    """Rows of cells of which one has content; separator rows have none."""
    return F.size(F.filter(rows_of(raw), lambda r: (_pipes(r) >= 2) & ~r.rlike(BLANK_ROW) & ~r.rlike(SEPARATOR_ROW)))


def grid_width(raw: Column) -> Column:
    """The widest row, in cells, of a width that occurs twice or more; 0 without one."""
    widths = F.array_sort(F.filter(F.transform(rows_of(raw), lambda r: _pipes(r) - 1), lambda w: w > 0))
    n = F.greatest(F.size(widths) - 1, F.lit(0))
    twice = F.zip_with(F.slice(widths, F.lit(1), n), F.slice(widths, F.lit(2), n), lambda a, b: F.when(a == b, a))
    return F.coalesce(F.array_max(twice), F.lit(0))


def unfenced(raw: Column) -> Column:
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    return F.when(s.startswith("```"), F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")).otherwise(s)


def is_unterminated(raw: Column) -> Column:
    """Not a complete JSON document; empty reads are complete."""
    s = unfenced(raw)
    return (s != "") & F.try_parse_json(s).isNull()


def ends_blank(raw: Column) -> Column:
    """The output, less the signs that close it, ends in a run of blank cells."""
    open_ = F.regexp_replace(F.coalesce(raw, F.lit("")), CLOSING, "")
    return F.element_at(F.split(open_, SEAM), -1).rlike(f"(?:{BLANK_RUN})$")


def is_loop(raw: Column) -> Column:
    """Never closed, and either ends in blank cells or has more blank rows in a row than any real page."""
    return is_unterminated(raw) & (ends_blank(raw) | (blank_row_run(raw) >= BLANK_ROWS))


def is_loop_strict(raw: Column) -> Column:
    """A loop, or blank runs beyond what the page's own tables show."""
    width, content = grid_width(raw), content_rows(raw)
    return is_loop(raw) | ((width > 0) & (blank_cell_run(raw) > width)) | ((content > 0) & (blank_row_run(raw) > content))


def old_cell_loop(raw: Column) -> Column:
    """The older rule: a run of pipes of a fixed length, a shorter one near the end."""
    s = F.coalesce(raw, F.lit(""))
    near = F.greatest(F.lit(3), F.floor(F.length(s) / 100))
    # a run of the shorter length that has less than the window behind it; runs can't be longer than the text
    tail = F.length(F.regexp_extract(s, rf"(?s)^.*(?:\|[^\S\r\n]*){{{RUN_AT_END},}}(.*)$", 1))
    at_end = s.rlike(rf"(?:\|[^\S\r\n]*){{{RUN_AT_END},}}") & (tail <= near)
    return (pipe_run(raw) >= RUN_ANYWHERE) | at_end


def repeated_words(text: str | None) -> bool:
    """The older rule for words: windows of three or two in a row, or one token, more often than its kind may."""
    tokens = re.findall(r"\w+|[^\w\s]", (text or "").casefold())
    for size in (3, 2):
        same = 1
        for at in range(size, len(tokens) - size + 1, size):
            window = tokens[at : at + size]
            same = same + 1 if window == tokens[at - size : at] else 1
            if same >= (SEPARATOR_REPEATS if all(t in SEPARATORS for t in window) else WINDOW_REPEATS):
                return True
    run = 1
    for before, token in zip(tokens, tokens[1:]):
        run = run + 1 if token == before else 1
        most = SEPARATOR_REPEATS if token in SEPARATORS else MARK_REPEATS if len(token) == 1 and not token.isalnum() else WORD_REPEATS
        if run >= most:
            return True
    return False


def suspicions(reads: DataFrame, text: str = "text", raw: str = "raw") -> DataFrame:
    """reads with old_word, old_cell, new_word and new_cell: both rules for words and for cells."""

    @F.pandas_udf("struct<old_word:boolean,new_word:boolean>")
    def words(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"old_word": [repeated_words(t) for t in texts], "new_word": [has_repeated_content(t) for t in texts]})

    return reads.withColumn("_w", words(text)).select(*reads.columns, "_w.old_word", old_cell_loop(F.col(raw)).alias("old_cell"), "_w.new_word", is_loop(F.col(raw)).alias("new_cell"))


def has_no_text(*texts: Column) -> Column:
    """No text in any of the arrays of a page's blocks, key values and cells."""
    return ~F.exists(F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in texts)), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")


def restorable(reason: Column, unusable_otherwise: Column, substance: Column) -> Column:
    """Whether a rejected read may stand in for an empty fallback: always if it was only demoted, else if
    nothing but its truncation was wrong and it has some text."""
    return F.coalesce(F.when(reason.isin(*DEMOTED), True).when(reason.isin(*RESTORABLE), unusable_otherwise.isNull() & (substance >= RESTORED_CHARS)), F.lit(False))


def structures_differ(tables_a: Column, tables_b: Column, raw_a: Column, raw_b: Column) -> Column:
    """Reads of one page with other numbers of tables, or runs of blank cells that differ much."""
    return (tables_a != tables_b) | (F.abs(pipe_run(raw_a) - pipe_run(raw_b)) >= AT_RISK_RUN)


def needs_second_source(error: Column, words: Column, handwritten: Column) -> Column:
    """A page that couldn't be read, has no words, or has some handwriting."""
    return error.isNotNull() | (F.coalesce(words, F.lit(0)) == 0) | (F.coalesce(handwritten, F.lit(0)) >= XREF_WORDS)


def kind_counts(elements: DataFrame, *key: str) -> DataFrame:
    """Of each key the texts and key values with text, the tables and the figures."""
    full = F.trim("text") != ""
    return elements.groupBy(*key).agg(F.count_if((F.col("chunk_type") == "text") & full).alias("text"), F.count_if(F.col("chunk_type") == "table").alias("table"), F.count_if(F.col("chunk_type") == "image").alias("image"), F.count_if((F.col("chunk_type") == "kv") & full).alias("key_value"))


def text_layer_matches(tokens: DataFrame) -> DataFrame:
    """tokens: (id, side a or b, token). matches: Dice of the multisets reaches the limit, and a has as many tokens with digits."""
    n = tokens.groupBy("id", "token").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    digit = F.col("token").rlike("[0-9]")
    by = n.groupBy("id").agg(F.sum(F.least("a", "b")).alias("m"), F.sum(F.col("a") + F.col("b")).alias("n"), F.sum(F.when(digit, F.col("a")).otherwise(0)).alias("da"), F.sum(F.when(digit, F.col("b")).otherwise(0)).alias("db"))
    return by.select("id", ((2 * F.col("m") >= DICE * F.col("n")) & (F.col("da") >= F.col("db"))).alias("matches"))


def layers_match(layers: DataFrame, sign: str = " ") -> DataFrame:
    """text_layer_matches of the pieces of whole texts. layers: (id, a, b); an id's rows count together. Ids without text have no row.

    Tokens are counted in the task that has an id's texts, so that none is a row.
    """
    x = layers.groupBy("id").agg(F.collect_list("a").alias("_a"), F.collect_list("b").alias("_b")).where("size(_a) + size(_b) > 0")

    @F.arrow_udf("boolean")
    def match(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for k in range(len(left)):
            na, nb = (Counter(t for text in side[k].as_py() for t in text.split(sign)) for side in (left, right))
            m = sum(min(c, nb[t]) for t, c in na.items() if t in nb)
            da, db = (sum(c for t, c in n.items() if _DIGIT.search(t)) for n in (na, nb))
            out.append(2 * m >= DICE * (na.total() + nb.total()) and da >= db)
        return pa.array(out, pa.bool_())

    return x.select("id", match("_a", "_b").alias("matches"))


def text_layer_amounts(words: DataFrame) -> DataFrame:
    """words: (page_id, word_id, x0, y0, x1, y1, word). Currency words, less the nearest one left of each % on its line.

    Words meet on strips of the page, so that only neighbours are compared.
    """
    strip = 16.0
    amounts = words.withColumn("cents", currency_cents(F.col("word"))).where("cents is not null")
    bands = F.explode(F.sequence(F.floor(F.col("y0") / strip), F.floor(F.col("y1") / strip)))
    signs = words.where("word = '%'").select("page_id", F.col("word_id").alias("sign"), F.col("x0").alias("sx"), F.col("y0").alias("s0"), F.col("y1").alias("s1"), bands.alias("band"))
    left = amounts.withColumn("band", bands).join(signs, ["page_id", "band"]).where("y0 < s1 and y1 > s0 and x1 < sx")
    nearest = Window.partitionBy("page_id", "sign").orderBy(F.desc("x1"), "word_id")
    taken = left.dropDuplicates(["page_id", "sign", "word_id"]).withColumn("_r", F.row_number().over(nearest)).where("_r = 1").select("page_id", "word_id").distinct()
    return amounts.join(taken, ["page_id", "word_id"], "left_anti").select("page_id", "word_id", "cents")


# ---- what can be saved of output that was cut off ----

_BOX = re.compile(r'"bbox_2d"\s*:\s*\[([^\]]*)\]')
_TEXT = re.compile(r'"text_content"\s*:\s*"')


def _braces(raw: str):
    """(position, sign, depth after it) of brackets outside strings."""
    depth, inside, at = 0, False, 0
    while at < len(raw):
        c = raw[at]
        if inside and c == "\\":
            at += 1
        elif c == '"':
            inside = not inside
        elif not inside and c in "[{":
            depth += 1
            yield at, c, depth
        elif not inside and c in "]}":
            depth -= 1
            yield at, c, depth
        at += 1


def closed_json(raw: str) -> str:
    """An array that was cut off, closed after its last whole record; other text as it is."""
    start = raw.find("[")
    ends = [at for at, c, depth in _braces(raw[start:]) if c == "}" and depth == 1] if start >= 0 else []
    return f"{raw[: start + ends[-1] + 1]}]" if ends else raw


def salvaged_table(raw: str) -> tuple[list[int], str] | None:
    """Box and text of a last record cut off within a table, up to its last whole cell or row; else None."""
    whole = max((at for at, c, _ in _braces(raw) if c == "}"), default=-1)
    start = raw.rfind("{")
    if start <= whole:
        return None
    box, text = _BOX.search(raw, start), _TEXT.search(raw, start)
    if not box or not text:
        return None
    body = raw[text.end() :]
    if re.search(r'(?:^|[^\\])(?:\\\\)*"', body) or (body.count("|") < 2 and "\\n" not in body):
        return None
    cut = max(body.rfind("|") + 1, body.rfind("\\n") + 2 if "\\n" in body else 0)
    if cut <= 0:
        return None
    try:
        return [round(float(x)) for x in box[1].split(",")], json.loads(f'"{body[:cut].rstrip(chr(92))}"')
    except ValueError:
        return None


def fallback_records(raw: str) -> list[tuple[int, int, int, int, str, str]]:
    """Records of the other reader, in order: boxes come with y first; output after the last bracket is dropped."""
    text = (raw or "").strip()
    try:
        found = json.loads(text[: text.rfind("]") + 1] or text)
    except ValueError:
        return []
    out = []
    for r in found if isinstance(found, list) else []:
        if not isinstance(r, dict):
            continue
        box, body = r.get("bbox_2d") or r.get("bbox"), r["text_content"] if r.get("text_content") is not None else r.get("text")
        if isinstance(box, list) and len(box) == 4 and isinstance(body, str):
            try:
                y0, x0, y1, x1 = (round(float(v)) for v in box)
            except (TypeError, ValueError):
                continue
            out.append((x0, y0, x1, y1, body.strip(), str(r.get("type") or "text").strip().lower()))
    return out


# ---- confidence of a record from the tokens that wrote it ----


def token_spans(raw: str, tokens: list[str | None]) -> list[tuple[int, int]] | None:
    """Where each token stands in raw. Tokens that don't fit wait for the next that is found, of two
    characters at least, and share the gap before it. None if no token takes any place."""
    spans: list[tuple[int, int]] = []
    at, waiting = 0, 0
    for token in tokens:
        clean = bool(token) and "�" not in token
        place = -1
        if clean and not waiting:
            place = at if raw.startswith(token, at) else -1
        elif clean and len(token) >= 2:
            place = raw.find(token, at)
        if place < 0:
            waiting += 1
            continue
        spans += [(at, place)] * waiting + [(place, place + len(token))]
        at, waiting = place + len(token), 0
    spans += [(at, len(raw))] * waiting
    return None if tokens and all(a == at for a, _ in spans) else spans


def value_span(raw: str, value: str, start: int) -> tuple[int, int] | None:
    """Where a value stands in raw from `start`, in the forms in which JSON may write it."""
    for form in (json.dumps(value, ensure_ascii=False)[1:-1], json.dumps(value)[1:-1], value):
        at = raw.find(form, start) if form else -1
        if at >= 0:
            return at, at + len(form)
    return None


def _own(raw: str, probs: list[float], spans: tuple[list[int], list[int]] | None, values: list[str]):
    """The log probabilities of the tokens that overlap each value, in order of writing; None where there are none."""
    at = 0
    for v in values:
        place = value_span(raw, v, at) if spans else None
        if place is None:
            yield None
            continue
        at = place[1]
        # both ends of the spans never go back, so a value's tokens follow each other
        yield probs[bisect_right(spans[1], place[0]) : bisect_left(spans[0], place[1])] or None


def confidences(raw: str, tokens: list[tuple[float, str | None]], values: list[str]) -> list[tuple[float, float, float, int] | None]:
    """For each value, in order of writing: mean, least and deviation of the log probabilities of the tokens that overlap it, and their number."""
    spans = token_spans(raw, [t for _, t in tokens]) if raw and tokens else None
    out = []
    for own in _own(raw, [p for p, _ in tokens], tuple(map(list, zip(*spans))) if spans else None, values):
        mean = sum(own) / len(own) if own else 0.0
        out.append((mean, min(own), (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5, len(own)) if own else None)
    return out


def _places(raw: str, tokens: pa.Array) -> tuple[list[int], list[int]] | None:
    """token_spans, as beginnings and ends. Tokens that are raw's beginning, none of them empty, are not made strings one by one."""
    if not raw or not len(tokens):
        return None
    if not tokens.null_count:
        sizes = pc.utf8_length(tokens).to_numpy()
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens), "")[0].as_py()
        if sizes.min() > 0 and "�" not in whole and raw.startswith(whole):
            ends = sizes.cumsum().tolist()
            return [0, *ends[:-1]], ends
    spans = token_spans(raw, tokens.to_pylist())
    return tuple(map(list, zip(*spans))) if spans else None


def with_confidences(reads: DataFrame) -> DataFrame:
    """reads: raw, tokens (array of logprob, token), values (array): the same with `confidence`, for each value exp of the least log probability."""

    @F.arrow_udf("array<double>")
    def score(raws: pa.Array, tokens: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for k in range(len(raws)):
            raw, ts, vs = raws[k].as_py() or "", tokens[k].values, values[k].values
            probs, spans = ([], None) if ts is None else (listed(ts.field("logprob")), _places(raw, ts.field("token")))
            out.append([None if own is None else math.exp(min(own)) for own in _own(raw, probs, spans, [] if vs is None else vs.to_pylist())])
        return pa.array(out, pa.list_(pa.float64()))

    return reads.withColumn("confidence", score("raw", "tokens", "values"))
