"""From pages to chunks, segments and fields, with readers and models plugged in."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import responses
from docweave.functions.schema import merged
from docweave.operators import reads as R
from docweave.operators.parsing import parse_records, record_kind
from docweave.operators.segmentation import Cell, segments, table_markdown
from docweave.operators.stitching import assembled, is_delimiter, row_cells
from docweave.plugins import FieldModel, PageReader

_KEY = ["doc_id", "page_no"]


def rejection() -> Column:
    """Why a read (raw, truncated, error) can't be served; null if it can. The first that holds."""
    raw = F.col("raw")
    return F.when(F.col("error").isNotNull(), "exception").when(F.coalesce(F.col("truncated"), F.lit(False)), "truncated").when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty").when(R.is_loop(raw), "repeated")


def read_pages(pages: DataFrame, primary: PageReader, fallback: PageReader | None = None) -> DataFrame:
    """doc_id, page_no, raw, provider, read_no, reason: the read that is served for each page.

    A rejected read is tried once more, then goes to the fallback. Where that gives nothing the first read
    is served if it was only cut off. A page that nobody could read is served with its reason. Each reader
    sees only the pages that need it.
    """
    def attempt(some: DataFrame, by: PageReader, n: int) -> DataFrame:
        got = by.read(some).select(*_KEY, "raw", "truncated", "error").withColumn("reason", rejection())
        return got.withColumn("provider", F.lit(by.name)).withColumn("read_no", F.lit(n))

    first = attempt(pages, primary, 1)
    again = attempt(pages.join(first.where("reason is not null").select(*_KEY), _KEY, "left_semi"), primary, 2)
    tries = first.union(again)
    good = tries.where("reason is null")
    if fallback is not None:
        left = pages.join(good.select(*_KEY), _KEY, "left_anti")
        tries = tries.union(attempt(left, fallback, 3))
    text = F.length(F.regexp_replace(F.coalesce("raw", F.lit("")), r"[^\p{L}\p{N}]", ""))
    cut = R.restorable(F.col("reason"), F.lit(None).cast("string"), text) & ~R.is_loop_strict(F.col("raw"))
    rank = F.when(F.col("reason").isNull(), F.col("read_no")).when(cut, 10 + F.col("read_no")).otherwise(20 + F.col("read_no"))
    w = Window.partitionBy(*_KEY).orderBy(rank)
    return tries.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*_KEY, "raw", "provider", "read_no", F.when(~cut | F.col("reason").isNull(), F.col("reason")).alias("reason"))


ELEMENTS = "doc_id long, page_no int, idx int, chunk_type string, text string, x0 double, y0 double, x1 double, y1 double, cells array<struct<text:string,row:int,col:int,row_span:int,col_span:int,page_no:int>>"


def table_cells(text: str) -> tuple[Cell, ...]:
    """The cells of a pipe table, its delimiter left out."""
    rows = [row_cells(line) for line in text.split("\n") if line.strip() and not is_delimiter(line)]
    return tuple(Cell(t.replace("\\|", "|"), r, c) for r, row in enumerate(rows) for c, t in enumerate(row))


def chunks(reads: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """reads: doc_id, page_no, raw. Records in order as elements: boxes in points and within the page, tables with cells.

    Records without text are left out, but for figures. A table that was cut off keeps its whole cells.
    """
    cell = pa.struct([("text", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("page_no", pa.int32())])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(cell))
    names = ("doc_id", "page_no", "idx", "chunk_type", "text", "x0", "y0", "x1", "y1", "cells")

    def parse(batches):
        for batch in batches:
            out = []
            for doc, page, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = parse_records(raw)
                if saved := R.salvaged_table(raw or ""):
                    found.append((*saved[0], saved[1], None))
                for n, (x0, y0, x1, y1, text, declared) in enumerate(found):
                    kind = record_kind(text, declared)
                    if not text and kind != "image":
                        continue
                    cells = table_cells(text) if kind == "table" else ()
                    xs, ys = (sorted(min(max(v / 1000 * size, 0.0), size) for v in pair) for pair, size in (((x0, x1), width), ((y0, y1), height)))
                    body = "" if kind == "image" else table_markdown(cells) if cells else text
                    out.append((doc, page, n, kind, body, xs[0], ys[0], xs[1], ys[1], [{"text": c.text, "row": c.row, "col": c.col, "row_span": 1, "col_span": 1, "page_no": page} for c in cells] or None))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return reads.select("doc_id", "page_no", "raw").mapInArrow(parse, ELEMENTS)


def extract_documents(pages: DataFrame, primary: PageReader, fallback: PageReader | None = None, size: int | None = 1000) -> dict[str, DataFrame]:
    """reads, chunks, tables joined over pages (assembled), and segments unless size is None."""
    reads = read_pages(pages, primary, fallback)
    found = chunks(reads)
    out = {"reads": reads, "chunks": found, "assembled": assembled(found)}
    return out | ({} if size is None else {"segments": segments(found, size)})


def prompts(found: DataFrame, budget: int = 60_000) -> DataFrame:
    """doc_id, batch_no, prompt: lines of context in order, about `budget` characters a batch."""
    lines = responses.context_lines(found)
    order = Window.partitionBy("doc_id").orderBy("page_no", "idx")
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    batch = F.floor(before / budget).cast("int")
    grouped = lines.withColumn("batch_no", batch).groupBy("doc_id", "batch_no")
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "idx", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def extract_fields(found: DataFrame, schema: dict, model: FieldModel, budget: int = 60_000, verify: bool = False) -> DataFrame:
    """doc_id, fields: one JSON object per document, merged over its batches in order.

    Raises SchemaError for schemas that can't be answered. Answers that aren't JSON count as empty. With
    `verify` text values that stand nowhere in the document are null.
    """
    responses.checked(schema)
    aliases = responses.row_aliases(schema)
    asked = responses.aliased(responses.response_schema(schema, wrap=False, optional=True), aliases)
    asks = prompts(found, budget)
    answered = responses.answers(model.answer(asks, asked), schema, wrap=False)
    node = {"type": "object", "properties": schema}
    shape = pa.schema([("doc_id", pa.int64()), ("fields", pa.string())])

    def flat(text: str) -> str:
        return " ".join(text.split()).casefold()

    def kept(value, source: str):
        if isinstance(value, dict):
            return {k: kept(v, source) for k, v in value.items()}
        if isinstance(value, list):
            return [kept(v, source) for v in value]
        return None if isinstance(value, str) and flat(value) not in source else value

    def fold(table: pa.Table) -> pa.Table:
        whole, source = responses.absent(node, wrap=False), []
        for row in sorted(table.to_pylist(), key=lambda r: r["batch_no"]):
            whole = merged(whole, json.loads(row["restored"] or "{}"))
            source.append(row["prompt"])
        whole = kept(whole, flat("\n".join(source))) if verify else whole
        return pa.Table.from_pylist([{"doc_id": table.column("doc_id")[0].as_py(), "fields": json.dumps(whole, ensure_ascii=False)}], schema=shape)

    both = asks.join(answered.select("doc_id", "batch_no", "restored"), ["doc_id", "batch_no"], "left")
    return both.groupBy("doc_id").applyInArrow(fold, "doc_id long, fields string")
