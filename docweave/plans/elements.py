"""Page elements from document text: the layout that all layout operators read.

doc_id, page_no, idx, chunk_type (text, table, image), text, x0, y0, x1, y1. One element per line,
10 lines a page of 612 x 792 points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What stands before a line, by the line's number: place, condition, kind, text, height.
_ADDED = (
    (0, 13, "image", "''", 7),
    (1, 7, "text", "concat(cast(line_no as string), '. Part')", 7),
    (2, 11, "text", "'ALL ABOUT THIS'", 9),
    (3, 17, "text", "concat('Note ', cast(line_no as string), ':')", 7),
    (4, 19, "text", "'- one item'", 7),
    (5, 19, "text", "'- one more item'", 7),
)


def elements(documents: DataFrame, decorate: bool = True) -> DataFrame:
    """Lines of documents, whole, as elements. `decorate` adds figures, headings, labels and list items before lines, by their numbers.

    idx is eight times the line's number, plus 7 for the line itself, less for what is added.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = "named_struct('k', 7, 'kind', if(length(line) - length(replace(line, '|', '')) >= 2, 'table', 'text'), 'text', line, 'at', 50, 'height', 12)"
    added = [f"if(line_no % {every} = 0, named_struct('k', {k}, 'kind', '{kind}', 'text', {text}, 'at', {8 * k}, 'height', {height}), null)" for k, every, kind, text, height in _ADDED] if decorate else []
    each = lines.selectExpr("doc_id", "line_no", "line", f"explode(filter(array({', '.join([*added, own])}), x -> x is not null)) x")
    return each.selectExpr(
        "doc_id",
        "cast(line_no * 8 + x.k as int) idx",
        "cast(line_no div 10 + 1 as int) page_no",
        "x.kind chunk_type",
        "x.text text",
        "cast(72 as double) x0",
        "cast(72 + 64 * (line_no % 10) + x.at as double) y0",
        "cast(72 + 5 * least(greatest(length(x.text), if(x.kind = 'image', 40, 0)), 90) as double) x1",
        "cast(72 + 64 * (line_no % 10) + x.at + x.height as double) y1",
    )


def _union() -> str:
    parts = ["SELECT doc_id, line_no, 7 k, CASE WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' ELSE 'text' END chunk_type, line AS text, 50 a, 12 h FROM lines"]
    for k, every, kind, text, height in _ADDED:
        text = {1: "line_no || '. Part'", 3: "'Note ' || line_no || ':'"}.get(k, text)
        parts.append(f"SELECT doc_id, line_no, {k}, '{kind}', {text}, {8 * k}, {height} FROM lines WHERE line_no % {every} = 0")
    return " UNION ALL ".join(parts)


#: The same elements for the SQL that checks queries.
SQL = f"""lines AS (
  SELECT doc_id, unnest(l) line, unnest(range(len(l)))::INT line_no, unnest(range(len(l)))::INT idx FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)
), u AS ({_union()}), e AS (
  SELECT doc_id, (line_no * 8 + k)::INT idx, (line_no // 10 + 1)::INT page_no, chunk_type, text,
    72::DOUBLE x0, (72 + 64 * (line_no % 10) + a)::DOUBLE y0, (72 + 5 * least(greatest(length(text), CASE WHEN chunk_type = 'image' THEN 40 ELSE 0 END), 90))::DOUBLE x1,
    (72 + 64 * (line_no % 10) + a + h)::DOUBLE y1
  FROM u)"""
