"""Gates over raw reads and choices between them, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import responses as P
from docweave.operators import reads as R
from docweave.operators.grouped import small_batches
from docweave.plans.elements import SQL as E
from docweave.plans.elements import elements

#: Raw reads made of documents, in words that both engines understand.
_RAW = (
    "CASE doc_id % 8 WHEN 0 THEN '[' || doc_id || ', 1]' WHEN 1 THEN '[' || doc_id || ', \"' || repeat('| ', CAST(doc_id % 40 AS INT)) WHEN 2 THEN '```json' || chr(10) || '[1]' || chr(10) || '```' "
    "WHEN 3 THEN '[' || text || repeat(chr(10) || '| |  |', CAST(doc_id % 40 AS INT)) WHEN 4 THEN '' WHEN 5 THEN '[| a | b |' || chr(10) || '| --- | --- |' || repeat(chr(92) || 'n| c |  |', CAST(doc_id % 9 AS INT)) || text "
    "WHEN 6 THEN text || repeat('|', CAST(doc_id % 30 AS INT)) || repeat('.', CAST(doc_id % 90 AS INT)) END"
)


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _reads(s, d):
    return _t(s, d, "documents").selectExpr("doc_id", "text", f"{_RAW} raw")


def read_runs(s, d):
    raw = F.col("raw")
    return _reads(s, d).select("doc_id", R.blank_cell_run(raw).alias("cell_run"), R.pipe_run(raw).alias("pipe_run"), R.blank_row_run(raw).alias("row_run"), R.content_rows(raw).alias("content_rows"), R.grid_width(raw).alias("width"))


def read_loops(s, d):
    raw = F.col("raw")
    return _reads(s, d).select("doc_id", R.is_unterminated(raw).alias("unterminated"), R.ends_blank(raw).alias("ends_blank"), R.is_loop(raw).alias("is_loop"), R.is_loop_strict(raw).alias("strict"), R.old_cell_loop(raw).alias("old_cell"))


def read_suspicions(s, d):
    small_batches(s)
    return R.suspicions(_reads(s, d)).drop("text", "raw")


def page_kind_counts(s, d):
    return R.kind_counts(elements(_t(s, d, "documents").select("doc_id", "text")), "doc_id", "page_no")


def pages_without_text(s, d):
    e = elements(_t(s, d, "documents").select("doc_id", "text"), decorate=False).groupBy("doc_id", "page_no")
    pages = e.agg(F.collect_list(F.when(F.col("chunk_type") == "text", F.col("text"))).alias("blocks"), F.collect_list(F.when(F.col("chunk_type") == "table", F.col("text"))).alias("cells"))
    return pages.select("doc_id", "page_no", R.has_no_text(F.col("blocks"), F.col("cells")).alias("no_text"))


def read_restorations(s, d):
    x = _t(s, d, "events").selectExpr("event_id", "case event_id % 5 when 0 then 'inconsistent' when 1 then 'truncated' when 2 then 'empty' when 3 then 'low_coverage' end reason", "case when event_id % 3 = 0 then 'repeated_ngram' end other", "cast(event_id % 7 as int) n")
    return x.select("event_id", R.restorable(F.col("reason"), F.col("other"), F.col("n")).alias("restorable"))


def structure_gaps(s, d):
    x = _reads(s, d).selectExpr("doc_id", "raw", "doc_id % 11 > 8 more", "concat(raw, repeat('|', cast(doc_id % 17 as int))) other")
    return x.select("doc_id", R.structures_differ(F.lit(1), F.expr("if(more, 2, 1)"), F.col("raw"), F.col("other")).alias("differ"))


def second_sources(s, d):
    x = _t(s, d, "events").selectExpr("event_id", "case when event_id % 9 = 0 then 'timeout' end error", "cast(user_id % 4 as int) words", "cast(event_id % 5 as int) hand")
    return x.select("event_id", R.needs_second_source(F.col("error"), F.col("words"), F.col("hand")).alias("needed"))


def layer_matches(s, d):
    t = _t(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    other = F.expr("if(id % 3 = 0, substring_index(text, ' ', greatest(1, size(split(text, ' ')) - 2)), text)")
    small_batches(s)
    return R.layers_match(t.select("id", other.alias("a"), F.col("text").alias("b")))


def layer_amounts(s, d):
    x = _t(s, d, "lineitem").selectExpr("l_orderkey page_id", "l_linenumber n", "printf('$%.2f', l_extendedprice) w")
    amounts = x.selectExpr("page_id", "n * 10 word_id", "n * 60.0D x0", "(n % 3) * 14.0D y0", "n * 60.0D + 40 x1", "(n % 3) * 14.0D + 12 y1", "w word")
    signs = x.where("n % 4 = 0").selectExpr("page_id", "n * 10 + 1 word_id", "n * 60.0D + 42 x0", "(n % 3) * 14.0D y0", "n * 60.0D + 48 x1", "(n % 3) * 14.0D + 12 y1", "'%' word")
    return R.text_layer_amounts(amounts.union(signs))


def token_confidences(s, d):
    """Each line of a document is a record; its tokens are pieces of five characters, with made-up probabilities."""
    x = _t(s, d, "documents").selectExpr("doc_id", "filter(split(text, '\\n'), l -> l <> '') values").withColumn("raw", F.to_json("values"))
    # substring() counts from the text's start for each piece, the pattern goes through it once
    tokens = F.expr("transform(regexp_extract_all(raw, '(?s).{1,5}', 0), (t, i) -> named_struct('logprob', -((i * 7) % 10) / 10D, 'token', t))")
    small_batches(s)
    return R.with_confidences(x.withColumn("tokens", tokens)).select("doc_id", F.size("confidence").alias("records"), F.round(F.array_min("confidence"), 9).alias("least"))


def context_lines(s, d):
    return P.context_lines(elements(_t(s, d, "documents").select("doc_id", "text")))


def high_stakes_fields(s, d):
    x = _t(s, d, "events").selectExpr("event_id", "concat(case event_id % 3 when 0 then 'rows[' when 1 then 'x.' else '' end, event_id, case event_id % 4 when 0 then '.member_id' when 1 then '.total' when 2 then '.member_ids' else '' end) path")
    return x.select("event_id", P.high_stakes(F.col("path"), (".member_id", ".total")).alias("high"))


def restored_answers(s, d):
    """Answers with short column names and without null fields, back in the user's shape."""
    schema = {"name": {"type": "string"}, "rows": {"type": "array", "items": {"type": "object", "properties": {"quantity": {"type": "number"}, "part": {"type": "string"}}}}, "more": {"type": "object", "properties": {"x": {"type": "string"}}}}
    x = _t(s, d, "events").selectExpr("event_id", "case event_id % 3 when 0 then concat('{\"rows\": [{\"a\": ', event_id, '}]}') when 1 then concat('{\"name\": \"n', event_id, '\", \"more\": {}}') else '[' end answer")
    return P.answers(x, schema, wrap=False).select("event_id", "restored")


QUERIES = {f.__name__: f for f in (read_runs, read_loops, read_suspicions, page_kind_counts, pages_without_text, read_restorations, structure_gaps, second_sources, layer_matches, layer_amounts, token_confidences, context_lines, high_stakes_fields, restored_answers)}

_X = f"x AS (SELECT doc_id, coalesce({_RAW}, '') raw FROM documents)"
_SEAMS = r"string_split_regex({0}, '\\r\\n|\r\n|\\n|\n')"
_P = "(length({0}) - length(replace({0}, '|', '')))"
_ROWS = rf"""{_X}, s AS (SELECT doc_id, {_SEAMS.format("raw")} rs FROM x), u AS (SELECT doc_id, unnest(rs) r, generate_subscripts(rs, 1) i FROM s),
k AS (SELECT *, {_P.format("r")} p, regexp_matches(r, '^[^|]*\|[\s|]*\|[^|]*$') blank, regexp_matches(r, '\S') something, regexp_matches(r, '^\s*\|(\s*:?--+:?\s*\|)+\s*$') sep FROM u),
g AS (SELECT *, sum(CASE WHEN something AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) g FROM k),
rr AS (SELECT doc_id, max(n)::INT row_run FROM (SELECT doc_id, g, count(*) FILTER (blank) n FROM g GROUP BY ALL) GROUP BY doc_id),
ww AS (SELECT doc_id, max(p - 1)::INT width FROM (SELECT doc_id, p FROM k WHERE p >= 2 GROUP BY doc_id, p HAVING count(*) >= 2) GROUP BY doc_id),
cc AS (SELECT doc_id, (count(*) FILTER (p >= 2 AND NOT blank AND NOT sep))::INT content_rows, coalesce(max(list_max(list_transform(regexp_extract_all(r, '\|([ \t]*\|)+'), lambda t: {_P.format("t")} - 1))), 0)::INT cell_run FROM k GROUP BY doc_id),
pp AS (SELECT doc_id, raw, coalesce(list_max(list_transform(regexp_extract_all(raw, '(\|[ \t]*)+'), lambda t: {_P.format("t")})), 0)::INT pipe_run FROM x),
y AS (SELECT doc_id, raw, cell_run, pipe_run, row_run, content_rows, coalesce(width, 0)::INT width FROM pp JOIN rr USING (doc_id) JOIN cc USING (doc_id) LEFT JOIN ww USING (doc_id))"""
_LOOPS = rf"""z AS (SELECT *, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^```[a-zA-Z]*\s*|\s*```$', '', 'g') j, regexp_replace(raw, '["''\]}}\s,]+$', '') o FROM y),
l AS (SELECT *, j <> '' AND NOT json_valid(j) unterminated, regexp_matches({_SEAMS.format("o")}[-1], '\|([ \t]*\|)+$') ends_blank FROM z), m AS (SELECT *, unterminated AND (ends_blank OR row_run >= 18) is_loop FROM l)"""
ORACLE_SQL = {
    "read_runs": f"WITH {_ROWS} SELECT doc_id, cell_run, pipe_run, row_run, content_rows, width FROM y",
    "read_loops": rf"WITH {_ROWS}, {_LOOPS} SELECT doc_id, unterminated, ends_blank, is_loop, is_loop OR (width > 0 AND cell_run > width) OR (content_rows > 0 AND row_run > content_rows) strict, pipe_run >= 16 OR len(list_filter(generate_series(0, greatest(3, length(raw) // 100)), lambda k: regexp_matches(left(raw, length(raw) - k), '(\|[ \t]*){{12,}}$'))) > 0 old_cell FROM m",
    "page_kind_counts": f"WITH {E} SELECT doc_id, page_no, count(*) FILTER (chunk_type = 'text' AND trim(text) <> '') AS \"text\", count(*) FILTER (chunk_type = 'table') AS \"table\", count(*) FILTER (chunk_type = 'image') image, 0::BIGINT key_value FROM e GROUP BY doc_id, page_no",
    "pages_without_text": f"WITH {E} SELECT doc_id, (line_no // 10 + 1)::INT page_no, bool_and(trim(line) = '') no_text FROM lines GROUP BY ALL",
    "read_restorations": "SELECT event_id, event_id % 5 IN (0, 3) OR (event_id % 5 = 1 AND event_id % 3 <> 0 AND event_id % 7 >= 4) restorable FROM events",
    "structure_gaps": f"WITH x AS (SELECT doc_id, {_RAW} raw FROM documents), y AS (SELECT doc_id, raw, raw || repeat('|', (doc_id % 17)::INT) o FROM x), z AS (SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(coalesce(raw, ''), '(\\|[ \\t]*)+'), lambda t: {_P.format('t')})), 0) a, coalesce(list_max(list_transform(regexp_extract_all(coalesce(o, ''), '(\\|[ \\t]*)+'), lambda t: {_P.format('t')})), 0) b FROM y) SELECT doc_id, doc_id % 11 > 8 OR abs(a - b) >= 8 AS differ FROM z",
    "second_sources": "SELECT event_id, event_id % 9 = 0 OR user_id % 4 = 0 OR event_id % 5 >= 3 needed FROM events",
    "layer_matches": "WITH d AS (SELECT doc_id id, string_split(text, ' ') b, doc_id % 3 = 0 cut FROM documents), s AS (SELECT id, CASE WHEN cut THEN b[1:greatest(1, len(b) - 2)] ELSE b END a, b FROM d), t AS (SELECT id, unnest(a) AS token, 1 na, 0 nb FROM s UNION ALL SELECT id, unnest(b), 0, 1 FROM s), c AS (SELECT id, token, sum(na) na, sum(nb) nb FROM t GROUP BY ALL) SELECT id, 2 * sum(least(na, nb)) >= 0.8 * sum(na + nb) AND coalesce(sum(na) FILTER (regexp_matches(token, '[0-9]')), 0) >= coalesce(sum(nb) FILTER (regexp_matches(token, '[0-9]')), 0) matches FROM c GROUP BY id",
    "context_lines": f"WITH {E}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, idx) - 1 i FROM e WHERE trim(text) <> '') SELECT doc_id, page_no, idx, '[' || i || ' | page ' || page_no || CASE WHEN chunk_type = 'table' THEN ' | table] ' ELSE '] ' END || text AS line FROM f",
    "high_stakes_fields": "SELECT event_id, event_id % 4 IN (0, 1) high FROM events",
    "restored_answers": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"rows": [{"quantity": ' || event_id || ', "part": null}], "name": null, "more": {"x": null}}' WHEN 1 THEN '{"name": "n' || event_id || '", "more": {"x": null}, "rows": []}' END restored FROM events""",
    "layer_amounts": "WITH x AS (SELECT l_orderkey page_id, l_linenumber n, round(l_extendedprice * 100)::BIGINT cents FROM lineitem), s AS (SELECT page_id, n FROM x WHERE n % 4 = 0), p AS (SELECT s.page_id, s.n sign, x.n, row_number() OVER (PARTITION BY s.page_id, s.n ORDER BY x.n DESC) k FROM s JOIN x ON x.page_id = s.page_id AND abs((x.n % 3) - (s.n % 3)) * 14 < 12 AND x.n * 60 + 40 < s.n * 60 + 42) SELECT page_id, n * 10 word_id, cents FROM x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = x.page_id AND p.n = x.n AND k = 1)",
}
