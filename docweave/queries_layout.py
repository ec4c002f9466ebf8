"""Layout queries over decorated elements, and their SQL."""

from __future__ import annotations

from docweave.operators import layout as L
from docweave.plans.elements import SQL as E
from docweave.plans.elements import elements


def _e(spark, sf):
    return elements(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def _on(f):
    return lambda spark, sf: f(_e(spark, sf))


QUERIES = {
    "document_content": _on(L.document_content),
    "reading_order": lambda s, d: L.reading_order(_e(s, d)).select("doc_id", "idx", "place"),
    "page_shape_metrics": _on(L.page_shape),
    "page_layout_stats": _on(L.page_stats),
    "element_gaps": lambda s, d: L.with_gaps(_e(s, d)).select("doc_id", "idx", "gap"),
    "doc_typography": _on(L.typography),
    "heading_strength": _on(L.heading_strength),
    "caption_pairs": _on(L.caption_pairs),
    "boundary_kinds": _on(L.boundaries),
    "furniture_flags": _on(L.furniture),
    "bbox_normalize": _on(lambda e: L.normalize_boxes(e).select("doc_id", "idx", *(f"{c}{i}" for c in "kp" for i in range(4)))),
    "layout_prefix": _on(L.layout_prefix),
    "fixed_partitions": _on(L.fixed_partitions),
    "design_sample": _on(L.design_sample),
}

_STATS = """g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page_no ORDER BY idx) gap FROM e),
st AS (SELECT doc_id, page_no, median(CASE WHEN chunk_type = 'text' AND text <> '' THEN y1 - y0 END) line_h_median, median(CASE WHEN gap > 0 THEN gap END) gap_median FROM g GROUP BY ALL)"""
_HEAD = _STATS + r""", m AS (SELECT e.*, st.line_h_median lh, st.gap_median gm, regexp_matches(trim(text), '^([-•*‣▪]|[0-9]{1,3}[.)]|[a-z][.)])\s+\S') AND chunk_type = 'text' item FROM e LEFT JOIN st USING (doc_id, page_no)),
m2 AS (SELECT *, lead(item) OVER w nitem, lead(x0) OVER w nx FROM m WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY idx)),
m3 AS (SELECT *, chunk_type = 'text' AND length(trim(text)) BETWEEN 1 AND 80 AND NOT regexp_matches(trim(text), '[.,]$') AND regexp_matches(text, '\pL') AND NOT (item AND coalesce(nitem, false) AND coalesce(abs(x0 - nx) <= 12, false)) AND NOT coalesce(y1 - y0 > 1.8 * lh, false) may FROM m2),
hs AS (SELECT doc_id, idx, CASE WHEN may AND (regexp_matches(trim(text), '^[0-9]+(\.[0-9]+)*[.)]?\s+\S') OR coalesce(y1 - y0 >= 1.15 * lh, false)) THEN 'strong' WHEN may AND len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: length(regexp_replace(w, '\PL', '', 'g')) >= 2)) >= 2 AND upper(text) = text THEN 'weak' END strength FROM m3)"""

ORACLE_SQL = {
    "document_content": f"WITH {E} SELECT doc_id, coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY page_no, idx), '') AS content, count(*) AS n_elements FROM e GROUP BY doc_id",
    "reading_order": f"WITH {E} SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, idx)::INT AS place FROM e",
    "page_shape_metrics": f"""WITH {E}, p AS (SELECT doc_id, page_no, count(*) n, max((chunk_type = 'table')::INT) t, max((chunk_type = 'image')::INT) i, max((text <> '')::INT) x FROM e GROUP BY ALL)
      SELECT doc_id, max(page_no) page_count, sum(t)::BIGINT table_pages, sum(i)::BIGINT image_pages, count(*) FILTER (x = 0) empty_pages,
      CASE WHEN max(n) = 0 THEN '0' WHEN max(n) <= 10 THEN '1-10' WHEN max(n) <= 100 THEN '11-100' WHEN max(n) <= 1000 THEN '101-1000' ELSE '>1000' END max_bucket FROM p GROUP BY doc_id""",
    "page_layout_stats": f"WITH {E}, {_STATS} SELECT * FROM st",
    "element_gaps": f"WITH {E}, {_STATS} SELECT doc_id, idx, gap FROM g",
    "doc_typography": f"""WITH {E}, l AS (SELECT doc_id, list_sort(list(y1 - y0)) h, list_sort(list((x1 - x0) / length(text))) w FROM e WHERE chunk_type = 'text' AND text <> '' GROUP BY doc_id)
      SELECT doc_id, h[len(h) // 2 + 1] line_h_upper_median, w[len(w) // 2 + 1] char_w_upper_median FROM l""",
    "heading_strength": f"WITH {E}, {_HEAD} SELECT * FROM hs",
    "caption_pairs": rf"""WITH {E}, w AS (SELECT *, lead(idx) OVER p ni, lead(chunk_type) OVER p nc, lead(text) OVER p nt, lead(x0) OVER p nx0, lead(x1) OVER p nx1, lead(y0) OVER p ny0 FROM e WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY idx))
      SELECT doc_id, idx fig_idx, ni text_idx FROM w WHERE chunk_type = 'image' AND nc = 'text' AND length(nt) BETWEEN 1 AND 200 AND ny0 - y1 <= 24
      AND ((least(x1, nx1) - greatest(x0, nx0)) / greatest(least(x1 - x0, nx1 - nx0), 1e-9) >= 0.5 OR regexp_matches(nt, '(?i)^(figure|fig\.?|table|chart|exhibit)\s*[0-9]'))""",
    "boundary_kinds": f"""WITH {E}, {_HEAD}, b AS (SELECT g.doc_id, g.idx, g.page_no, g.gap, hs.strength, st.gap_median gm, lag(g.page_no) OVER (PARTITION BY g.doc_id ORDER BY g.page_no, g.idx) pp FROM g JOIN hs USING (doc_id, idx) LEFT JOIN st ON st.doc_id = g.doc_id AND st.page_no = g.page_no),
      k AS (SELECT doc_id, idx, page_no, CASE WHEN pp IS NULL THEN NULL WHEN pp <> page_no THEN 'page' WHEN strength = 'strong' THEN 'heading' WHEN strength = 'weak' THEN 'heading_weak' WHEN gap >= greatest(2 * coalesce(gm, 0), 12) THEN 'gap' END boundary FROM b)
      SELECT doc_id, idx, boundary, sum((boundary IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY page_no, idx)::BIGINT group_no FROM k""",
    "furniture_flags": rf"""WITH {E} SELECT doc_id, idx, (y0 + y1) / 2 < 0.07 * 792 OR (y0 + y1) / 2 > (1 - 0.07) * 792 OR regexp_matches(trim(text), '(?i)^(page\s+)?[0-9]+(\s+of\s+[0-9]+)?$') OR (length(text) <= 60 AND regexp_matches(text, '(?i)\(?\bcont(inued|''?d)?\b\.?\)?')) is_furniture FROM e""",
    "bbox_normalize": f"""WITH {E}, k AS (SELECT doc_id, idx, least(greatest(x0 / 612.0::DOUBLE * 1000, 0), 1000) k0, least(greatest(y0 / 792.0::DOUBLE * 1000, 0), 1000) k1, least(greatest(x1 / 612.0::DOUBLE * 1000, 0), 1000) k2, least(greatest(y1 / 792.0::DOUBLE * 1000, 0), 1000) k3 FROM e)
      SELECT *, least(k0, k2) * 612.0::DOUBLE / 1000 p0, least(k1, k3) * 792.0::DOUBLE / 1000 p1, greatest(k0, k2) * 612.0::DOUBLE / 1000 p2, greatest(k1, k3) * 792.0::DOUBLE / 1000 p3 FROM k""",
    "layout_prefix": rf"""WITH {E}, k AS (SELECT *, least(greatest(x0 / 612.0::DOUBLE * 1000, 0), 1000) k0, least(greatest(y0 / 792.0::DOUBLE * 1000, 0), 1000) k1, least(greatest(x1 / 612.0::DOUBLE * 1000, 0), 1000) k2, least(greatest(y1 / 792.0::DOUBLE * 1000, 0), 1000) k3 FROM e)
      SELECT doc_id, idx, CASE WHEN regexp_matches(text, '^[0-9]+(\.[0-9]+)*[.)]?\s+\S') THEN '[SECTION] ' ELSE '' END || '(' || trunc((k0 + k2) / 2 / 10)::INT || '%,' || trunc((k1 + k3) / 2 / 10)::INT || '%) ' || text rendered FROM k""",
    "fixed_partitions": f"WITH {E}, r AS (SELECT doc_id, page_no, ((row_number() OVER (PARTITION BY doc_id, page_no ORDER BY idx) - 1) // 7)::INT call_no FROM e) SELECT doc_id, page_no, call_no, count(*) n FROM r GROUP BY ALL",
    "design_sample": f"""WITH {E}, s AS (SELECT doc_id, idx, sum(length(text)) OVER (PARTITION BY doc_id) c, count(*) OVER (PARTITION BY doc_id) n, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, idx) - 1 i FROM e),
      t AS (SELECT *, greatest(1, floor(n * 2000::DOUBLE / greatest(c, 1)))::INT k FROM s)
      SELECT doc_id, idx FROM t WHERE c <= 2000 OR list_contains(list_transform(range(k), lambda j: floor(j * n / k::DOUBLE)::BIGINT), i)""",
}
