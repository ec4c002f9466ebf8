"""Boxes, labels and whole documents through segmentation and assembly, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import geometry as G
from docweave.operators import stitching as T
from docweave.plans.elements import SQL as E
from docweave.plans.elements import elements


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _e(s, d):
    return elements(_t(s, d, "documents").select("doc_id", "text"))


def body_boxes(s, d):
    return _e(s, d).select("doc_id", "idx", G.in_body(G.corners(), F.lit(792.0)).alias("in_body"))


def clipped_boxes(s, d):
    e = _e(s, d).withColumn("y0", F.expr("y0 - 100")).withColumn("y1", F.expr("if(idx % 5 = 0, y1 + 700, y1 - 100)"))
    return e.select("doc_id", "idx", *(c.alias(n) for c, n in zip(G.clipped(G.corners(), F.lit(300.0), F.lit(500.0)), G.CORNERS, strict=True)))


def box_shares(s, d):
    other = [F.expr(x) for x in ("x0 + idx % 50", "y0 - idx % 9", "x1 + 20", "y1 - idx % 7")]
    return _e(s, d).select("doc_id", "idx", F.round(G.intersection_share(G.corners(), other), 9).alias("share"))


def claimed_boxes(s, d):
    e = _e(s, d).withColumn("x0", F.expr("case when idx % 11 = 0 then double('NaN') when idx % 13 = 0 then double('Infinity') when idx % 24 = 0 then 0D else x0 end"))
    e = e.withColumn("y1", F.expr("if(idx % 24 = 0, 792D, y1)")).withColumn("y0", F.expr("if(idx % 24 = 0, 0D, y0)")).withColumn("x1", F.expr("if(idx % 24 = 0, 612D, x1)"))
    return G.claimed_boxes(e).select("doc_id", "idx")


def inside_figures(s, d):
    e = _e(s, d)
    figures = e.where("chunk_type = 'image'").withColumn("y1", F.expr("y1 + 60"))
    return G.centre_inside_any(e.withColumnRenamed("idx", "child_id"), figures, "doc_id", "page_no").select("doc_id", "child_id", "inside")


def turned_boxes(s, d):
    e = _e(s, d).withColumn("turn", F.expr("90 * (idx % 4)"))
    box = G.in_page_space(G.corners(), F.col("turn"), F.lit(792.0), F.lit(612.0))
    return e.select("doc_id", "idx", *(c.alias(n) for c, n in zip(box, G.CORNERS, strict=True)))


def page_sizes(s, d):
    x = _t(s, d, "documents").selectExpr("doc_id", "transform(sequence(1, cast(doc_id % 4 + 1 as int)), i -> named_struct('width', 600D + i, 'height', 800D - i)) sizes")
    return G.page_dimensions(x)


def word_fragments(s, d):
    e = _e(s, d).withColumn("text", F.expr("if(idx % 24 = 7, 'ﬁ', text)")).withColumn("x1", F.expr("x0 + 10")).withColumn("y0", F.lit(100.0)).withColumn("y1", F.lit(112.0)).withColumn("x0", F.expr("x0 + 10 * (idx % 40)")).withColumn("x1", F.expr("x0 + 10"))
    return G.merge_fragments(e).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def label_flags(s, d):
    t = F.trim("text")
    e = _e(s, d)
    return e.select("doc_id", "idx", ((F.col("chunk_type") == "text") & F.length(t).between(1, 40) & ~t.contains("\n") & t.endswith(":") & t.rlike(r"\p{L}")).alias("is_label"))


def _fragments(s, d):
    """Order lines as tables of two columns: each line is the last thing of a page, and its order goes on over pages."""
    n = "row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice)"
    x = _t(s, d, "lineitem").selectExpr("l_orderkey doc_id", f"{n} page_no", "0 idx", "'table' chunk_type", "concat('| line | quantity |\n| --- | --- |\n| ', l_linestatus, ' | ', l_quantity, ' |') text", "50D x0", "30D y0", "if(l_linenumber % 5 = 0, 500D, 550D) x1", "if(l_linenumber % 3 = 0, 400D, 780D) y1", "l_quantity q", "l_linestatus st")
    cell = lambda text, r, c: f"named_struct('text', {text}, 'row', {r}, 'col', {c}, 'row_span', 1, 'col_span', 1, 'page_no', cast(null as int))"
    cells = ", ".join((cell("'line'", 0, 0), cell("'quantity'", 0, 1), cell("concat(st, page_no)", 1, 0), cell("cast(q as string)", 1, 1)))
    return x.withColumn("cells", F.expr(f"array({cells})"))


def table_boundaries(s, d):
    return T.boundary_decisions(_fragments(s, d))


def table_counters(s, d):
    return T.decision_counters(T.boundary_decisions(_fragments(s, d)))


def assembled_tables(s, d):
    return T.assembled(_fragments(s, d)).select("doc_id", "page_no", F.size("pages").alias("pages"), F.size(F.split("text", "\n")).alias("lines"))


QUERIES = {f.__name__: f for f in (body_boxes, clipped_boxes, box_shares, claimed_boxes, inside_figures, turned_boxes, page_sizes, word_fragments, label_flags, table_boundaries, table_counters, assembled_tables)}

# order lines: a table goes on if it ends low on its page and both are as wide; from the last page back, so that
# what a table's foot is depends on its own page alone
_L = "l AS (SELECT l_orderkey doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice))::INT page_no, l_linenumber % 3 <> 0 low, l_linenumber % 5 <> 0 wide FROM lineitem), b AS (SELECT a.doc_id, a.page_no, a.low candidate, CASE WHEN NOT a.low THEN 'geometry' WHEN a.wide <> b.wide THEN 'width_ratio' END rejection FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1)"
ORACLE_SQL = {
    "body_boxes": f"WITH {E} SELECT doc_id, idx, x1 > x0 AND y1 > y0 AND y0 >= 63.36 AND y1 <= 728.64 in_body FROM e",
    "clipped_boxes": f"WITH {E}, c AS (SELECT doc_id, idx, greatest(x0, 0) a, greatest(y0 - 100, 0) b, least(x1, 300) c, least(CASE WHEN idx % 5 = 0 THEN y1 + 700 ELSE y1 - 100 END, 500) d FROM e) SELECT doc_id, idx, CASE WHEN c > a AND d > b THEN a END x0, CASE WHEN c > a AND d > b THEN b END y0, CASE WHEN c > a AND d > b THEN c END x1, CASE WHEN c > a AND d > b THEN d END y1 FROM c",
    "box_shares": f"WITH {E}, c AS (SELECT doc_id, idx, (x1 - x0) * (y1 - y0) a, greatest(x1 - (x0 + idx % 50), 0) * greatest(least(y1, y1 - idx % 7) - y0, 0) c FROM e) SELECT doc_id, idx, CASE WHEN a > 0 THEN round(c / a, 9) ELSE 0 END AS share FROM c",
    "claimed_boxes": f"WITH {E} SELECT doc_id, idx FROM e WHERE idx % 11 <> 0 AND idx % 13 <> 0 AND NOT (idx % 24 = 0 AND chunk_type = 'image')",
    "inside_figures": f"WITH {E} SELECT doc_id, idx child_id, EXISTS (SELECT 1 FROM e f WHERE f.chunk_type = 'image' AND f.doc_id = e.doc_id AND f.page_no = e.page_no AND (e.x0 + e.x1) / 2 BETWEEN f.x0 AND f.x1 AND (e.y0 + e.y1) / 2 BETWEEN f.y0 AND f.y1 + 60) inside FROM e",
    "turned_boxes": f"WITH {E}, t AS (SELECT *, CASE idx % 4 WHEN 1 THEN [792 - y1, x0, 792 - y0, x1] WHEN 2 THEN [792 - x1, 612 - y1, 792 - x0, 612 - y0] WHEN 3 THEN [y0, 612 - x1, y1, 612 - x0] ELSE [x0, y0, x1, y1] END n FROM e), o AS (SELECT *, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) - greatest(least(x1, 792) - greatest(x0, 0), 0) * greatest(least(y1, 612) - greatest(y0, 0), 0) was, greatest(n[3] - n[1], 0) * greatest(n[4] - n[2], 0) - greatest(least(n[3], 792) - greatest(n[1], 0), 0) * greatest(least(n[4], 612) - greatest(n[2], 0), 0) now FROM t) SELECT doc_id, idx, CASE WHEN now < was THEN n[1] ELSE x0 END x0, CASE WHEN now < was THEN n[2] ELSE y0 END y0, CASE WHEN now < was THEN n[3] ELSE x1 END x1, CASE WHEN now < was THEN n[4] ELSE y1 END y1 FROM o",
    "page_sizes": "SELECT doc_id, unnest(range(1, doc_id % 4 + 2))::INT page_no, (600 + unnest(range(1, doc_id % 4 + 2)))::DOUBLE width, (800 - unnest(range(1, doc_id % 4 + 2)))::DOUBLE height FROM documents",
    "label_flags": f"WITH {E} SELECT doc_id, idx, chunk_type = 'text' AND length(trim(text)) BETWEEN 1 AND 40 AND NOT contains(trim(text), chr(10)) AND ends_with(trim(text), ':') AND regexp_matches(text, '\\pL') is_label FROM e",
    "table_boundaries": f"WITH {_L} SELECT doc_id, page_no, candidate, rejection, 1 headers FROM b",
    "table_counters": f"WITH {_L} SELECT doc_id, count(*) FILTER (candidate) candidates, count(*) FILTER (rejection IS NULL) merged, count(*) FILTER (candidate AND rejection IS NOT NULL) rejected FROM b GROUP BY doc_id",
    "assembled_tables": f"WITH {_L}, s AS (SELECT l.doc_id, l.page_no, CASE WHEN b.page_no IS NULL OR b.rejection IS NOT NULL THEN 1 ELSE 0 END first FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.page_no = l.page_no - 1), g AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY page_no) g FROM s) SELECT doc_id, min(page_no) page_no, count(*)::INT pages, (count(*) + 2)::INT AS lines FROM g GROUP BY doc_id, g",
}
