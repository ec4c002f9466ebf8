"""Boxes on pages: how they overlap, whether they lie in the body, clipping, rotation, and fragments of words.

Boxes are columns x0, y0, x1, y1 in points, y downward; a null corner makes what is made of it null.
"""

from __future__ import annotations

from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.grouped import per_key, records

# Margins of the body, a figure that is the page, ligatures, and how near fragments of a word are.
BODY_SHARE, BODY_LEAST, BODY_MOST, WHOLE_PAGE = 0.08, 24.0, 72.0, 0.90
LIGATURES, JOINERS = "ﬀﬁﬂﬃﬄﬅﬆ", "-_/"
LINE_OVERLAP, GAP_BACK, GAP_POINTS, GAP_SHARE = 0.6, -0.5, 1.5, 0.08

CORNERS = ("x0", "y0", "x1", "y1")


def corners(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in CORNERS]


def area(box: list[Column]) -> Column:
    """0 for an empty box."""
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def clipped(box: list[Column], width: Column, height: Column) -> list[Column]:
    """The part on the page; all null if there is none."""
    x0, y0, x1, y1 = F.greatest(box[0], F.lit(0.0)), F.greatest(box[1], F.lit(0.0)), F.least(box[2], width), F.least(box[3], height)
    there = (x1 > x0) & (y1 > y0) & box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    return [F.when(there, c) for c in (x0, y0, x1, y1)]


def intersection_share(a: list[Column], b: list[Column]) -> Column:
    """The share of a that b covers; 0 if a is empty."""
    common = area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])
    return F.when(area(a) > 0, common / area(a)).otherwise(0.0)


def in_body(box: list[Column], height: Column) -> Column:
    """Both edges inside the margins at the top and bottom of the page."""
    margin = F.least(F.greatest(height * BODY_SHARE, F.lit(BODY_LEAST)), F.lit(BODY_MOST))
    return (area(box) > 0) & (box[1] >= margin) & (box[3] <= height - margin)


def in_page_space(box: list[Column], rotation: Column, width: Column, height: Column) -> list[Column]:
    """A box that may be given before the page was turned (by 90, 180 or 270 degrees): as it is, or turned if
    less of it then lies off the page, whose size is that of the turned page."""
    x0, y0, x1, y1 = box
    turned = {90: (width - y1, x0, width - y0, x1), 180: (width - x1, height - y1, width - x0, height - y0), 270: (y0, height - x1, y1, height - x0)}
    out = list(box)
    for angle, other in turned.items():
        off = [area(list(b)) - area([F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0)), F.least(b[2], width), F.least(b[3], height)]) for b in (box, other)]
        out = [F.when((rotation == angle) & (off[1] < off[0]), n).otherwise(o) for n, o in zip(other, out, strict=True)]
    return out


def centre_inside_any(children: DataFrame, parents: DataFrame, *key: str, child: str = "child_id") -> DataFrame:
    """children (told apart by `child` within a key) with `inside`: whether the centre lies in some parent of the same key."""
    held = parents.select(*key, *(F.col(c).alias(f"p_{c}") for c in CORNERS))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = children.join(held, list(key)).where(cx.between(F.col("p_x0"), F.col("p_x1")) & cy.between(F.col("p_y0"), F.col("p_y1")))
    found = hit.select(*key, child).distinct().withColumn("_in", F.lit(True))
    return children.join(found, [*key, child], "left").select(*children.columns, F.coalesce("_in", F.lit(False)).alias("inside"))


def claimed_boxes(e: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Boxes that a read claims to cover: all with finite corners but figures of nearly the whole page."""
    finite = None
    for c in CORNERS:
        good = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        finite = good if finite is None else finite & good
    whole = (F.col("chunk_type") == "image") & (area(corners()) >= WHOLE_PAGE * width * height)
    return e.where(finite & ~whole)


def page_dimensions(sizes: DataFrame) -> DataFrame:
    """doc_id and sizes (array of width, height): one row per page, numbered from 1."""
    pages = sizes.select("doc_id", F.posexplode("sizes").alias("n", "s"))
    return pages.select("doc_id", (F.col("n") + 1).alias("page_no"), F.col("s")["width"].alias("width"), F.col("s")["height"].alias("height"))


def least_confidence(a: Column, b: Column) -> Column:
    """Of two; the only one if the other is null."""
    return F.least(a, b)


def tight(a: dict, b: dict) -> bool:
    """On one line, with hardly any gap."""
    heights = [x["y1"] - x["y0"] for x in (a, b)]
    if min(heights) <= 0 or any(x["x1"] <= x["x0"] for x in (a, b)):
        return False
    height = max(min(heights), 1.0)
    overlap = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    return overlap / height >= LINE_OVERLAP and GAP_BACK <= b["x0"] - a["x1"] <= min(GAP_POINTS, GAP_SHARE * height)


def within_word(left: str, right: str) -> bool:
    """Whether two characters, a ligature among them, can stand next to each other in a word."""
    if left.isspace() or right.isspace() or not {left, right} & set(LIGATURES):
        return False
    return (left.isalnum() and (right.isalnum() or right in JOINERS)) or (left in JOINERS and right.isalnum())


def _mergeable(a: dict, b: dict, tail: bool) -> bool:
    texts = (a["text"], b["text"])
    # most pairs have no ligature, so that is asked first
    if not all(texts) or not (texts[0][-1] in LIGATURES if tail else texts[0] in LIGATURES or texts[1] in LIGATURES):
        return False
    if a["chunk_type"] != "text" or b["chunk_type"] != "text" or a["page_no"] != b["page_no"] or any(x[c] is None for x in (a, b) for c in CORNERS):
        return False
    return within_word(texts[0][-1], texts[1][0]) and tight(a, b)


def _whole(a: dict, b: dict) -> dict:
    known = [x["confidence"] for x in (a, b) if x["confidence"] is not None]
    box = {c: f(a[c], b[c]) for c, f in zip(CORNERS, (min, min, max, max), strict=True)}
    return a | box | {"text": a["text"] + b["text"], "confidence": min(known, default=None)}


def joined_fragments(elements: list[dict]) -> list[dict]:
    """Elements in order with words put together that a ligature had broken: a pair, and what follows if the pair ends in the ligature."""
    out, at = [], 0
    while at < len(elements):
        now, at = elements[at], at + 1
        if at < len(elements) and _mergeable(now, elements[at], False):
            now, at = _whole(now, elements[at]), at + 1
            if at < len(elements) and _mergeable(now, elements[at], True):
                now, at = _whole(now, elements[at]), at + 1
        out.append(now)
    return out


FRAGMENTS = "doc_id long, page_no int, idx int, chunk_type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def merge_fragments(e: DataFrame) -> DataFrame:
    """Elements of each document with broken words joined; ligatures are written out by functions.text."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 5)
    names = [x.split()[0] for x in FRAGMENTS.split(", ")]
    shape = pa.schema(list(zip(names, kinds, strict=True)))

    def join(table: pa.Table, bounds: list[int]):
        rows = records(table)
        for a, b in zip(bounds, bounds[1:]):
            yield from (tuple(x.values()) for x in joined_fragments(sorted(rows[a:b], key=itemgetter("page_no", "idx"))))

    found = e if "confidence" in e.columns else e.withColumn("confidence", F.lit(None).cast("double"))
    return per_key(found.select(*names), join, shape, FRAGMENTS)
