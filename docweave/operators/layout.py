"""Reading order, page statistics and boundaries of page elements. Inputs as in plans.elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _page():
    return Window.partitionBy("doc_id", "page_no").orderBy("idx")


def _doc():
    return Window.partitionBy("doc_id").orderBy("page_no", "idx")


# Shapes of headings, list items, captions and page furniture.
NUMBERED = r"^[0-9]+(\.[0-9]+)*[.)]?\s+\S"
LIST_ITEM = r"^([-•*‣▪]|[0-9]{1,3}[.)]|[a-z][.)])\s+\S"
CAPTION = r"(?i)^(figure|fig\.?|table|chart|exhibit)\s*[0-9]"
CONTINUED = r"(?i)\(?\bcont(inued|'?d)?\b\.?\)?"
HEADING_CHARS, HEADING_RATIO, SINGLE_LINE_RATIO = 80, 1.15, 1.8
CAPTION_CHARS, CAPTION_GAP, CAPTION_OVERLAP, LIST_ALIGN = 200, 24.0, 0.5, 12.0
GAP_RATIO, GAP_LEAST = 2.0, 12.0
FURNITURE_BAND, MARKER_CHARS = 0.07, 60


def reading_order(e: DataFrame) -> DataFrame:
    """Elements with their place in the document, from 1."""
    return e.withColumn("place", F.row_number().over(_doc()))


def document_content(e: DataFrame) -> DataFrame:
    """Non-empty texts of each document in reading order, joined by blank lines, and its elements."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page_no", "idx", "text"))))
    return e.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("content"), F.count("*").alias("n_elements"))


def bucket(n) -> F.Column:
    """The size class of a count of chunks."""
    return F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").when(n <= 1000, "101-1000").otherwise(">1000")


def page_shape(e: DataFrame) -> DataFrame:
    """Per document: pages, pages with tables and with figures, pages without text, and the fullest page's size class."""
    pages = e.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.max((F.col("chunk_type") == "table").cast("int")).alias("t"), F.max((F.col("chunk_type") == "image").cast("int")).alias("i"), F.max((F.col("text") != "").cast("int")).alias("x"))
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("page_count"), F.sum("t").alias("table_pages"), F.sum("i").alias("image_pages"), F.count_if(F.col("x") == 0).alias("empty_pages"), bucket(F.max("n")).alias("max_bucket"))


def with_gaps(e: DataFrame) -> DataFrame:
    """gap: from the element before on the same page."""
    return e.withColumn("gap", F.col("y0") - F.lag("y1").over(_page()))


def _measured(e: DataFrame) -> DataFrame:
    return with_gaps(e).withColumn("h", F.when((F.col("chunk_type") == "text") & (F.col("text") != ""), (F.col("y1") - F.col("y0")) / F.size(F.split("text", "\n"))))


def _positive_median(c: str) -> F.Column:
    return F.median(F.when(F.col(c) > 0, F.col(c)))


def page_stats(e: DataFrame) -> DataFrame:
    """Per page the medians of text line height and of positive gaps."""
    return _measured(e).groupBy("doc_id", "page_no").agg(_positive_median("h").alias("line_h_median"), _positive_median("gap").alias("gap_median"))


def with_page_stats(e: DataFrame) -> DataFrame:
    """Elements with their gap and their page's medians: one shuffle by page, no join."""
    page = Window.partitionBy("doc_id", "page_no")
    return _measured(e).withColumn("line_h_median", _positive_median("h").over(page)).withColumn("gap_median", _positive_median("gap").over(page)).drop("h")


def upper_median(x) -> F.Column:
    """The middle value; of two middle ones the upper."""
    s = F.array_sort(F.collect_list(x))
    return F.try_element_at(s, (F.size(s) / 2).cast("int") + 1)


def typography(e: DataFrame) -> DataFrame:
    """Upper medians of a document's line height and width per character."""
    t = e.where("chunk_type = 'text' and text <> ''")
    return t.groupBy("doc_id").agg(upper_median(F.col("y1") - F.col("y0")).alias("line_h_upper_median"), upper_median((F.col("x1") - F.col("x0")) / F.length("text")).alias("char_w_upper_median"))


def heading_strength(e: DataFrame) -> DataFrame:
    """strength: strong, weak or null. Tests in order: text, one short line, no closing mark, a letter,
    not one of two aligned list items, not too tall; then numbering or height, then capitals."""
    return with_strength(e).select("doc_id", "idx", "strength")


def with_strength(e: DataFrame) -> DataFrame:
    """Elements with page medians and strength."""
    joined = with_page_stats(e)
    h = F.col("y1") - F.col("y0")
    text = F.trim("text")
    item = text.rlike(LIST_ITEM) & (F.col("chunk_type") == "text")
    marked = joined.withColumn("_item", item).withColumn("_next", F.lead("_item").over(_page())).withColumn("_x", F.lead("x0").over(_page()))
    listed = F.col("_item") & F.coalesce(F.col("_next"), F.lit(False)) & (F.abs(F.col("x0") - F.col("_x")) <= LIST_ALIGN)
    tall = F.coalesce(h > SINGLE_LINE_RATIO * F.col("line_h_median"), F.lit(False))
    may = (F.col("chunk_type") == "text") & F.length(text).between(1, HEADING_CHARS) & ~text.rlike(r"[.,]$") & text.rlike(r"\p{L}") & ~listed & ~tall
    strong = text.rlike(NUMBERED) | F.coalesce(h >= HEADING_RATIO * F.col("line_h_median"), F.lit(False))
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(F.regexp_replace(w, r"\P{L}", "")) >= 2)
    capitals = (F.size(words) >= 2) & (F.upper(text) == text)
    return marked.withColumn("strength", F.when(may & strong, "strong").when(may & capitals, "weak")).drop("_item", "_next", "_x")


def caption_pairs(e: DataFrame) -> DataFrame:
    """A figure and the text right below it that is short, near, and overlaps it or reads like a caption."""
    n = {c: F.lead(c).over(_page()) for c in ("idx", "chunk_type", "text", "x0", "x1", "y0")}
    w = e.select("*", *(v.alias(f"n_{k}") for k, v in n.items()))
    overlap = (F.least("x1", "n_x1") - F.greatest("x0", "n_x0")) / F.greatest(F.least(F.col("x1") - F.col("x0"), F.col("n_x1") - F.col("n_x0")), F.lit(1e-9))
    fits = (F.col("chunk_type") == "image") & (F.col("n_chunk_type") == "text") & F.length("n_text").between(1, CAPTION_CHARS) & (F.col("n_y0") - F.col("y1") <= CAPTION_GAP) & ((overlap >= CAPTION_OVERLAP) | F.col("n_text").rlike(CAPTION))
    return w.where(fits).select("doc_id", F.col("idx").alias("fig_idx"), F.col("n_idx").alias("text_idx"))


def boundaries(e: DataFrame) -> DataFrame:
    """Where the stream of elements is cut: page, heading, heading_weak or gap; and the group of each element."""
    g = with_strength(e)
    before = F.lag("page_no").over(_doc())
    wide = F.col("gap") >= F.greatest(GAP_RATIO * F.coalesce(F.col("gap_median"), F.lit(0.0)), F.lit(GAP_LEAST))
    kind = F.when(before.isNull(), None).when(before != F.col("page_no"), "page").when(F.col("strength") == "strong", "heading").when(F.col("strength") == "weak", "heading_weak").when(wide, "gap")
    cut = g.withColumn("boundary", kind)
    return cut.select("doc_id", "idx", "boundary", F.sum(F.col("boundary").isNotNull().cast("int")).over(_doc()).alias("group_no"))


def furniture(e: DataFrame, height: float = 792.0) -> DataFrame:
    """is_furniture: in the outer bands of the page, a page number, or a short continuation marker."""
    center = (F.col("y0") + F.col("y1")) / 2
    number = F.trim("text").rlike(r"(?i)^(page\s+)?[0-9]+(\s+of\s+[0-9]+)?$")
    marker = (F.length("text") <= MARKER_CHARS) & F.col("text").rlike(CONTINUED)
    return e.select("doc_id", "idx", ((center < FURNITURE_BAND * height) | (center > (1 - FURNITURE_BAND) * height) | number | marker).alias("is_furniture"))


def normalize_boxes(e: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """k0..k3: the box in thousandths of the page, clipped; p0..p3: these scaled back to points, edges in order."""
    def k(c, size):
        return F.least(F.greatest(F.col(c) / size * 1000, F.lit(0.0)), F.lit(1000.0))

    scaled = e.select("*", *(k(c, s).alias(f"k{i}") for i, (c, s) in enumerate((("x0", width), ("y0", height), ("x1", width), ("y1", height)))))
    points = (F.least("k0", "k2") * width / 1000, F.least("k1", "k3") * height / 1000, F.greatest("k0", "k2") * width / 1000, F.greatest("k1", "k3") * height / 1000)
    return scaled.select("*", *(p.alias(f"p{i}") for i, p in enumerate(points)))


def layout_prefix(e: DataFrame) -> DataFrame:
    """Each element's text behind its place on the page in per cent, sections marked."""
    joined = normalize_boxes(e)
    place = F.concat(F.lit("("), ((F.col("k0") + F.col("k2")) / 2 / 10).cast("int").cast("string"), F.lit("%,"), ((F.col("k1") + F.col("k3")) / 2 / 10).cast("int").cast("string"), F.lit("%) "))
    section = F.when(F.col("text").rlike(NUMBERED), "[SECTION] ").otherwise("")
    return joined.select("doc_id", "idx", F.concat(section, place, F.col("text")).alias("rendered"))


def fixed_partitions(e: DataFrame, n: int = 7) -> DataFrame:
    """Elements of a page in calls of n."""
    at = F.row_number().over(_page()) - 1
    return e.withColumn("call_no", F.floor(at / n).cast("int")).groupBy("doc_id", "page_no", "call_no").agg(F.count("*").alias("n"))


def design_sample(e: DataFrame, budget: int = 2000) -> DataFrame:
    """All elements of a document within the budget of characters, else an even stride over them."""
    sized = e.withColumn("_c", F.sum(F.length("text")).over(Window.partitionBy("doc_id"))).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("_i", F.row_number().over(_doc()) - 1)
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * budget / F.greatest(F.col("_c"), F.lit(1)))).cast("int")
    taken = sized.withColumn("_k", keep)
    # element i is drawn if it is floor(j * n / k) for some j below k
    j = F.ceil(F.col("_i") * F.col("_k") / F.col("_n"))
    drawn = (j < F.col("_k")) & (F.floor(j * F.col("_n") / F.col("_k")) == F.col("_i"))
    return taken.where((F.col("_c") <= budget) | drawn).select("doc_id", "idx")
