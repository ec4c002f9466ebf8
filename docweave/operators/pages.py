"""Page-quality gates: each is a predicate over one page's row, and a CASE puts them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The gates' thresholds.
BLANK_RUN, BODY_CHARS, TEXT_CHARS, IMAGE_RATIO, GLYPHLESS, CORRUPT = 18, 40, 80, 0.25, 0.60, 0.30
TRUST_IMAGE, UNCOVERED, BAND, GRID = 0.75, 0.40, 0.5, 48


def unusable_reason(error: Column, truncated: Column, empty: Column, repeated: Column, script: Column) -> Column:
    """Why a read can't be used; the first that holds."""
    return F.when(error, "exception").when(truncated, "truncated").when(empty, "empty").when(repeated, "repeated_ngram").when(script, "low_quality_script")


def max_blank_row_run(lines: DataFrame) -> DataFrame:
    """lines: (doc_id, idx, line). The longest run of grid rows without content. Empty lines don't end a
    run; other lines and rows with content do."""
    cells = F.regexp_replace("line", r"[|\s]", "")
    kind = lines.where(F.trim("line") != "").withColumn("blank", F.col("line").contains("|") & (cells == ""))
    w = Window.partitionBy("doc_id").orderBy("idx")
    runs = kind.withColumn("g", F.sum((~F.col("blank")).cast("int")).over(w)).where("blank").groupBy("doc_id", "g").agg(F.count("*").alias("n"))
    return lines.select("doc_id").distinct().join(runs.groupBy("doc_id").agg(F.max("n").cast("int").alias("max_run")), "doc_id", "left").fillna(0, ["max_run"])


def grid_width(lines: DataFrame) -> DataFrame:
    """The widest row of pipes that occurs twice or more, and the rows with content."""
    rows = lines.where(F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) >= 2).withColumn("width", F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) - 1).withColumn("full", F.regexp_replace("line", r"[|\s]", "") != "")
    by = rows.groupBy("doc_id", "width").agg(F.count("*").alias("n"), F.count_if("full").alias("f"))
    return by.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("width"))), F.lit(0)).alias("width"), F.sum("f").alias("content_rows"))


def ends_in_blank_cells(x: Column, least: int = 12) -> Column:
    """The tail, less closing JSON signs, is a run of blank cells."""
    return F.regexp_replace(x, r'["\]}\s]+$', "").rlike(rf"(\|[ \t]*){{{least},}}$")


def native_text_signals(s: DataFrame) -> DataFrame:
    """s: text_chars, body_text_chars, chars_seen, replacement_chars, glyphless_font_chars, image_area, page_area."""
    image = F.col("image_area") / F.col("page_area")
    reliable = (F.col("body_text_chars") >= BODY_CHARS) | ((F.col("text_chars") >= TEXT_CHARS) & (image < IMAGE_RATIO))
    layer = (F.col("text_chars") >= BODY_CHARS) & (F.col("glyphless_font_chars") >= GLYPHLESS * F.col("text_chars"))
    corrupt = (F.col("chars_seen") > 0) & (F.col("replacement_chars") >= CORRUPT * F.col("chars_seen"))
    return s.withColumn("reliable", reliable).withColumn("ocr_layer", layer).withColumn("corrupt", corrupt).withColumn("trusted", reliable & ~layer & ~corrupt & (image <= TRUST_IMAGE)).withColumn("needs_ocr", F.when(F.col("corrupt"), True).when(F.col("ocr_layer"), False).otherwise(~F.col("reliable")))


#: Cells of a row that one number holds as bits.
WORD = 60


def row_bits(boxes: DataFrame, name: str, wider: int = 0) -> DataFrame:
    """boxes: (page_id, gx0, gy0, gx1, gy1) in cells, as rows (page_id, gy, word) with the bits of the cells between; no cell is a row."""
    word = lambda c: F.floor(c / WORD).cast("long")
    x0, x1 = F.col("gx0") - wider, F.col("gx1") + wider
    # sequence() would go down if a box ended before it began, and take both its ends
    rows = boxes.where("gx0 is not null and gx1 is not null").select("page_id", F.least(x0, x1).alias("a"), F.greatest(x0, x1).alias("b"), F.explode(F.sequence(F.col("gy0") - wider, F.col("gy1") + wider)).alias("gy"))
    rows = rows.select("page_id", "gy", "a", "b", F.explode(F.sequence(word(F.col("a")), word(F.col("b")))).alias("word"))
    low, high = F.greatest(F.col("a") - F.col("word") * WORD, F.lit(0)), F.least(F.col("b") - F.col("word") * WORD, F.lit(WORD - 1))
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1
    return rows.select("page_id", "gy", "word", (ones(high + 1) - ones(low)).alias(name))


def box_coverage(ink: DataFrame, boxes: DataFrame) -> DataFrame:
    """coverage() of ink that is given as boxes of cells too."""
    none = F.lit(0).cast("long")
    both = row_bits(ink, "i").withColumn("c", none).unionByName(row_bits(boxes.where("page_id is not null"), "c", 1).withColumn("i", none))
    words = both.groupBy("page_id", "gy", "word").agg(F.bit_or("i").alias("i"), F.bit_or("c").alias("c")).where("i <> 0")
    rows = words.groupBy("page_id", "gy").agg(F.sum(F.bit_count("i")).alias("i"), F.sum(F.bit_count(F.col("i").bitwiseAND(F.bitwise_not("c")))).alias("u"))
    return _bands(rows)


def coverage(ink: DataFrame, boxes: DataFrame) -> DataFrame:
    """ink: (page_id, gx, gy) inky cells; boxes: (page_id, gx0, gy0, gx1, gy1) in cells. The uncovered
    share of inky cells, the densest four rows of them, and the same over the densest four inky rows.
    Boxes are widened by a cell."""
    cells = boxes.select("page_id", F.explode(F.sequence(F.col("gx0") - 1, F.col("gx1") + 1)).alias("gx"), "gy0", "gy1").select("page_id", "gx", F.explode(F.sequence(F.col("gy0") - 1, F.col("gy1") + 1)).alias("gy")).distinct()
    open_ = ink.join(cells.withColumn("c", F.lit(1)), ["page_id", "gx", "gy"], "left")
    rows = open_.groupBy("page_id", "gy").agg(F.count("*").alias("i"), F.count_if(F.col("c").isNull()).alias("u"))
    return _bands(rows)


def _bands(rows: DataFrame) -> DataFrame:
    """rows: (page_id, gy, i, u), of each row of cells the inky ones and the uncovered ones among them."""
    w = Window.partitionBy("page_id").orderBy("gy").rangeBetween(-3, 0)
    bands = rows.withColumn("bi", F.sum("i").over(w)).withColumn("bu", F.sum("u").over(w))
    return bands.groupBy("page_id").agg((F.sum("u") / F.sum("i")).alias("uncovered_fraction"), F.max("bu").alias("band"), (F.max("bu") / F.max("bi")).alias("band_frac"))


def low_coverage(x: DataFrame) -> DataFrame:
    return x.withColumn("low", (F.col("uncovered_fraction") > UNCOVERED) & (F.col("band_frac") >= BAND))


def image_reason(w: Column, h: Column, size: Column, page_w: Column, page_h: Column) -> Column:
    """Why an image is not worth keeping, null if it is."""
    return (
        F.when((w < 30) | (h < 30), "too_small").when(w * h < 5000, "small_area").when(size < 300, "small_file")
        .when(F.greatest(w, h) > 20.0 * F.least(w, h), "aspect_ratio").when(w * h < 0.005 * page_w * page_h, "page_coverage")
    )


def consistency_risk(from_retry: Column, empty_run: Column, tokens: Column, cap: int = 8192) -> Column:
    return F.when(from_retry, "retry").when(empty_run >= 8, "empty_run").when(tokens >= 0.85 * cap, "near_cap")


def reread(confidence: Column, parsed: Column, reads: Column, gate: float = 0.8) -> Column:
    """trusted, confirmed or flagged; reads are compared by their letters and digits."""
    norm = lambda x: F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    usable = F.filter(reads, lambda r: r.isNotNull() & (norm(r) != ""))
    return F.when(confidence.isNull() | (confidence >= gate), "trusted").when(F.size(usable) == 0, "flagged").when(F.forall(usable, lambda r: norm(r) == norm(parsed)), "confirmed").otherwise("flagged")


def raster_zoom(w: Column, h: Column, dpi: float = 150.0, most: float = 2e6) -> Column:
    """The zoom of a page in points: dpi / 72, shrunk up to four times until its pixels fit."""
    pixels = lambda z: F.ceil(w * z) * F.ceil(h * z)
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(dpi / 72), lambda z, _: F.when(pixels(z) > most, z * F.sqrt(most / pixels(z)) * 0.999).otherwise(z))
