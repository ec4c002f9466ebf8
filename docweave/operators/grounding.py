"""Whether a value stands in its source: anchors tried in order, exemptions, and confidence.

leaves: leaf_id, doc_id, value, quote, cited array<int>; chunks: doc_id, idx, text. Texts are compared
with white space collapsed and case ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ladder's limits.
CONTAINED, LONG_PROSE, SUPPORT, SUPPORTS, SHOWN = 8, 80, 25, 16, 300


def norm(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def separator_tolerant(x: Column) -> Column:
    """A pattern for the value's letters and digits with up to two signs inside and eight between its words."""
    words = F.filter(F.split(norm(x), r"[^a-z0-9]+"), lambda w: w != "")
    inside = F.transform(words, lambda w: F.array_join(F.filter(F.split(w, ""), lambda c: c != ""), "[^a-z0-9]{0,2}"))
    return F.concat(F.lit("(?<![a-z0-9])"), F.array_join(inside, "[^a-z0-9]{0,8}"), F.lit("(?![a-z0-9])"))


def checkbox_polarity(x: Column) -> Column:
    """True or false where all boxes of a text with at most two agree, else null."""
    on, off = F.regexp_count(x, F.lit(r"\[x\]|[☑☒✓✔]")), F.regexp_count(x, F.lit(r"\[ \]|[☐□]"))
    return F.when((on + off).between(1, 2) & (off == 0), True).when((on + off).between(1, 2) & (on == 0), False)


def exemption(value: Column, declared: Column, members: Column, text_digits: Column) -> Column:
    """Why a value need not be quoted: a member of its enumeration, a numeric zero, or digits that occur."""
    d = F.regexp_replace(value, "[^0-9]", "")
    numeric = declared.isin("number", "integer")
    return F.when(F.array_contains(members, value), "enum").when(numeric & value.rlike(r"^-?0+(\.0+)?$"), "zero-default").when(numeric & (d != "") & F.contains(text_digits, d), "digits").when(value.rlike("^[0-9]+$") & F.contains(text_digits, d), "digits")


def ground(leaves: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """One row per leaf: value (null if strict and not found), grounded, verified_by, idx and evidence.

    In order: the quote, in cited chunks before others; the value as such if it is long enough and no
    bare number; the value with other signs between. An absent value is grounded. Chunks meet only
    the leaves of their document.
    """
    c = chunks.select("doc_id", "idx", F.col("text").alias("_t"), norm(F.col("text")).alias("_n"))
    v, q = norm(F.col("value")), norm(F.col("quote"))
    pair = leaves.where("coalesce(value, '') <> ''").join(c, "doc_id")
    letters = F.length(F.regexp_replace(v, "[^a-z0-9]", ""))
    step = (
        F.when((F.coalesce(q, F.lit("")) != "") & F.contains("_n", q), 1)
        .when((F.length(v) >= CONTAINED) & ~v.rlike("^[0-9]+$") & F.contains("_n", v), 2)
        .when(letters.between(8, 200) & F.regexp_like("_n", separator_tolerant(F.col("value"))), 3)
    )
    place = F.array_position(F.coalesce("cited", F.array().cast("array<int>")), F.col("idx"))
    hit = pair.withColumn("_s", step).where("_s is not null").withColumn("_p", F.when(place > 0, place))
    w = Window.partitionBy("leaf_id").orderBy("_s", F.asc_nulls_last("_p"), "idx")
    best = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("leaf_id", "idx", "_s", "_t", "quote")
    named = F.when(F.col("_s") == 1, "quote").when(F.col("_s") == 2, "contained").when(F.col("_s") == 3, "separators")
    found = best.select("leaf_id", "idx", named.alias("verified_by"), F.left(F.when(F.col("_s") == 1, F.col("quote")).otherwise(F.col("_t")), F.lit(SHOWN)).alias("evidence"))
    out = leaves.join(found, "leaf_id", "left").withColumn("grounded", (F.coalesce("value", F.lit("")) == "") | F.col("idx").isNotNull())
    return out.select("leaf_id", F.when(F.col("grounded") | F.lit(not strict), F.col("value")).alias("value"), "grounded", "verified_by", "idx", "evidence")


def support_chunks(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """Up to 16 chunks of 25 characters or more that stand in a long value, in their order."""
    pair = leaves.where(F.length("value") >= LONG_PROSE).join(chunks, "doc_id").where((F.length(norm(F.col("text"))) >= SUPPORT) & F.contains(norm(F.col("value")), norm(F.col("text"))))
    w = Window.partitionBy("leaf_id").orderBy("idx")
    return pair.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SUPPORTS).select("leaf_id", "idx")


def field_confidence(evidence: DataFrame) -> DataFrame:
    """The least confidence of a field's evidence; null if none has one."""
    return evidence.groupBy("leaf_id").agg(F.min("confidence").alias("confidence"))
