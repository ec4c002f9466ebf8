"""Agreement of reads as multisets of tokens, votes, and joins of words, boxes and rows."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_f1(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: (id, token). pairs: (a, b). F1 of the token multisets: null if both are empty, 0 if one is."""
    ca = a.groupBy(F.col("id").alias("a"), "token").agg(F.count("*").alias("na"))
    cb = b.groupBy(F.col("id").alias("b"), "token").agg(F.count("*").alias("nb"))
    ta, tb = ca.groupBy("a").agg(F.sum("na").alias("ta")), cb.groupBy("b").agg(F.sum("nb").alias("tb"))
    both = pairs.join(ca, "a").join(cb, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("m"))
    x = pairs.join(ta, "a", "left").join(tb, "b", "left").join(both, ["a", "b"], "left").fillna(0, ["ta", "tb", "m"])
    return x.select("a", "b", F.when((F.col("ta") == 0) & (F.col("tb") == 0), None).when(F.col("m") == 0, 0.0).otherwise(2.0 * F.col("m") / (F.col("ta") + F.col("tb"))).alias("f1"))


def text_f1(a: DataFrame, b: DataFrame, pairs: DataFrame, sign: str = " ") -> DataFrame:
    """multiset_f1 of the pieces of whole texts. a, b: (id, text); an id's texts count together, null ones not at all.

    Texts are shuffled as they are and split where they are compared, so that no token is a row.
    """
    ta, tb = (x.where("id is not null").groupBy(F.col("id").alias(n)).agg(F.collect_list("text").alias(f"_t{n}")) for x, n in ((a, "a"), (b, "b")))
    # ids of a are looked up first, since pairs are often one for each of them
    x = pairs.join(ta, "a", "left").join(tb, "b", "left")

    @F.arrow_udf("double")
    def f1(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for k in range(len(left)):
            na, nb = (Counter(t for text in x[k].as_py() or () for t in text.split(sign)) for x in (left, right))
            m, n = sum(min(c, nb[t]) for t, c in na.items() if t in nb), na.total() + nb.total()
            out.append(None if not n else 2.0 * m / n)
        return pa.array(out, pa.float64())

    return x.select("a", "b", f1("_ta", "_tb").alias("f1"))


def majority_read(scores: DataFrame, least: float = 0.9) -> DataFrame:
    """scores: (page, a, b, f1) of pairs of reads. The earliest read of the best pair that agrees; null if none does."""
    w = Window.partitionBy("page").orderBy(F.desc_nulls_last("f1"), "a", "b")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("page", F.when(F.col("f1") >= least, F.col("a")).alias("served_read"))


def multiset_minus(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of left that remain when each row of right takes away one equal key, earliest first."""
    w = Window.partitionBy(*key).orderBy(*order)
    l, r = left.withColumn("_n", F.row_number().over(w)), right.withColumn("_n", F.row_number().over(w)).select(*key, "_n")
    return l.join(r, [*key, "_n"], "left_anti").drop("_n")


def inside(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column, slack: float = 0.0) -> Column:
    return (x >= x0 - slack) & (x <= x1 + slack) & (y >= y0 - slack) & (y <= y1 + slack)


def words_in_boxes(words: DataFrame, boxes: DataFrame, cell: float = 64.0, slack: float = 0.5) -> DataFrame:
    """Text of the words whose centres lie in each box. Both are dealt to grid cells of the page, so the
    join is on equal (doc, page, cell) and only neighbours are compared."""
    w = words.withColumn("_cx", (F.col("x0") + F.col("x1")) / 2).withColumn("_cy", (F.col("y0") + F.col("y1")) / 2).withColumn("_gx", F.floor(F.col("_cx") / cell)).withColumn("_gy", F.floor(F.col("_cy") / cell))
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - slack) / cell), F.floor((F.col(b) + slack) / cell)))
    b = boxes.select("doc_id", "page_no", "box_id", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")), span("x0", "x1").alias("_gx")).withColumn("_gy", span("by0", "by1"))
    hit = w.join(b, ["doc_id", "page_no", "_gx", "_gy"]).where(inside(F.col("_cx"), F.col("_cy"), F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), slack))
    return hit.groupBy("doc_id", "box_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word_no", "word"))), lambda x: x["word"]), " ").alias("text"))


def nearest_row(words: DataFrame, rows: DataFrame, pitch: float, within: float = 0.55) -> DataFrame:
    """Each word's nearest row of the same page within a share of the pitch; equal distances take the upper row."""
    near = words.withColumn("_c", F.explode(F.array(*(F.floor(F.col("y") / pitch) + k for k in (-1, 0, 1)))))
    pair = near.join(rows.withColumn("_c", F.floor(F.col("row_y") / pitch)), ["page", "_c"]).withColumn("_d", F.abs(F.col("y") - F.col("row_y"))).where(F.col("_d") <= within * pitch)
    w = Window.partitionBy("page", "word_id").orderBy("_d", "row")
    return pair.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("page", "word_id", "row")


def box_iou(a: str = "a", b: str = "b") -> Column:
    w = F.greatest(F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0"), F.lit(0.0))
    h = F.greatest(F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0"), F.lit(0.0))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    return F.when(w * h == 0, 0.0).otherwise(w * h / (area(a) + area(b) - w * h))
