"""Record algebra: coverage between records, identity cells, merges, and grounding of values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import alphanumerics


#: The least length of a signature that covers by being the beginning or end of another.
PART = 6


def _covered(x: Column, n: Column) -> Column:
    """Signatures of length n that x covers; of n null the empty one, which stands for an absent field."""
    parts = F.when(n == F.length(x), F.array(x)).when((n < F.length(x)) & (n >= PART), F.array_distinct(F.array(F.left(x, n), F.right(x, n))))
    return F.when(n.isNull(), F.array(F.lit(""))).otherwise(parts)


def dedup_records(records: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """Drop records of a group that a richer one covers, or an equal earlier one. Signatures ignore case and signs.

    A field's signature covers another that is equal, absent, or a long enough beginning or end of it. So each record names
    the signatures it covers, of lengths that records have, and meets those records by equal keys; of all that cover one
    signature the richest two of different places tell, since only a record's own place doesn't count against it.
    """
    signed = records.where(F.col(group).isNotNull() & F.col(order).isNotNull()).select(F.col(group).alias("_g"), F.col(order).alias("_o"), *(F.nullif(alphanumerics(F.col(f).cast("string")), F.lit("")).alias(f"_f{k}") for k, f in enumerate(fields)))
    names = [f"_f{k}" for k in range(len(fields))]
    signed = signed.withColumn("_less", -sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0)))
    shapes = signed.agg(F.collect_set(F.array(*(F.length(f) for f in names))).alias("_shapes"))
    able = lambda p: reduce(and_, (F.size(_covered(F.col(f), p[k])) > 0 for k, f in enumerate(names)), F.lit(True))
    x = signed.crossJoin(F.broadcast(shapes)).select("_g", "_o", "_less", *names, F.explode(F.filter("_shapes", able)).alias("_p"))
    for k, f in enumerate(names):
        x = x.withColumn(f, F.explode(_covered(F.col(f), F.col("_p")[k])))
    best = x.groupBy("_g", *names, "_o").agg(F.min("_less").alias("_less"))
    w = Window.partitionBy("_g", *names).orderBy("_less", "_o")
    best = best.withColumn("_r", F.row_number().over(w)).where("_r <= 2").select("_g", *names, F.col("_o").alias("_bo"), F.col("_less").alias("_bl"))
    own = signed.select("_g", "_o", "_less", *(F.coalesce(f, F.lit("")).alias(f) for f in names)).alias("a")
    same = reduce(and_, (F.col(f"a.{f}") == F.col(f"b.{f}") for f in ["_g", *names]))
    richer = (F.col("_bl") < F.col("_less")) | ((F.col("_bl") == F.col("_less")) & (F.col("_bo") < F.col("_o")))
    drop = own.join(best.alias("b"), same & (F.col("_o") != F.col("_bo")) & richer, "left_semi").select(F.col("_g").alias(group), F.col("_o").alias(order))
    return records.join(drop, [group, order], "left_anti")


def identity_cells(rows: DataFrame) -> DataFrame:
    """rows: (row_id, path, value). Cells whose value stands in exactly one row under its path."""
    w = Window.partitionBy("path", "value")
    return rows.where("value is not null").withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")


def first_non_null(rows: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """Per key the first non-null value of each field in batch order."""
    return rows.groupBy(*key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def merge_evidence(parsed: DataFrame, localized: DataFrame, key: list[str]) -> DataFrame:
    """Valid localized boxes win over parsed ones."""
    return parsed.join(localized.where("valid").select(*key, F.col("box").alias("_box")), key, "full").select(*key, F.coalesce("_box", "box").alias("box"), F.col("_box").isNotNull().alias("localized"))


def value_occurrences(values: DataFrame, texts: DataFrame, words: int = 4) -> DataFrame:
    """(value_id, text_id) where the text contains the whole value.

    Candidates share the value's rarest run of `words` words, so texts meet values by equal keys and
    not all with all; containment is then tested as such. Only values of fewer than two words more are
    tested against every text.
    """
    def runs(frame, column, skip):
        """The runs of words of a text without its first and last `skip` words; null if there are none."""
        split = frame.withColumn("_w", F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " "))
        n = F.size("_w") - 2 * skip - (words - 1)
        # parallel slices of one array, which is split once a text
        shifted = F.arrays_zip(*(F.slice("_w", k + 1 + skip, F.greatest(n, F.lit(0))).alias(f"_{k}") for k in range(words)))
        return split.withColumn("keys", F.when(n > 0, F.transform(shifted, lambda x: F.concat_ws(" ", *(x[f"_{k}"] for k in range(words)))))).drop("_w")

    hashed = lambda keys: F.transform(keys, lambda k: F.xxhash64(k))
    # a value's first and last word may stand inside longer ones, so its keys leave them out
    keyed = runs(values, "value", 1)
    v = keyed.select("value_id", "value", F.explode(F.array_distinct(hashed("keys"))).alias("key"))
    # only runs that some value has go on, hashed; what hashes take for equal is told apart by the containment
    t = runs(texts, "text", 0).select("text_id", F.explode(F.array_distinct(hashed("keys"))).alias("key")).join(v.select("key").distinct(), "key", "left_semi")
    seen = v.join(t.groupBy("key").agg(F.count("*").alias("n")), "key", "left").fillna(0, ["n"])
    w = Window.partitionBy("value_id").orderBy("n", "key")
    key = seen.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("value_id", "value", "key")
    long = key.join(t, "key").join(texts, "text_id").where(F.contains("text", "value")).select("value_id", "text_id")
    short = keyed.where("keys is null").join(texts, F.contains("text", "value")).select("value_id", "text_id")
    return long.union(short).distinct()


def first_match(values: DataFrame, chunks: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """values: (value_id, doc_id, value); chunks: (doc_id, idx, text). The first chunk of the document that
    contains the value, cited ones (value_id, idx, pos) in their order before others."""
    hit = values.join(chunks, "doc_id").where(F.contains("text", "value"))
    if cited is not None:
        hit = hit.join(cited, ["value_id", "idx"], "left")
    else:
        hit = hit.withColumn("pos", F.lit(None).cast("int"))
    w = Window.partitionBy("value_id", "doc_id").orderBy(F.asc_nulls_last("pos"), "idx")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("value_id", "doc_id", "idx")
