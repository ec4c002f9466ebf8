"""The corpus pipeline: documents in, packed sequences out, one operator of docweave.llm a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows and reads them again, as a scheduler of stages would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._store import drop, keep
from docweave.llm.decontamination import drop_contaminated_rows
from docweave.llm.jaccard import one_of_each_class
from docweave.llm.packing import pack
from docweave.llm.pii import mask_pii
from docweave.llm.toxicity import drop_toxic_rows

#: No stage is expressible in SQL as a whole: two learn models and one solves a linear program.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold; labels come from the labels table.

    Rows are judged one by one: null and repeated ids are rows like others, null texts stay.
    """
    return drop_toxic_rows(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity of 0.8) the row of smallest id, a null id last.

    Of rows of one id and equal n-grams one stays. Rows without words are in no class and all stay.
    """
    return one_of_each_class(_documents(docs), size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no test item, nor the question of one, was found; judged one by one."""
    return drop_contaminated_rows(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind and n_chars counted again; a null text keeps its n_chars."""
    masked = mask_pii(_documents(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_per_class),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows. A stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
