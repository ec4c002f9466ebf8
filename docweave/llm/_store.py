"""Where operators keep tables between steps, and the few session settings that they rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Tables written by keep(), by the frame that reads them.
_made: dict[int, tuple[DataFrame, SparkSession, str]] = {}

#: Rows in an Arrow batch: documents differ widely in length and a Python worker holds a batch.
BATCH_ROWS = 1000
BATCH_BYTES = "8m"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see, from spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch so that a worker's memory doesn't follow a partition's size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def skew_split(spark: SparkSession, size: str = "4m"):
    """While a table is written: partitions of a join that are five times the median and over `size` are split."""
    return settings(spark, {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size, "spark.sql.adaptive.advisoryPartitionSizeInBytes": size})


@contextmanager
def settings(spark: SparkSession, now: dict[str, str]):
    """The session's settings for a while; then what they were."""
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_rows(df: DataFrame, text_col: str) -> DataFrame:
    """(row, text): each row whole as a structure, whatever its columns' names, beside its text."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), df[f"`{text_col}`"].cast("string").alias("text"))


def row_type(df: DataFrame, *more: tuple[str, DataType]) -> StructType:
    """The schema of (row, ...) with further columns."""
    return StructType([StructField("row", df.schema), *(StructField(name, kind) for name, kind in more)])


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps survive a lost executor and don't
    repeat the work. Shuffle files of the writing go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docweave-{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    if not _made:
        atexit.register(_clear)
    kept = spark.read.schema(df.schema).parquet(path)
    _made[id(kept)] = (kept, spark, path)
    return kept


def drop(*kept: DataFrame) -> None:
    """Delete tables that keep() gave and that nothing will read again; other frames are left alone."""
    for df in kept:
        found = _made.pop(id(df), None)
        if found:
            _delete(*found[1:])


def drop_kept(spark: SparkSession) -> None:
    """Delete the tables written so far by keep()."""
    _clear()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; what is left is in a folder for temporary files
        pass


def _clear() -> None:
    while _made:
        _delete(*_made.popitem()[1][1:])
