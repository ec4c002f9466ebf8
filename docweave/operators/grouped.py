"""Rows of one key together in Python, many keys an Arrow batch: a call for each key costs more than most keys' work."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that is given back; rows and bytes of one that goes to Python, where texts are whole documents.
OUT_ROWS, IN_ROWS, IN_BYTES = 5_000, 1_000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, which a worker holds whole; a session's smaller bounds stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= IN_ROWS:
        spark.conf.set(key, IN_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", IN_BYTES)


def whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole keys, which stand first and are sorted, and where each begins and the last ends. Held: a batch and the key that it cuts."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
        if held and (cut or keys[0] != last):
            # a batch of one key that isn't the held one
            yield _cut(held + [batch.slice(0, cut)])
            held = []
        elif cut:
            yield _cut([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield _cut(held)


def _cut(pieces: list[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
    table = pa.Table.from_batches(pieces).combine_chunks()
    keys = table.column(0).to_pylist()
    return table, [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]


def per_key(df: DataFrame, fold: Callable[[pa.Table, list[int]], Iterable[tuple]], shape: pa.Schema, schema: str) -> DataFrame:
    """df by its first column: fold gets tables of whole keys with their bounds and makes rows of shape (schema in Spark's words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_keys(batches):
            rows = iter(fold(table, bounds))
            while some := list(islice(rows, OUT_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), shape, strict=True)], schema=shape)

    key = df.columns[0]
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def values(column: pa.Array | pa.ChunkedArray) -> list:
    """to_pylist, faster for numbers."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    return column.to_numpy().tolist()


def records(table: pa.Table) -> list[dict]:
    """to_pylist of columns without structs, faster."""
    names = table.column_names
    return [dict(zip(names, r)) for r in zip(*(values(c) for c in table.columns), strict=True)]


def lists(column: pa.ChunkedArray, *fields: str, make: Callable[[tuple], object] = tuple) -> list[list]:
    """A column of arrays of structs, each struct as what make makes of a tuple of its fields; a null array is empty."""
    out: list[list] = []
    for array in column.chunks:
        inner = array.flatten()
        rows = list(map(make, zip(*(values(inner.field(f)) for f in fields), strict=True)))
        at = 0
        for n in array.value_lengths().to_pylist():
            out.append(rows[at : at + (n or 0)])
            at += n or 0
    return out
