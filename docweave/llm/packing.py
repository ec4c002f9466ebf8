"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token pieces of at most `capacity` tokens. The histogram of piece lengths (at
most `capacity` classes, whatever the corpus) goes to the driver. A configuration is a multiset
of lengths that fits into one sequence. The linear program "fewest configurations that hold all
pieces of every class" is solved by multiplicative weights: a class weighs its price in a dual
solution that proves a bound, times a power of the share of it that no configuration holds yet; a
knapsack dynamic program prices the configuration of greatest weight, and this column is used until a
step of one of its classes is held. Columns
never hold more than there is, so the real numbers of uses are rounded down and what is left of the
histogram, less than one use a column, is priced on in whole numbers. The bound tells how far the plan
is from the fewest sequences. Pieces then find their place by their rank within their class:
no piece moves to the driver or to one task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._store import keep, small_batches
from docweave.llm._tokens import shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. Only documents over `capacity` tokens are cut; the first piece may be shorter.

    A null or empty text is the end id alone. Rows with a null id are kept with a null id.
    """

    def encode(batches):
        encoder, end = shared_encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + end
                n, at, piece = len(ids) // 4, 0, 0
                size = n % capacity or capacity if n > capacity else n
                while at < n:
                    for column, value in zip(out, (doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        column.append(value)
                    at, piece, size = at + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES)


@dataclass
class Plan:
    """uses[j] sequences follow pattern j, a number of copies by length. `program` is the value of the
    linear program's solution, `bound` a number of sequences that no plan can do without, `rounded`
    the sequences that come from the program's columns and not from what rounding left."""

    uses: list[int]
    patterns: list[dict[int, int]]
    program: float = 0.0
    bound: int = 0
    rounded: int = 0

    @property
    def sequences(self) -> int:
        return sum(self.uses)


#: Classes that a column is priced from; runs until one gets near the bound: whether first prices are the
#: dual ones or the lengths, which are dual prices too, rate of the weights, and step.
PRICED, RUNS, NEAR = 192, ((False, 0.1, 1.0), (True, 0.1, 1.0), (True, 1.0, 0.5)), 5e-4


def _price(lengths: np.ndarray, weights: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of classes of greatest weight that fits, with at most so many copies of each: a bounded knapsack."""
    best, items = np.zeros(capacity + 1), []
    for k, (length, weight, left) in enumerate(zip(lengths.tolist(), weights.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True)):
        copies = 1
        while left > 0:
            copies = min(copies, left)
            size = length * copies
            more = best[: capacity + 1 - size] + weight * copies
            better = np.zeros(capacity + 1, bool)
            np.greater(more, best[size:], out=better[size:])
            best[size:] = np.maximum(best[size:], more)
            items.append((k, copies, size, better))
            left -= copies
            copies *= 2
    out: dict[int, int] = {}
    room = capacity
    for k, copies, size, better in reversed(items):
        if better[room]:
            out[k] = out.get(k, 0) + copies
            room -= size
    return out


def _columns(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int, rate: float, step: float, whole: bool) -> list[tuple[float, dict[int, int]]]:
    """(uses, copies by class) that hold exactly the counts, with real uses or whole ones.

    A round holds `step` of one class at least, or the rest of it: there are at most classes / step rounds
    (whole: as many as pieces).
    """
    left, out = counts.astype(np.int64 if whole else float), []
    rng = np.random.default_rng(len(lengths))
    while True:
        alive = np.flatnonzero(left > 0)
        if not len(alive):
            return out
        share = left / counts
        weights = prices * np.exp(rate * (share - 1))
        if len(alive) > PRICED:
            # the classes of which most is left, with some chance so that lengths mix
            alive = alive[np.argpartition(-(share[alive] + 0.3 * rng.random(len(alive))), PRICED)[:PRICED]]
        alive = alive[np.argsort(-lengths[alive])]
        found = {int(alive[k]): n for k, n in _price(lengths[alive], weights[alive], np.ceil(left[alive]).astype(np.int64), capacity).items()}
        uses = min(min(left[k], step * counts[k]) / n for k, n in found.items())
        if whole:
            uses = int(uses)
        for k, n in found.items():
            left[k] -= uses * n
            if not whole and left[k] < 1e-6:
                left[k] = 0.0
        out.append((uses, found))


def fewest(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """A bound from below, and the prices of the classes that prove it.

    For some least size, pieces over capacity less that size stand alone and price one, smaller ones
    price nothing, the others their length; or only pieces of over half the capacity price, one each.
    """
    size = np.bincount(lengths, weights=lengths * counts, minlength=capacity + 1)
    number = np.bincount(lengths, weights=counts, minlength=capacity + 1).astype(np.int64)
    sums, numbers = np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.concatenate([[0], np.cumsum(number)])
    half = capacity // 2
    alone = int(numbers[-1] - numbers[half + 1])
    bound, prices = alone, (lengths > half).astype(float)
    for least in range(half + 1):
        top = capacity - least + 1
        beside = int(numbers[-1] - numbers[top]) + -(-int(sums[top] - sums[least]) // capacity)
        if beside > bound:
            bound, prices = beside, np.where(lengths >= top, 1.0, np.where(lengths >= least, lengths / capacity, 0.0))
    return bound, prices


def solve_configurations(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns and their whole numbers of uses that hold exactly the histogram's pieces.

    Work and memory depend on the number of classes, never on the number of pieces.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return Plan([], [])
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    bound, dual = fewest(lengths, counts, capacity)
    by_length = lengths / capacity
    best: Plan | None = None
    for own, rate, step in RUNS:
        prices = dual + 0.05 * by_length if own else by_length  # of equal prices, the fuller sequence
        columns = _columns(lengths, counts, prices, capacity, rate, step, False)
        plan = [(int(uses + 1e-9), found) for uses, found in columns if uses + 1e-9 >= 1]
        left = counts.copy()
        for uses, found in plan:
            for k, n in found.items():
                left[k] -= uses * n
        rounded = sum(uses for uses, _ in plan)
        some = left > 0
        index = np.flatnonzero(some).tolist()
        plan += [(uses, {index[k]: n for k, n in found.items()}) for uses, found in _columns(lengths[some], left[some], prices[some], capacity, rate, 1.0, True)]
        made = Plan([uses for uses, _ in plan], [{int(lengths[k]): n for k, n in found.items()} for _, found in plan], sum(uses for uses, _ in columns), bound, rounded)
        if best is None or made.sequences < best.sequences:
            best = made
        if best.sequences <= bound + max(1, int(NEAR * bound)):
            break
    return best


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Give each piece its sequence and offset, by its rank among the pieces of its length.

    Ranks are local to a bucket of documents, plus the class's count in the buckets before it:
    a class with a third of all pieces is spread over all buckets.
    """
    spark = pieces.sparkSession
    buckets = max(8, min(1 << 20, plan.sequences // 10_000))
    slots: dict[int, list[tuple]] = {}
    base = 0
    for uses, pattern in zip(plan.uses, plan.patterns, strict=True):
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            slots.setdefault(length, []).append((uses * copies, copies, base, offset))
            offset += length * copies
        base += uses
    table = {k: (np.cumsum([0] + [x[0] for x in v]), *(np.array([x[i] for x in v], np.int64) for i in (1, 2, 3))) for k, v in slots.items()}
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    local = Window.partitionBy("_b", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_b", "length").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = keyed.withColumn("_r", F.row_number().over(local)).join(counts, ["_b", "length"]).withColumn("_r", F.col("_r") - 1 + F.col("_before")).select("doc_id", "piece", "start", "length", "ids_crc32", "_r")

    def assign(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                bounds, copies, base, start = table[int(k)]
                j = np.searchsorted(bounds, rank[at], "right") - 1
                within = rank[at] - bounds[j]
                sequence[at] = base[j] + within // copies[j]
                offset[at] = start[j] + within % copies[j] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    small_batches(spark)
    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens; one row per piece.

    Nulls and empty texts are a piece of one token; equal documents are packed each on its own;
    no rows give no rows; other columns of docs are not read.
    """
    pieces = keep(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return place(pieces, solve_configurations(histogram, capacity))
