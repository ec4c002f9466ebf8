"""Quality rules learned as a decision list, computed by DataFrame functions alone.

Statistics of each text are built-in expressions. From labelled statistics (a bounded sample that
the driver fits) sequential covering learns an ordered list of conjunctions of thresholds: a rule
grows on two thirds of the sample by the condition of best information gain, is pruned on the rest,
and the rows that it covers leave. The list becomes one CASE expression in rule order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import keep

_SPACES = " \t\n\x0b\x0c\r"
#: Shares and sizes that rules may test; all are finite for any text.
FEATURES = ("n_words", "mean_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "mark_share")


def _without(text: str, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, the counts of the contract, and FEATURES.

    Null and empty texts have zero for all. Words stand between spaces, \\t, \\n, \\v, \\f and \\r.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    # each array is named in a projection of its own and used more than once, so it is made once
    one = base.select("doc_id", "t", words.alias("w"), lines.alias("l")).select("doc_id", "t", "w", F.size("w").alias("n"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), F.size("l").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"))
    triples = F.when(
        F.col("n") >= 3,
        F.zip_with(F.arrays_zip(F.slice("w", 1, F.col("n") - 2).alias("a"), F.slice("w", 2, F.col("n") - 2).alias("b")), F.slice("w", 3, F.col("n") - 2), lambda x, c: F.xxhash64(x["a"], x["b"], c)),
    ).otherwise(F.array().cast("array<bigint>"))
    two = one.withColumn("h", triples)
    # where a triple recurs: sort (hash, place) and look at both neighbours
    placed = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    three = two.withColumn("s", placed).drop("h")
    m = F.size("s")
    same = F.zip_with(F.slice("s", 1, F.greatest(m - 1, F.lit(0))), F.slice("s", 2, F.greatest(m - 1, F.lit(0))), lambda a, b: a["h"] == b["h"])
    four = three.withColumn("e", F.when(m > 1, same).otherwise(F.array().cast("array<boolean>")))
    edge = F.array(F.lit(False))
    hit = F.zip_with(F.zip_with(F.concat(edge, "e"), F.concat("e", edge), lambda a, b: a | b), F.col("s"), lambda hit, x: F.when(hit, x["i"]))
    five = four.withColumn("p", F.when(m > 1, F.sort_array(F.array_compact(hit))).otherwise(F.array().cast("array<int>"))).drop("s", "e", "w")
    k = F.size("p")
    gaps = F.zip_with(F.slice("p", 1, F.greatest(k - 1, F.lit(0))), F.slice("p", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(k > 0, F.aggregate(gaps, F.lit(3), lambda a, b: a + b)).otherwise(0)
    counted = five.withColumn("n_repeat_words", covered.cast("long")).select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(_without("t", _SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without("t", "#*$%&|<>"))).cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long"),
        "n_repeat_words",
        "n_lines",
        "n_distinct",
        (F.length("t") - F.length(_without("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_upper"),
        (F.length("t") - F.length(_without("t", "0123456789"))).alias("n_digits"),
        (F.length("t") - F.length(_without("t", ".,;:!?"))).alias("n_marks"),
    )

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_length"), share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_digits", "word_chars").alias("digit_share"), share("n_distinct", "n_words").alias("distinct_share"), share("n_marks", "n_words").alias("mark_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for j, name in enumerate(FEATURES):
            v = x[inside, j]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1])):
                high = v > cut
                for above in (True, False):
                    at = high if above else ~high
                    n1 = at.sum()
                    p1 = bad[inside][at].sum()
                    if p1 >= 5 and n1 < n0:
                        gain = p1 * (np.log2(p1 / n1) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    at = _covers(rule, x)
    p = bad[at].sum()
    return (2 * p - at.sum()) / max(at.sum(), 1)


def learn_rules(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, precision: float = 0.75, rules: int = 12, conditions: int = 4, cuts: int = 24) -> list[Rule]:
    """Sequential covering. x: rows of FEATURES; bad: to reject; prune: rows held for pruning."""
    out: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(out) < rules:
        grow, test = left & ~prune, left & prune
        if bad[grow].sum() < 5:
            break
        rule = _grow(x[grow], bad[grow], cuts, conditions)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (_worth(r, x[test], bad[test]), -len(r)))
        at = _covers(rule, x) & test
        if at.sum() < 2 or bad[at].mean() < precision:
            break
        out.append(rule)
        left &= ~_covers(rule, x)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the first rule that holds rejects; else the text is kept."""
    out = None
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, False) if out is None else out.when(both, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: the statistics, base_failed, and kept by the learned list.

    The list is fitted on at most `sample` labelled rows of least hash of the id among about twice as many
    (a documented bound, also of what the driver receives; the list itself covers all rows). Rows without a label, null labels and no
    labels at all are no examples; without examples the list is empty and keeps what the base keeps.
    Null and empty texts fail the base. Equal rows get equal verdicts; no rows give no rows.
    """
    stats = keep(text_statistics(docs, id_col, text_col), "statistics")
    told = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y is not null").dropDuplicates(["_id"])
    labelled = stats.join(told, stats["doc_id"] == told["_id"]).select("_id", "_y", *FEATURES)
    # a cut-off on the hash that leaves about twice the sample comes first, so that a partition sends few rows
    share = min(1.0, (2 * sample + 100) / max(1, labelled.count()))
    drawn = labelled.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(sample)
    rows = drawn.select(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(3)).alias("fold"), "_y", *FEATURES).collect()
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES))
    rules = learn_rules(x, np.array([r["_y"] == 0 for r in rows], bool), np.array([r["fold"] == 0 for r in rows], bool))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", F.when(failed, False).otherwise(verdict(rules)))
