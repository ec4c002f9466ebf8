from docweave.operators import grounding as G
from pyspark.sql import functions as F


def test_ladder(spark):
    chunks = spark.createDataFrame([(1, 0, "Invoice no. AB-12 34/567 of Acme  Corp"), (1, 1, "Total due: Acme Corp pays"), (1, 2, "acme corp pays at once, and in full, within thirty days"), (2, 0, "other")], "doc_id long, idx int, text string")
    leaves = spark.createDataFrame(
        [(1, 1, "Acme", "acme corp", [1]), (2, 1, "ab 1234567", None, None), (3, 1, "total due:", None, None), (4, 1, "missing value", None, None), (5, 1, None, None, None), (6, 1, "12345678", None, None), (7, 2, "Acme", "acme corp", None)],
        "leaf_id long, doc_id long, value string, quote string, cited array<int>",
    )
    got = {r.leaf_id: r for r in G.ground(leaves, chunks).collect()}
    assert (got[1].idx, got[1].verified_by, got[1].evidence) == (1, "quote", "acme corp")
    assert (got[2].idx, got[2].verified_by) == (0, "separators") and (got[3].idx, got[3].verified_by) == (1, "contained")
    assert not got[4].grounded and got[4].value is None and got[5].grounded and not got[6].grounded and not got[7].grounded
    assert G.ground(leaves, chunks, strict=False).where("leaf_id = 4").first().value == "missing value"
    long = spark.createDataFrame([(1, 1, "So it is that Acme Corp pays at once, and in full, within thirty days of the date above.", None, None)], leaves.schema)
    assert [r.idx for r in G.support_chunks(long, chunks).collect()] == [2]


def test_exemptions_and_boxes(spark):
    rows = spark.createDataFrame([("A", "string", ["A"], "1"), ("0.0", "number", None, ""), ("1,200", "number", None, "9120077"), ("77", "string", None, "9120077"), ("x", "string", None, "1")], "v string, t string, m array<string>, d string")
    assert [r[0] for r in rows.select(G.exemption(F.col("v"), F.col("t"), F.col("m"), F.col("d"))).collect()] == ["enum", "zero-default", "digits", "digits", None]
    boxes = spark.createDataFrame([("[x] yes",), ("☐ no ☐",), ("[x] [ ]",), ("[x][x][x]",), ("none",)], "t string")
    assert [r[0] for r in boxes.select(G.checkbox_polarity(F.col("t"))).collect()] == [True, False, None, None, None]
    e = spark.createDataFrame([(1, 0.5), (1, None), (2, None)], "leaf_id long, confidence double")
    assert {r.leaf_id: r.confidence for r in G.field_confidence(e).collect()} == {1: 0.5, 2: None}
