"""Each rung of the ladder, their order, and exemptions."""

from docweave.operators.ladder import Leaf, Source, boxes_written, digit_forms, ground, grounded, in_order, run_pattern

TEXTS = ["Invoice no. AB-12 34/567 of Acme", "Corp and others", "Total due: Acme Corp pays", "[x] Married [ ] Single", "☑️ Insured", "[ ] Smoker", "on 29.04.26 at 2:30 pm", "amount 59.900"]
SOURCE = Source(TEXTS, [1, 1, 2, 2, 2, 2, 3, 3])


def by(value, **more):
    name, places, _ = grounded(Leaf(value, **more), SOURCE, True)
    return name, places[0] if places else None


def test_rungs():
    assert by("Acme", quote="ACME  corp pays") == ("quote", 2) and by("Acme", quote="acme", cited=(2, 0)) == ("quote", 2)
    assert by("Corp", quote="of acme corp and") == ("page_quote", 1) and by("zz", quote="of acme corp and") == ("page_quote", 0)
    assert by("acme corp pays") == ("contained", 2) and by("acme") == (None, None)
    assert by("AB 1234567") == ("separators", 0) and by("AB 123456") == (None, None) and by("b1234567") == (None, None)
    assert by("Acme/Corp and") == ("page_separators", 0) and by("Corp/Total due") == (None, None)
    assert by("59.900") == (None, None) and by("12345678") == (None, None)


def test_checkboxes():
    yes, no = {"kind": "boolean"}, {"kind": "boolean"}
    assert by("true", quote="(X) Married", **yes) == ("checkbox_quote", 3) and by("false", quote="(X) Married", **no) == (None, None)
    assert by("true", quote="[x]", **yes)[0] == "quote" and by("true", quote="☒", **yes) == (None, None)
    assert by("true", cited=(4,), **yes) == ("checkbox", 4) and by("false", cited=(4,), **no) == (None, None) and by("false", cited=(5,), **no) == ("checkbox", 5)
    assert by("true", cited=(3,), **yes) == (None, None) and by("true", **yes) == (None, None) and by("true", cited=(4,), quote="made up", **yes) == (None, None)
    assert boxes_written("☑️ a [ ]  (x)") == "[x] a [ ] [x]"


def test_exemptions():
    assert by("A", members=("A", "B")) == ("enum", None) and by("C", members=("A",)) == (None, None)
    assert by("0.0", kind="number") == ("zero-default", None) and by("59900.0", kind="number") == ("digits", None) and by("7.5", kind="number") == (None, None)
    assert by("567") == ("digits", None) and by("56") == (None, None)
    assert by("2026-04-29", datetime=True) == (None, None) and by("26-04-29") == (None, None)
    assert by("14:30", datetime=True) == ("date-digits", None) and by("14:31", datetime=True) == (None, None)
    assert digit_forms("2026-04-29") == {"20260429", "260429"} and in_order("ace", "abcde") and not in_order("aec", "abcde")
    assert grounded(Leaf("0", kind="number"), SOURCE, False)[0] is None and run_pattern("--") is None


def test_support():
    long = "Invoice no. AB-12 34/567 of Acme and in full Total due: Acme Corp pays and that is all there is to it, by and large"
    name, places, evidence = grounded(Leaf(long, quote="Corp and others"), SOURCE, True)
    assert (name, places, evidence) == ("quote", [0, 1, 2], "Corp and others")


def test_relation(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "words of a page"), (1, 1, 1, None)], "doc_id long, page_no int, idx int, text string")
    leaves = spark.createDataFrame([(1, 1, "of a page", None), (2, 1, "not there", "no"), (3, 1, None, "x"), (4, 1, "", None), (5, 9, "words of a page", "words")], "leaf_id long, doc_id long, value string, quote string")
    got = {r.leaf_id: r for r in ground(leaves, chunks).collect()}
    assert [(got[i].value, got[i].grounded, got[i].verified_by) for i in range(1, 6)] == [("of a page", True, "contained"), (None, False, None), (None, True, None), (None, True, None), (None, False, None)]
    assert {r.leaf_id: r.value for r in ground(leaves, chunks, strict=False).collect()}[2] == "not there" and ground(leaves.limit(0), chunks).count() == 0
