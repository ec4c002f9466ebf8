"""Recall and false discoveries of the spans that the methods add, on planted keys and personal data among real documents."""

import random

import pytest
from docweave.llm.pii import find_pii
from docweave.llm.secrets import find_secrets

SF = "/root/testdata/sf0.01"
_62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = {"base64": _62 + "+/", "letters and digits": _62, "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "hex": "0123456789ABCDEF"}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def planted(rng, documents, values):
    """(rows, place of each value by id): each value among the words of some document."""
    rows, places = [], {}
    for i, value in enumerate(values):
        words = (rng.choice(documents)[1] or "").split()[:80]
        at = rng.randint(0, len(words))
        before = "".join(w + " " for w in words[:at])
        rows.append((1_000_000 + i, f"{before}{value} {' '.join(words[at:])}"))
        places[1_000_000 + i] = (len(before), len(before) + len(value))
    return rows, places


def recall(got, places):
    return sum(any(s <= a + 1 and e >= b - 1 for _, s, e in got[i]) for i, (a, b) in places.items()) / len(places)


def spans(found):
    return {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in found.collect()}


def test_secrets(spark, documents):
    rng = random.Random(9)
    lengths = {"base64": (20, 24, 32, 64), "letters and digits": (20, 24, 32, 64), "base32": (32, 40, 64), "hex": (32, 40, 64)}
    values = ["".join(rng.choice(_62) for _ in range(2)) + "".join(rng.choice(ALPHABETS[e]) for _ in range(n - 4)) + "x1" if e != "hex" and e != "base32" else "".join(rng.choice(ALPHABETS[e]) for _ in range(n)) for e, ns in lengths.items() for n in ns for _ in range(12)]
    rows, places = planted(rng, documents, values)
    got = spans(find_secrets(spark.createDataFrame(documents + rows, "doc_id long, text string")))
    assert recall(got, places) >= 0.9
    added = sum(k == "random" for d, _ in documents for k, _, _ in got[d])
    assert added <= 0.05 * len(places)


def test_personal_data(spark, documents):
    rng = random.Random(9)
    forms = ["555-0134", "(212) 555-0187", "212-555-0143", "020 7946 0958", "212.555.0176", "ann.b at example dot org", "joe (at) mail (dot) net", "x_y[at]host[dot]com"]
    values = [lead + "".join(rng.choice("23456789") if c in "123456789" else c for c in f) for f in forms for lead in ("", "call ", "") for _ in range(6)]
    rows, places = planted(rng, documents, values)
    got = spans(find_pii(spark.createDataFrame(documents + rows, "doc_id long, text string")))
    assert recall(got, {i: (a + (5 if dict(rows)[i][a:].startswith("call ") else 0), b) for i, (a, b) in places.items()}) >= 0.9
    base = {r.doc_id: {(x.kind, x.start, x.end) for x in r.base} for r in find_pii(spark.createDataFrame(documents, "doc_id long, text string")).collect()}
    # numbers that fail their checks are not added
    assert sum(k in ("card", "ip") and (k, s, e) not in base[d] for d, _ in documents for k, s, e in got[d]) == 0
