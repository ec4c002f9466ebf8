import random
import re

from docweave.llm.pii import KINDS, base_spans, find_pii, mask_pii, reliabilities
from docweave.llm.secrets import digest, spans_sha256


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def brute(text):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= n(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= n(m[0]) <= 15]
    return out


def test_base_spans_as_written():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@@", ".", "-", " ", "+", "(", ")", "1", "255", "256", "0001", "4111111111111111", "4111-1111 1111-1111", "12", "é", "\n", "٣", "+1 (051) 555-0588", "1.2.3.4", "x@y.z"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert base_spans(text)[0] == brute(text), repr(text)
    assert len(base_spans("a" * 200_000 + "1" * 200_000)[0]) == 0


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes = [(1 if truth == (rng.random() < a) else 2) for a in (0.9, 0.85, 0.9, 0.5, 0.8)]
        key = (3, sum(v * 3**i for i, v in enumerate(votes)))
        counts[key] = counts.get(key, 0) + 1
    prior, table, q = reliabilities(counts)
    assert abs(prior[3] - 0.5) < 0.08
    assert table[3, 0, 1, 1] > 0.8 and abs(table[3, 3, 1, 1] - 0.5) < 0.1


def test_find_and_mask(spark):
    texts = [None, "", "mail me: a.b@c.example.com or call 555-5272 now", "ip 10.0.0.256 and 10.0.0.1", "4111 1111 1111 1111", "on 2024-01-02", "tel +1 (051) 555-0588.", *(f"please call {i:03d} 555-01{i:02d} today" for i in range(40)), *(f"a {i} b" for i in range(20))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = find_pii(docs)
    got = {r.doc_id: r for r in digest(found, KINDS).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == spans_sha256(brute(t or "")), t
    assert "phone:" in got[10].spans and got[5].spans == ""
    masked = {r.doc_id: r for r in mask_pii(docs).collect()}
    assert masked[0].text is None and masked[3].text.endswith("and <ip>") and masked[6].text == "tel <phone>."
    assert masked[7].spans == 7 and len(masked) == len(texts)
    assert find_pii(docs.limit(0)).count() == 0
