import random
import re

from docweave.llm.secrets import KINDS, base_spans, digest, find_secrets, spans_sha256, thresholds


def brute(text):
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((*m.span(), "assign"))
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def test_base_spans_as_written():
    rng = random.Random(4)
    parts = ["password", "Token", "api_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "abcdef", "é", "İ", "ſecret", "x", "\n", "abc.def/+_-="]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert base_spans(text) == brute(text), text


def test_query_shape_and_discoveries(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(["th", "er", "on", "an", "in", "es"]) for _ in range(n))
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    planted = key(44)
    texts = [None, "", *(" ".join(word(rng.randint(8, 24)) for _ in range(40)) for _ in range(150)), f"see {planted} here", *(f"k {key(40)} k" for _ in range(20)), "password = hunter2hunter2"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, s int")
    got = {r.doc_id: r for r in digest(find_secrets(docs), KINDS[:3]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == spans_sha256(brute(t or ""))
    assert got[152].spans == "random:4:48"
    assert sum("random" in got[i].spans for i in range(2, 152)) == 0
    assert got[len(texts) - 1].n_assign == 1
    assert find_secrets(docs.limit(0)).count() == 0
    assert set(thresholds({}, 0.05).values()) == {64}
