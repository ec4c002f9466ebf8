import random
import re

import pytest
from docweave.llm import jaccard
from docweave.llm.jaccard import similarity_classes


def brute(rows, size=4, num=85, den=100):
    sets = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Der", "çA", "the", "the"]
    line = "licensed under the apache license version two point zero".split()
    bases = [[rng.choice(vocab) for _ in range(rng.choice([5, 12, 60, 150]))] for _ in range(14)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.75 else [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.4:
            w += line
        rows.append((1000 - i, rng.choice([" ", "\n"]).join(w)))
    return [*rows, (5, None), (6, ""), (7, "one two"), (8, "ONE two"), (9, "two one"), (None, rows[0][1]), (None, "a b"), rows[1]]


@pytest.mark.parametrize("seed,chunk,frequent,more", [(1, 256, 200, 0.03), (2, 3, 100, 0.0), (3, 5, 0, 0.1)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, frequent, more):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = [tuple(r) for r in similarity_classes(docs, frequent=frequent, more=more).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert similarity_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
