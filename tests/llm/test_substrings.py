import hashlib
import random

import pytest
from docweave.llm.substrings import repeated_passages


def brute(rows, length):
    split = [(d, (t or "").encode("utf-8").split()) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - length + 1 if d is not None else 0):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[i : i + length])] < d:
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("length,phrase", [(50, 16), (7, 3)])
def test_against_brute_force(spark, length, phrase):
    rng = random.Random(length)
    vocab = ["a", "b", "ç", "dé", "the", "漢字", "x.", "longer"] + [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([length, length + 3, 2 * length, 60]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.6:
                words += rng.choice(passages)[rng.randint(0, 4) :]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", " \x0b", "  "]) for w in words)
        rows.append((i * 7 % 120, text))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (2000, None), (2001, ""), (2002, "a " * 300), (2003, "a " * 200), (None, rows[3][1]), rows[5], rows[5]]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, n_words string")
    got = repeated_passages(docs, length, phrase).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute(rows, length), key=key)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_shards_and_long_texts(spark, monkeypatch):
    """Results don't depend on how passages and documents are dealt; a text of many slices is one document."""
    from docweave.llm import substrings

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(50, 90))] for _ in range(8)]
    long = [rng.choice(vocab) for _ in range(150_000)]
    long[70_000:70_000] = passages[0]
    rows = [(0, " ".join(long))]
    for i in range(1, 60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w + passages[i % 8] + w[:5] + (long[1000:1060] if i % 7 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows, 50))
    monkeypatch.setattr(substrings, "SHARD_PASSAGES", 5)
    monkeypatch.setattr(substrings, "STREAM", 20_000)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeated_passages(docs).collect()) == want
    assert sum(r[2] for r in want) > 2500


def test_the_automaton_alone_locates(spark):
    import numpy as np
    from docweave.llm.substrings import _locate, compiled, occurrences

    rng = np.random.default_rng(0)
    prints, bounds = rng.integers(0, 4, 400).astype(np.uint8), np.array([0, 0, 3, 150, 151, 400])
    passages = [bytes(rng.integers(0, 4, 4).astype(np.uint8)) for _ in range(40)]
    got = occurrences(compiled(passages), prints, bounds, 4)
    raw = prints.tobytes()
    want = [any(a <= i and i + 4 <= b for a, b in zip(bounds[:-1], bounds[1:])) and raw[i : i + 4] in passages for i in range(401)]
    assert got.tolist() == want and 0 < sum(want) < 300
    assert not occurrences(compiled([]), prints, bounds, 4).any()
    # the same documents, dealt with and without passages
    text = " ".join(f"w{i}" for i in range(80))
    dealt = spark.createDataFrame([(0, 1, None, 1, text, True), (0, 1, None, 2, text, True)], "part int, kind int, print binary, doc_id long, text string, carry boolean")
    assert all(not r.at for r in _locate(dealt, 50, 16).collect())
