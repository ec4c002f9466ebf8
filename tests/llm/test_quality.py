import random
import re
from collections import Counter

import numpy as np
from docweave.llm.quality import FEATURES, learn_rules, quality_verdicts, text_statistics


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    at = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(at))


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "é ü é ü é ü 漢", "x\x0by\x0cz", "l one\nl one\n \n \nl one ", "w " * 5000]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "the", "çé", "#", "x|y", "$$"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 60))))
    return out


def test_statistics(spark):
    rows = [(i, t, 3) for i, t in enumerate(texts())]
    got = text_statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: brute(t) for i, t, _ in rows}


def test_rules_and_verdicts(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.6) & (x[:, 1] <= 0.3))
    rules = learn_rules(x, bad, np.arange(3000) % 3 == 0)
    assert len(rules) >= 2 and {c.feature for r in rules for c in r} >= {"symbol_share", "upper_share"}
    assert learn_rules(x[:0], bad[:0], bad[:0]) == []

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("***" if i % 3 == 0 else "") for _ in range(70))) for i in range(240)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_verdicts(docs, labels).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i in range(240))
    assert got[1000].base_failed and not got[1001].kept
    assert all(x.kept for x in quality_verdicts(docs.where("doc_id < 9"), labels.limit(0)).collect())
    plan = quality_verdicts(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
