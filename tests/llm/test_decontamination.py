import math
import random
import re
from collections import Counter

from docweave.llm.decontamination import B, K1, contaminated_passages


def words(t):
    out = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    return [w for w in out if w]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, items, least=0.5, overlap=0.8):
    texts = {i: words(t) for i, t in items if t is not None and i is not None}
    df = Counter(x for w in texts.values() for x in set(w))
    mean = sum(map(len, texts.values())) / len(texts)
    weight = {}
    for i, w in texts.items():
        tf = Counter(w)
        weight[i] = {x: math.log(1 + (len(texts) - df[x] + 0.5) / (df[x] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for x, n in tf.items()}
    size = max(128, 2 * max(map(len, texts.values())))
    out = {}
    for d, t in docs:
        w = words(t)
        at = 0
        while w:
            p = w[at : at + size]
            have, there = shingles(p), set(p)
            for i, ws in weight.items():
                if not ws:
                    continue
                s = sum(v for x, v in ws.items() if x in there) / sum(ws.values())
                share = len(shingles(texts[i]) & have) / len(shingles(texts[i]))
                if s >= least - 1e-9 and share >= overlap:
                    out[d, i] = max(out.get((d, i), (0, 0)), (share, s))
            at += size // 2
            if at + size - size // 2 >= len(w):
                break
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "é"] * 30
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(3, 60))) + ".") for i in range(60)] + [(97, ""), (98, None), (None, "a b c d e f")]
    docs = []
    for i in range(80):
        w = text(rng.randint(0, 600))
        for _ in range(rng.randint(0, 2)):
            leak = rng.choice(items[:60])[1].split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in leak] if rng.random() < 0.3 else leak
        docs.append((i, rng.choice([" ", "\n", ", "]).join(w)))
    docs += [(200, None), (201, ""), (5, docs[5][1])]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, overlap int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated_passages(frame, bench).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 20
    for k, (share, s) in want.items():
        assert math.isclose(got[k].overlap, share) and math.isclose(got[k].score, s, rel_tol=1e-9)
    assert contaminated_passages(frame, bench.limit(0)).count() == 0
    assert contaminated_passages(frame.limit(0), bench).count() == 0


def test_by_parts(spark):
    """The question alone suffices, however light its words; short answers and items match as they are."""
    plain = lambda a, b: [f"p{i}" for i in range(a, b)]
    long, short = [f"q{i}" for i in range(40)], [f"s{i}" for i in range(16)]
    light = ["c0", "c1"] * 15 + [f"r{i}" for i in range(10)]  # the answer weighs most
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, "Just three words."), (4, "one"), (5, " ".join(light)), (6, "c0 c1"), (7, None), (8, "")]
    docs = {
        10: plain(0, 50) + long[:30] + plain(50, 90),
        11: plain(0, 50) + long[30:] + plain(50, 90),
        12: plain(0, 50) + long[:20] + plain(50, 90),
        20: plain(0, 200) + short + plain(0, 9),
        21: plain(0, 200) + short[:12] + plain(0, 9),
        22: plain(0, 200) + short[12:] + plain(0, 9),
        30: plain(0, 300) + ["JUST", "three", "words"] + plain(0, 300),
        31: plain(0, 30) + ["three", "just", "words"],
        40: plain(0, 30) + ["one"],
        50: plain(0, 30) + light[:30] + plain(30, 40),
    }
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in contaminated_passages(frame, bench, by_parts=True).collect()}
    assert got == {(10, 1): (1, 0), (20, 2): (1, 1), (21, 2): (1, 0), (30, 3): (1, 1), (40, 4): (1, 1), (50, 5): (1, 0), (50, 6): (1, 1)}


def test_registered_query_decides_by_parts(spark, tmp_path):
    from docweave.llm.queries import op5_bm25_decontamination

    item = [f"q{i}" for i in range(40)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, " ".join(["x", *item[:30], "y"]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.item_id) for r in op5_bm25_decontamination(spark, str(tmp_path)).collect()] == [(10, 1)]
