import numpy as np
import pyarrow as pa
from docweave.llm._text import Words, column_bytes
from docweave.llm.toxicity import DIM, Network, Tokens, _steps, toxicity_scores, windows

SF = "/root/testdata/sf0.1"


def test_gradients():
    data, offsets = column_bytes(pa.array(["ab cd, ef gh ij", "xyz ab"]))
    t = Tokens(Words(data, offsets, True))
    net = Network.fresh(np.sort(t.hash), np.unique(t.grams()[0]), 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.concatenate([net.vectors(*net.inputs(t)), np.zeros((1, DIM))])
    first, size, _ = windows(t.bounds, 4)
    index, live = _steps(t.at, first, size, 4, len(x) - 1)
    loss = lambda: float((net.forward(x, index, live)[0] * np.arange(1, len(first) + 1)).sum())
    _, saved = net.forward(x, index, live, True)
    grads, dx = net.backward(x, index, live, saved, np.arange(1.0, len(first) + 1))
    for name, where in (("Uf", (1, 3)), ("Ub", (2, 20)), ("Wf", (0, 9)), ("v", (3,)), ("w", (9,)), ("cb", (5,)), ("b", (0,))):
        net.p[name][where] += 1e-3
        up = loss()
        net.p[name][where] -= 2e-3
        down = loss()
        net.p[name][where] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][where]) < 2e-3 * max(1, abs(grads[name][where])), name
    x[0, 1] += 1e-3
    up = loss()
    x[0, 1] -= 2e-3
    assert abs((up - loss()) / 2e-3 - dx[0, 1]) < 2e-3


def test_windows_cover_everything():
    bounds = np.array([0, 0, 1, 33, 97, 1097])
    first, size, doc = windows(bounds, 32)
    for d in range(5):
        seen = set()
        for f, s in zip(first[doc == d], size[doc == d]):
            seen |= set(range(f, f + s))
        assert seen == set(range(bounds[d], bounds[d + 1])) and (doc == d).any()
    assert size.max() == 32 and size.min() >= 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    pos = got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    hit = got[pos].predicted.mean()
    false = got[~pos].predicted.mean()
    print("AUC", auc, "recall", hit, "false positives", false)
    assert auc > 0.9 and hit > 0.6 and false < 0.03


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "x", 1), (3, "!!! ... " * 2000, 1), (4, "w" * 100_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_text_without_spaces_is_read_whole():
    import numpy as np
    import pyarrow as pa
    from docweave.llm._text import Words, column_bytes
    from docweave.llm.toxicity import PIECE, Tokens, train

    words = lambda *t: Words(*column_bytes(pa.array(t, pa.large_string())), True)
    rng = np.random.default_rng(5)
    for size in (1, 39, 40, 41, 44, 76, 77, 500):
        text = "".join(rng.choice(list("abcdefghij"), size))
        t = Tokens(words("x y", text, "z"))
        assert np.diff(t.begin).max() <= PIECE
        assert t.bounds.tolist()[:2] == [0, 2] and t.bounds[3] - t.bounds[2] == 1
        runs = set(t.grams()[0].tolist())
        pad = set(Tokens(words("zzzzzzzz")).grams()[0].tolist())
        for i in range(size - 4):
            inner = set(Tokens(words(text[i : i + 5] + " zzzzzzzz")).grams()[0].tolist()) - pad
            part = text[i : i + 5]
            assert len(inner & runs) >= len({part[a:b] for a in range(3) for b in range(a + 3, 6)})
    pool = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(60)]
    texts, labels = [], []
    for i in range(300):
        w = list(rng.choice(pool, 12))
        w[6] = "vilezzz" if i % 3 == 0 else w[6]
        texts.append((" " if i % 2 else "_").join(w))
        labels.append(int(i % 3 == 0))
    net = train(texts, labels, [1.0] * len(texts))
    head = "_".join(pool[:8])
    clean, bad = net.scores(words(head + "_" + "_".join(pool[8:14]), head + "_vilezzz_vilezzz_" + "_".join(pool[8:12])))
    assert len(head) > PIECE and bad > clean + 0.2


def test_memory_follows_the_text_and_not_steps_between():
    """Training and scoring take a few times the bytes of the texts; blocks give what the whole gives."""
    import tracemalloc

    from docweave.llm.toxicity import train

    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (60_000, 11), np.uint8)
    vocab = np.array([bytes(w[: 4 + i % 8]).decode() for i, w in enumerate(letters)])
    texts = [" ".join(vocab[rng.integers(0, len(vocab), 1000)]) for _ in range(400)]
    total = sum(map(len, texts))
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    whole = Tokens(Words(data, offsets, True))

    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1] / total
        finally:
            tracemalloc.stop()

    net, taken = peak(lambda: train(texts, [0] * len(texts), [1.0] * len(texts)))
    assert taken < 24
    g, owner = whole.grams()
    assert len(net.grams) > 50_000 and total > 3_000_000
    logits, taken = peak(lambda: net.logits(whole)[0])
    assert taken < 12
    t = Tokens.read(data, offsets)
    assert all(np.array_equal(getattr(t, k), getattr(whole, k)) for k in ("hash", "at", "bounds", "front", "begin", "chars"))
    assert np.array_equal(net.logits(t)[0], logits)
    doc = np.repeat(np.arange(len(texts)), np.diff(whole.bounds))
    df = np.bincount(np.unique(doc * len(whole.hash) + whole.at) % len(whole.hash), minlength=len(whole.hash))
    grams, at = np.unique(g, return_inverse=True)
    assert np.array_equal(net.words, whole.hash[df >= 3])
    assert np.array_equal(net.grams, grams[np.bincount(at, weights=df[owner]) >= 5])
    for empty in ([], [None, ""], ["!!", " "]):
        data, offsets = column_bytes(pa.array(empty, pa.large_string()))
        assert Tokens.read(data, offsets).bounds.tolist() == [0] * (len(empty) + 1)
