import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from docweave.llm.katz import CUTOFF, TURNS, Block, Hot, Model, _grams, _pack, _unique, _unpack, discounts, score_texts


def brute(rows, check=False):
    """The model from its definition: texts with an end, a first word after the end, triples within a text."""
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
    out_ = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    texts = [(d, tokens(t)) for d, t in rows]
    train = [t for d, t in texts if not out_(d)]
    c = Counter(w for t in train for w in t)
    total, types, unseen = sum(c.values()), len(c), max(1, sum(v == 1 for v in c.values()))
    uni = lambda w: (c[w] or unseen) / (total + unseen)
    pairs = Counter((h, w) for t in train for h, w in zip([None, *t], t))
    triples = Counter(((u, v), w) for t in train for u, v, w in zip([None, *t], t, t[1:]))

    def order(grams, lower):
        disc = discounts({r: sum(v == r for v in grams.values()) for r in range(1, CUTOFF + 2)})
        context, after = Counter(), {}
        for (h, w), n in grams.items():
            context[h] += n
            after.setdefault(h, []).append(w)
        alpha, few = {}, {h for (h, _), n in grams.items() if n <= CUTOFF and disc[n] < 1}

        def seen(h, w):
            n = grams[h, w]
            # a context without discounted n-grams has one count more, which it leaves to other words
            return (disc[n] if n <= CUTOFF else 1) * n / (context[h] + (h not in few))

        for h, ws in after.items():
            alpha[h] = (1 - sum(seen(h, w) for w in ws)) / (1 - sum(lower(h, w) for w in ws))

        def p(h, w):
            return lower(h, w) if h not in after else seen(h, w) if grams[h, w] else alpha[h] * lower(h, w)

        if check:
            for h in list(after)[:200]:
                assert math.isclose(sum(p(h, w) for w in [*c, b"never seen"]), 1, rel_tol=1e-9)
        return p

    p2 = order(pairs, lambda h, w: uni(w))
    p3 = order(triples, lambda h, w: p2(h[1], w))
    res = []
    for d, t in texts:
        s = math.log10(p2(None, t[0])) + sum(math.log10(p3((u, v), w)) for u, v, w in zip([None, *t], t, t[1:]))
        res.append((d, out_(d), len(t), sum(c[w] > 0 for w in t), total, sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t), s))
    return res


@pytest.mark.parametrize("block_tokens", [300, 1 << 19])
def test_against_brute_force(spark, block_tokens):
    rng = random.Random(3)
    vocab = ["The", "the", "a", "é", "É", "x."] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) if rng.random() < 0.4 else vocab[min(int(rng.expovariate(0.3)), 60)] for _ in range(rng.randint(0, 40))) + ("\n" if i % 2 else "")) for i in range(120)]
    rows += [(700, None), (701, ""), (None, "a the a"), rows[3], rows[3], (800, "the a " * 400)]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    got = score_texts(docs, block_tokens=block_tokens).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, b in zip(sorted(got, key=key), sorted(brute(rows, True), key=key), strict=True):
        assert tuple(g)[:5] == b[:5]
        assert math.isclose(g.base_score, b[5], rel_tol=1e-9) and math.isclose(g.score, b[6], rel_tol=1e-9), (g, b)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(docs).count() == 0
    alone = [d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2][:1]
    r = score_texts(spark.createDataFrame([(alone[0], "a b")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].train_tokens == 0 and math.isfinite(r[0].score)


def test_more_words_than_65536(spark):
    """Each of more than 65,536 training words keeps its own probability; only words never seen share one."""
    is_out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [(10_000 + i, [f"r{i}_{j}" for j in range(1000)]) for i in range(100)] + [(20_000 + i, ["thrice", "twice"]) for i in range(5)]
    train = [(d, t) for d, t in train if not is_out(d)]
    a, b = train[0][1][5], train[1][1][7]
    held = [(d, t) for d, t in zip([d for d in range(100) if is_out(d)], [[a, "thrice"], [a, b], ["never", "thrice"], ["thrice", "never"]], strict=False)]
    c = Counter(w for _, t in train for w in [*t, None])
    assert len(c) > 1 << 16
    rows = [(d, " ".join(t)) for d, t in train + held]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(docs).collect()}
    for d, *_, s in brute(rows):
        assert math.isclose(got[d], s, rel_tol=1e-9), d


def test_contexts_without_rare_pairs(spark):
    """Where all pairs of a word are frequent, words not seen after it still have a share."""
    is_out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [(d, "a b") for d in range(100) if not is_out(d)][:20] + [(1000 + i, f"c{i}") for i in range(30) if not is_out(1000 + i)]
    held = [next(d for d in range(2000, 3000) if is_out(d))]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(train + [(held[0], "a a")], "doc_id long, text string")).collect()}
    want = {d: s for d, *_, s in brute(train + [(held[0], "a a")])}
    assert math.isfinite(got[held[0]]) and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in got)


@pytest.mark.parametrize("n, contexts, words", [(0, 1, 1), (1, 1, 1), (5000, 1, 1 << 20), (5000, 300, 20), (5000, 300, 1 << 32), (5000, 1 << 32, 1 << 32)])
def test_distinct_grams(n, contexts, words):
    """Whether or not context, word and place fit in 64 bits."""
    rng = np.random.default_rng(n)
    context, word = rng.integers(0, contexts, n), rng.integers(0, words, n)
    context[n // 2 :], word[n // 2 :] = context[: n - n // 2], word[: n - n // 2]
    c, w, where, at = _grams(context, word)
    want = sorted(set(zip(context.tolist(), word.tolist(), strict=True)))
    assert list(zip(c.tolist(), w.tolist(), strict=True)) == want
    assert (c[at] == context).all() and (w[at] == word).all()
    assert (context[where] == c).all() and (word[where] == w).all()


def test_distinct_grams_are_cheap():
    """N-grams of a block take less than half the time of np.unique with places and inverse."""
    rng = np.random.default_rng(5)
    x = rng.zipf(1.3, 1 << 19).astype(np.uint64) % np.uint64(200_000) << np.uint64(20) | rng.zipf(1.3, 1 << 19).astype(np.uint64) % np.uint64(100_000)

    def seconds(f):
        times = []
        for _ in range(4):
            at = time.process_time()
            f()
            times.append(time.process_time() - at)
        return min(times)

    assert (_unique(x)[0] == np.unique(x)).all()
    assert seconds(lambda: _unique(x)) < 0.5 * seconds(lambda: np.unique(x, return_index=True, return_inverse=True))


def test_messages_read_back():
    rng = np.random.default_rng(6)
    arrays = [rng.integers(0, 1 << b, 1000, np.int64) for b in (1, 8, 9, 16, 17, 32, 33, 60)] + [rng.integers(0, 1 << 63, 7, np.uint64), np.arange(-5, 5), np.zeros(0, np.int64)]
    for a, b in zip(arrays, _unpack(_pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_a_turn_takes_its_own_triples():
    """What is sorted in a turn is asked in it, and all turns ask what one alone would, hot contexts and words never seen included."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 60, 100)
    local = np.minimum(rng.zipf(1.5, int(sizes.sum())) - 1, 299)
    number = np.append(rng.permutation(np.arange(1, 300)), 0)
    body = _pack(np.arange(100, dtype=np.uint64), np.zeros(100, np.uint8), sizes, local)
    uni = [{"bucket": 0, "told": _pack(np.where(number > 0, 5, 0), number)}]
    top = int(number[0])
    model = Model(9000, 299, 1, [Hot(np.array([top])), Hot(np.array([top << 32 | top]))], [np.ones(CUTOFF + 1)] * 2)

    def asks(turn):
        b = Block(body, uni, model, (5, 6))
        c2 = _pack(np.where(np.arange(len(b.pairs.word)) % 3, 2, 0))
        b.hear_triples([{"bucket": 0, "told": len(c2).to_bytes(8, "little") + c2}], turn)
        return len(b.positions), b.triples.asks(1, b.seen(b.triples, b.positions, 7, 2), b.c2[b.pairs.at[b.positions[b.triples.where]]])

    whole, parts = asks(None), [asks(t) for t in range(TURNS)]
    assert all(0 < n < whole[0] for n, _ in parts) and sum(n for n, _ in parts) == whole[0]
    assert sorted(row for _, rows in parts for row in rows) == whole[1]
