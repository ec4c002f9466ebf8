import zlib

import numpy as np
import public_tokenizers
import pytest
from docweave.llm._tokens import Encoder
from docweave.llm.packing import fewest, pack, solve_configurations
from tokenizers import Tokenizer

ODD = ["", "a  b", " a", "a ", "a\n b", "a \n b", "x   y", "it's DON'T 'll", "Ünï çé ß µ", "日本 語", "a\x1cb c", "<|endoftext|> x", "tab\t\tz \n\n  q", "1234 5,6.7", "  nbsp", "İ", "word " * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    path = public_tokenizers.path(name)
    plain, encoder = Tokenizer.from_file(path), Encoder(path, pieces=50)
    for text in ODD:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.ids(None) == b""


def best_fit(histogram, capacity):
    """The number of sequences by best fit decreasing, piece by piece."""
    rooms = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        at = min((i for i, r in enumerate(rooms) if r >= length), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(capacity - length)
        else:
            rooms[at] -= length
    return len(rooms)


def optimum(pieces, capacity):
    """The fewest sequences, by trying all."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[i]}):
            at = rooms.index(room)
            place(i + 1, [*rooms[:at], room - pieces[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def held(plan, capacity):
    got = {}
    for uses, pattern in zip(plan.uses, plan.patterns):
        assert uses > 0 and sum(k * n for k, n in pattern.items()) <= capacity
        for k, n in pattern.items():
            got[k] = got.get(k, 0) + uses * n
    return got


def test_configurations_hold_exactly_the_histogram():
    rng = np.random.default_rng(1)
    for most in (1, 40, 4000):
        histogram = {int(k): int(v) for k, v in zip(rng.choice(2048, 300, replace=False) + 1, rng.integers(1, most + 1, 300))}
        plan = solve_configurations(histogram, 2048)
        assert held(plan, 2048) == histogram
        # the program's value is the sum of its columns' uses; whole uses add less than a column each
        assert plan.bound <= plan.sequences <= plan.program + 300
        if most <= 40:
            assert plan.sequences <= 1.01 * best_fit(histogram, 2048)
    # nearly all sequences follow columns of the program, not what rounding leaves
    assert plan.rounded >= 0.99 * plan.sequences and plan.sequences <= 1.01 * plan.bound
    assert solve_configurations({}, 2048).sequences == 0
    assert solve_configurations({2048: 3, 1: 1}, 2048).sequences == 4


def test_near_the_optimum():
    rng = np.random.default_rng(3)
    over = 0
    for _ in range(40):
        pieces = sorted((int(x) for x in rng.integers(1, 31, rng.integers(1, 11))), reverse=True)
        histogram = {k: pieces.count(k) for k in set(pieces)}
        plan, least = solve_configurations(histogram, 30), optimum(pieces, 30)
        lengths = np.array(sorted(histogram))
        assert fewest(lengths, np.array([histogram[int(k)] for k in lengths]), 30)[0] == plan.bound <= least <= plan.sequences <= least + 1
        over += plan.sequences > least
    assert over <= 4


def test_pack(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t, 7) for i, t in enumerate([None, *ODD, "same text", "same text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack(docs, path).toPandas()
    plain = Tokenizer.from_file(path)
    for i, text, _ in rows:
        ids = [*(plain.encode(text, add_special_tokens=False).ids if text else []), 0]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 2048).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert pack(docs.limit(0), path).count() == 0
