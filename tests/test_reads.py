"""Salvage, alignment and repeats against cases by hand and brute force."""

import json
import math
import random

import pytest
from docweave.operators import reads as R
from pyspark.sql import functions as F


def test_loops_of_one_read(spark):
    rows = ["", None, "[]", "[1", '["| | | |', '["| | | |"]', "[\n" + "| |\n" * 18, "[\n" + "| |\n" * 17 + "x", "```json\n[1]\n```", "```json\n[1\n```", '[' + "\\n| |" * 18 + "x"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: r.x for r in df.select("i", R.is_loop(F.col("raw")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [False, False, False, False, True, False, True, False, False, False, True]
    wide = spark.createDataFrame([("| a | b |\n| c | d |\n| | | | |",), ("| a |\n| |\n| |",), ("| a | b |\n| | c |",)], "raw string")
    assert [r[0] for r in wide.select(R.is_loop_strict(F.col("raw"))).collect()] == [True, True, False]


def test_repeated_words():
    assert R.repeated_words("a b c " * 6) and not R.repeated_words("a b c " * 5)
    assert R.repeated_words("word " * 12) and not R.repeated_words("word " * 11)
    assert R.repeated_words("! " * 24) and not R.repeated_words(". " * 39) and R.repeated_words(". " * 40)
    assert not R.repeated_words(None) and not R.repeated_words("")


def test_cut_off_json():
    whole = [{"bbox_2d": [1, 2, 3, 4], "text_content": 'a "}] b'}, {"bbox_2d": [5, 6, 7, 8], "text_content": "c"}]
    text = json.dumps(whole)
    for cut in range(len(text)):
        closed = R.closed_json(text[:cut])
        ends = [text.index("}, {") + 1, len(text) - 1]
        n = sum(cut >= e for e in ends)
        assert closed == text[:cut] if n == 0 else json.loads(closed) == whole[:n]
    assert R.closed_json("prose") == "prose"


def test_cut_off_table():
    head = '[{"bbox_2d": [1, 2, 3, 4], "text_content": "x"}, {"bbox_2d": [0, 0, 900, 950], "text_content": "'
    assert R.salvaged_table(head + "| a | b |\\n| 1 | 23") == ([0, 0, 900, 950], "| a | b |\n| 1 |")
    assert R.salvaged_table(head + "| a | b |\\n") == ([0, 0, 900, 950], "| a | b |\n")
    assert R.salvaged_table(head + "prose that was cut") is None
    assert R.salvaged_table(head + '| a | b |"') is None and R.salvaged_table(head + '| a | b |"}]') is None
    assert R.salvaged_table('[{"bbox_2d": [0, 0') is None and R.salvaged_table("") is None


def test_fallback_records():
    assert R.fallback_records('[{"bbox_2d": [1, 2, 3, 4], "text_content": " t ", "type": "KV"}, {"bbox": [1.6, 2, 3, 4], "text": "u"}] trailing') == [(2, 1, 4, 3, "t", "kv"), (2, 2, 4, 3, "u", "text")]
    assert R.fallback_records('[{"bbox_2d": [1, 2, 3], "text": "x"}, 7, {"bbox_2d": [1, 2, 3, null], "text": "x"}, {"bbox_2d": [1, 2, 3, 4]}]') == []
    assert R.fallback_records("") == R.fallback_records("{}") == R.fallback_records("[1") == []


@pytest.mark.parametrize("seed", range(20))
def test_clean_tokens_cover_their_values(seed):
    rng = random.Random(seed)
    values = ["".join(rng.choice('ab"\\ né|\n') for _ in range(rng.randint(1, 30))) for _ in range(5)]
    raw = json.dumps([{"text_content": v} for v in values], ensure_ascii=False)
    cuts = sorted({0, len(raw), *(rng.randrange(len(raw)) for _ in range(40))})
    tokens = [(-rng.random(), raw[a:b]) for a, b in zip(cuts, cuts[1:])]
    got, at = R.confidences(raw, tokens, values), 0
    for v, c in zip(values, got, strict=True):
        form = json.dumps(v, ensure_ascii=False)[1:-1]
        s = raw.index(form, at)
        e = at = s + len(form)
        own = [p for (p, t), a, b in zip(tokens, cuts, cuts[1:]) if a < e and b > s]
        assert c[3] == len(own) and math.isclose(c[1], min(own)) and math.isclose(c[0], sum(own) / len(own))


def test_tokens_that_drift():
    raw = '["café"]'
    assert R.token_spans(raw, ['["caf', "�", "�", '"]']) == [(0, 5), (5, 6), (5, 6), (6, 8)]
    assert R.token_spans(raw, ["xx", "yy"]) is None and R.token_spans(raw, []) == []
    assert R.confidences(raw, [(-1.0, "zz")], ["café"]) == [None] and R.confidences("", [], ["a"]) == [None]
    assert R.confidences(raw, [(-1.0, '["caf'), (-0.5, None), (-0.25, '"]')], ["café", "absent"]) == [(-0.75, -1.0, 0.25, 2), None]
