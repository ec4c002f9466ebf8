"""Plans and functions whose cost follows the input: joins on keys, few rows between tasks, small batches."""

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_meet_by_signatures(spark):
    from docweave.operators.records import dedup_records

    rows = [(1, k, "same name", "m") for k in range(50)] + [(1, 60, "same name x", None), (2, 1, "longname", None), (2, 2, "longname", "m"), (2, 2, None, None), (2, 3, "my longname", None), (None, 4, "longname", None), (3, None, "a", None), (3, 5, "a", "b")]
    got = dedup_records(spark.createDataFrame(rows, "g int, o long, n string, m string"), "g", "o", ["n", "m"])
    assert any("LeftSemi" in line and "_f0" in line and "_f1" in line for line in plan(got).split("\n"))
    assert sorted((r.g or 0, r.o or -1) for r in got.collect()) == [(0, 4), (1, -1), (1, 60), (2, 3), (3, -1), (3, 5)]


def test_only_known_runs_go_on(spark):
    from docweave.operators.records import value_occurrences

    values = spark.createDataFrame([(1, "b c d e f g"), (2, "one two"), (3, "a b c d e f")], "value_id long, value string")
    texts = spark.createDataFrame([(1, "ab c d e f gh"), (2, "no one two"), (3, "a b c  d e f"), (4, "x c d e f y"), (5, None)], "text_id long, text string")
    got = value_occurrences(values, texts)
    assert "LeftSemi" in plan(got) and "xxhash64" in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2)]


def test_texts_meet_whole(spark):
    from docweave.operators.agree import multiset_f1, text_f1
    from docweave.operators.reads import layers_match, text_layer_matches

    a = spark.createDataFrame([(1, "x y x 1"), (2, ""), (3, None), (4, "p q"), (4, "q  r"), (None, "x"), (6, "n")], "id long, text string")
    b = spark.createDataFrame([(1, "x x z 1 1"), (2, ""), (4, "q r"), (4, " q"), (5, "x"), (6, "m")], "id long, text string")
    pairs = spark.createDataFrame([(k, k) for k in (1, 2, 3, 4, 5, 6, 7)] + [(1, 4), (4, 1), (None, None), (1, 1)], "a long, b long")
    tokens = lambda x: x.select("id", F.explode(F.split("text", " ")).alias("token"))
    key = lambda r: repr(tuple(r))
    got = text_f1(a, b, pairs)
    assert "Generate explode" not in plan(got)
    assert sorted(map(tuple, got.distinct().collect()), key=key) == sorted(map(tuple, multiset_f1(tokens(a), tokens(b), pairs.distinct()).collect()), key=key)
    rows = a.selectExpr("id", "text a", "concat(text, ' 2') b").union(b.selectExpr("id + 10", "concat(text, ' 3')", "text"))
    want = text_layer_matches(rows.select("id", F.lit("a").alias("side"), F.explode(F.split("a", " ")).alias("token")).union(rows.select("id", F.lit("b").alias("side"), F.explode(F.split("b", " ")).alias("token"))))
    got = layers_match(rows)
    assert "Generate explode" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_token_f1_and_layers_have_no_row_a_token(spark):
    from docweave.queries import collect

    for name in ("token_f1_pairs", "layer_matches"):
        assert "Generate explode" not in plan(collect()[0][name](spark, "/root/testdata/sf0.001")), name


def test_coverage_of_boxes(spark):
    from docweave.operators.pages import box_coverage, coverage

    boxes = [("p", 0, 0, 70, 3), ("p", 50, 2, 130, 9), ("p", 59, 20, 60, 20), ("q", -3, -2, 2, 1), ("q", 5, 4, 3, 2), ("r", 1, 1, None, 2), (None, 1, 1, 2, 2)]
    ink = spark.createDataFrame(boxes, "page_id string, gx0 int, gy0 int, gx1 int, gy1 int")
    covers = spark.createDataFrame([("p", 10, 1, 62, 2), ("q", 0, 0, 0, 0), ("r", 0, 0, 1, 1), (None, 1, 1, 2, 2)], ink.schema)
    cells = ink.selectExpr("page_id", "explode(sequence(gx0, gx1)) gx", "gy0", "gy1").selectExpr("page_id", "gx", "explode(sequence(gy0, gy1)) gy").distinct()
    got = sorted(map(tuple, box_coverage(ink, covers).collect()), key=repr)
    assert got == sorted(map(tuple, coverage(cells, covers).collect()), key=repr) and len(got) == 3


def test_confidence_of_long_reads(spark, monkeypatch):
    """A value looks at its own tokens only."""
    import math

    from docweave.operators import reads as R

    raw, values = "[" + ", ".join(f'"value {k} é"' for k in range(4000)) + "]", [f"value {k} é" for k in range(4000)]
    tokens = [(-(k % 7) / 10, raw[5 * k : 5 * k + 5]) for k in range(len(raw) // 5 + 1)]

    class Counted(list):
        steps = 0

        def __iter__(self):
            for x in super().__iter__():
                Counted.steps += 1
                yield x

    got = R.confidences(raw, Counted(tokens), values)
    assert len(got) == 4000 and None not in got and Counted.steps < 10 * len(tokens)
    odd = [None, "", raw[:3], "�", raw[9:20]]
    rows = [(raw, tokens, values), (raw, [(-0.1 * k, t) for k, t in enumerate(odd)], values[:3]), ("", [], ["a"]), (None, None, None), ("ab", [(-1.0, "ab"), (-2.0, "c")], ["b", "x"])]
    df = spark.createDataFrame(rows, "raw string, tokens array<struct<logprob:double,token:string>>, values array<string>")
    for r, (raw_, ts, vs) in zip(R.with_confidences(df).collect(), rows, strict=True):
        assert r.confidence == [None if x is None else math.exp(x[1]) for x in R.confidences(raw_ or "", ts or [], vs or [])]


def test_tokens_are_cut_once(spark):
    from docweave.queries import collect

    assert "substring(" not in plan(collect()[0]["token_confidences"](spark, "/root/testdata/sf0.001"))


def test_batches_are_small(spark):
    from docweave.queries import collect

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    collect()[0]["read_suspicions"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) <= 1000
    spark.conf.set(key, before)


def test_numbers_are_counted_before_they_are_written(spark, tmp_path):
    from docweave.queries import collect

    spark.createDataFrame([(1.5, -0.0, 0.0, 1), (1.5, 0.0, None, 1), (None, 2.0, 0.05, 2), (1234567.891, 2.0, 0.1, None)], "l_extendedprice double, l_quantity double, l_tax double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = collect()[0]["currency_cents"](spark, str(tmp_path))
    lines = plan(got).split("\n")
    assert max(k for k, x in enumerate(lines) if "printf" in x or "format_string" in x) < max(k for k, x in enumerate(lines) if "Aggregate" in x)
    assert {r.cents: r.n for r in got.collect()} == {150: 4, -150: 2, 123456789: 2, -123456789: 1, 0: 1, -200: 2}


def test_documents_go_to_python_together(spark):
    """No call for each document, which costs more than most documents' work."""
    from docweave.queries import collect

    for name in ("segments", "segment_counters", "word_fragments", "context_batches", "table_boundaries", "table_counters", "assembled_tables"):
        assert "FlatMapGroupsInArrow" not in plan(collect()[0][name](spark, "/root/testdata/sf0.001")), name


def test_absorbed_looks_back_one_group():
    from docweave.operators.segmentation import Element, Group, Unit, absorbed

    asked = []
    groups = [Group([Unit([Element(k, 1, "text", "x" * (100 if k < 500 else 1))])], "start") for k in range(1000)]

    def choose(now, k):
        asked.append(k)
        return k - 1 if k > 500 and len(now[k].text) == 1 and len(now) > 502 else None

    assert len(absorbed(groups, choose)) == 502 and len(asked) < 3000
