"""The pipeline against what its stages must do to planted rows, and each filter against brute force."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from docweave.llm.pii import base_spans
from test_decontamination import brute as leaks
from test_jaccard import brute as classes
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(12)]
    docs, labels = [], []
    for i in range(600):
        w = text(rng.randint(30, 150))
        toxic = i % 4 == 0
        for _ in range(5 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["vilezzz", "nastyqq"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    docs += [(1300, docs[1][1]), (1301, docs[1][1] + " end"), (1302, " ".join(text(40)) + " " + items[3][1] + " " + " ".join(text(10))), (1303, "write to me a.b@c.example.com or +1 (051) 555-0588 " + " ".join(text(60))), (1304, None), (1305, "")]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages(spark, folder):
    path, docs, items = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = stage(spark, now, path)
        assert now.columns == columns
        after = {r.doc_id: r for r in now.collect()}
        seen[name] = (before, after)
        now = spark.createDataFrame(list(after.values()), now.schema)
    before, after = seen["toxicity"]
    bad = {d for d, t in before.items() if t and ("vilezzz" in t or "nastyqq" in t)}
    assert len(bad & after.keys()) <= 0.1 * len(bad) and len((before.keys() - bad) - after.keys()) <= 3
    before, after = seen["ngram_jaccard_join"]
    assert after.keys() == {d for d, n, c in classes(list(before.items()), 5, 80, 100) if c == d}
    assert 1300 not in after and 1301 not in after
    before, after = seen["benchmark_decontamination"]
    assert after.keys() == before.keys() - {d for d, _ in leaks(list(before.items()), items)} and 1302 not in after
    before, after = seen["pii"]
    assert after.keys() == before.keys() and "<email>" in after[1303].text and "<phone>" in after[1303].text
    assert all(not base_spans(r.text or "")[0] for r in after.values()) and after[1304].text is None
    packed = corpus_pipeline.STAGES[-1][1](spark, now, path).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, r in after.items():
        assert packed[packed.doc_id == d].length.sum() == len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).toPandas()
    assert {1304, 1305} <= set(got.doc_id) and not {1300, 1301, 1302} & set(got.doc_id)
    assert np.array_equal(np.sort(got.sequence_id.unique()), np.arange(got.sequence_id.nunique()))


def test_null_and_repeated_ids(spark, folder):
    """Rows are judged by their own text: ids that are null or shared neither spare nor drop a row."""
    path, docs, items = folder
    toxic = next(t for d, t in docs if d % 4 == 0)
    clean = [t for d, t in docs if d in (2, 3, 5, 6, 7)]
    leak = " ".join(clean[4].split()[:20]) + " " + items[5][1]
    mail = "write to a.b@c.example.com " + clean[3]
    rows = [(None, clean[0]), (None, clean[1]), (None, toxic), (2007, toxic), (2007, clean[2]), (2008, leak), (2008, mail), (None, leak), (None, mail + " x.y@z.example.org"), (2009, "nothing here"), (2009, "and p.q@s.example.com"), (2009, None), (2009, ""), (None, None)]
    now = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    labelled = now.union(spark.read.parquet(f"{path}/documents.parquet"))
    assert texts(stages["toxicity"](spark, labelled, path).where("doc_id is null or doc_id >= 2000")) == sorted([r for r in rows if r[1] != toxic], key=str)
    assert texts(stages["benchmark_decontamination"](spark, now, path)) == sorted([r for r in rows if r[1] != leak], key=str)
    got = texts(stages["pii"](spark, now, path))
    assert len(got) == len(rows) and not any("@" in (t or "") for _, t in got)
    assert (2009, "and <email>") in got and (2009, "nothing here") in got and (2009, None) in got
    copies = spark.createDataFrame([*now.collect(), *now.collect(), (3, clean[0], "en", "t", 1)], now.schema)
    got = texts(stages["ngram_jaccard_join"](spark, copies, path))
    words = [t for _, t in got if t]
    assert len(words) == len(set(words)) and (3, clean[0]) in got and (None, clean[0]) not in got
    assert sum(not t for _, t in got) == 6
    assert len(stages["best_fit_packing"](spark, now, path).select("doc_id").collect()) == len(rows)


def test_empty_tables(spark, folder):
    path, _, _ = folder
    now = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, path).count() == 0


def test_columns_of_any_name(spark):
    from docweave.llm.decontamination import drop_contaminated_rows
    from docweave.llm.jaccard import one_of_each_class
    from docweave.llm.pii import mask_pii
    from docweave.llm.toxicity import drop_toxic_rows

    names = ["row", "doc_id", "text", "n", "content", "score", "w_id", "single", "_spans", "a.b"]
    text = "write to a.b@c.example.com about these words"
    docs = spark.createDataFrame([(1, 5, text, 2, 3, 4, 5, 6, 7, 8), (1, 6, text, 2, 3, 4, 5, 6, 7, 8)], names)
    labels, items = spark.createDataFrame([(5, 0)], "doc_id long, toxic int"), spark.createDataFrame([(1, "some other words")], "item_id long, text string")
    for got, n in ((drop_toxic_rows(docs, labels), 2), (one_of_each_class(docs), 1), (drop_contaminated_rows(docs, items), 2), (mask_pii(docs), 2)):
        rows = got.collect()
        assert got.columns == names and len(rows) == n and rows[0]["a.b"] == 8 and rows[0]["row"] == 1
    assert mask_pii(docs).first()["text"] == "write to <email> about these words"
