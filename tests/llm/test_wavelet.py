import zlib

import numpy as np
import public_tokenizers
import pytest
from docweave.llm.wavelet import WaveletMatrix, read_shard, read_token_shards, write_shard, write_token_shards
from tokenizers import Tokenizer


@pytest.mark.parametrize("n", [0, 1, 63, 512, 5000])
def test_matrix(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 300, n).astype(np.uint16)
    ids, lengths, m = read_shard(write_shard([5, None], [n, 0], values, 16))
    assert ids == [5, None] and lengths.tolist() == [n, 0]
    assert (m.values() == values).all()
    if n:
        at = rng.integers(0, n, 50)
        assert (m.access(at) == values[at]).all()
        for v in (int(values[0]), 17, 299, 65535):
            where = np.flatnonzero(values == v)
            assert m.count(v) == len(where) and (m.occurrences(v) == where).all()
            assert m.count(v, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
    with pytest.raises(IndexError):
        m.select(301, [0])
    assert isinstance(WaveletMatrix.build(values, 16), WaveletMatrix)


def test_shards(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "One two THREE", "one two three", "x " * 500, "one two three"]
    rows = [(10 * i % 7 + i, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = read_token_shards(write_token_shards(docs, path, 2, shard_tokens=100, partitions=3)).orderBy("start").collect()
    plain, at = Tokenizer.from_file(path), 0
    for r, (doc, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert read_token_shards(write_token_shards(docs.limit(0), path, 2)).count() == 0
    with pytest.raises(Exception, match="doesn't fit into 8 bits"):
        write_token_shards(docs, path, 2, bits=8)
