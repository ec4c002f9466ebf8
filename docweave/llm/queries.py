"""One query per operator, with production parameters over whole tables, and its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark, sf_dir):
    from docweave.llm.substrings import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"), length=50).drop("removed")


def op2_wavelet_tokens(spark, sf_dir):
    from docweave.llm.wavelet import read_token_shards, write_token_shards

    return read_token_shards(write_token_shards(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2))


def op3_randomness_secrets(spark, sf_dir):
    from docweave.llm.secrets import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op4_bigru_toxicity(spark, sf_dir):
    from docweave.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bm25_decontamination(spark, sf_dir):
    from docweave.llm.decontamination import contaminated_passages

    return contaminated_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), by_parts=True)


def op6_token_group_join(spark, sf_dir):
    from docweave.llm.jaccard import similarity_classes

    return similarity_classes(_table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op7_decision_list_quality(spark, sf_dir):
    from docweave.llm.quality import quality_verdicts

    found = quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_weak_pii(spark, sf_dir):
    from docweave.llm.pii import KINDS, find_pii
    from docweave.llm.secrets import digest

    return digest(find_pii(_table(spark, sf_dir, "documents")), KINDS)


def op9_katz_backoff(spark, sf_dir):
    from docweave.llm.katz import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), folds=7, fold=2)


def op10_config_lp_packing(spark, sf_dir):
    from docweave.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_wavelet_tokens, op3_randomness_secrets, op4_bigru_toxicity, op5_bm25_decontamination, op6_token_group_join, op7_decision_list_quality, op8_weak_pii, op9_katz_backoff, op10_config_lp_packing)}
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From the definitions, over whole tables: every window of 50 words, and every pair of documents that share a shingle.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} ws FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM w WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) least FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) j FROM f WHERE least < doc_id),
u AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) j FROM w),
k AS (SELECT u.doc_id, count(*) n_words, count(g.j) n_removed, string_agg(word, ' ' ORDER BY u.j) FILTER (g.j IS NULL) kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.j = u.j GROUP BY u.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op6_token_group_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id reached FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(reached) component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id""",
}
