"""The named queries over ``documents``, one for each operator, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id, ngram_trie, packing, quality_classifier, quality_rules, scaled_sketch, simhash, suffix_dedup, token_files
from .common import crc_mod, documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_counts(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ngram_trie.score(docs, ngram_trie.train(docs))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, freq = token_files.write_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, folder, freq)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_and_decode(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_mod(F.col("doc_id"), 5)
    found = language_id.predict(docs, language_id.learn(docs, fold != 0))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.sketch_and_edits(documents(spark, sf_dir), share=scaled_sketch.QUERY_SHARE)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_mod(F.col("doc_id"), 5)
    model = quality_classifier.learn(docs, documents(spark, sf_dir, "labels"), fold != 0)
    found = quality_classifier.predict(docs, model)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_token_id_files, op4_byte_bpe, op5_language_id, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_document_fingerprints, op9_quality_classifier, op10_best_fit_packing)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM w)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM dup, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
c AS (SELECT w.doc_id, t, ws, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \t-\r]+', '', 'g') <> '')) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \t-\r]+', '', 'g') <> ''))))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * (len(regexp_extract_all(t, chr(10))) + 1)
    OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 14) OR 10 * len(regexp_extract_all(t, '\p{Lu}')) > 4 * len(regexp_extract_all(t, '\p{L}'))
    OR 10 * len(regexp_extract_all(t, '[!?]')) > 2 * n_words OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 7 * greatest(n_words, 1)) AS kept
FROM v
"""


def oracle_sql() -> dict:
    return {"op1_quality_rules": OP1_SQL}
