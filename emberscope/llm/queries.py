"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from emberscope.llm import (
    decontaminate, importance, line_crf, mixing, near_dedup, packing, quality, role_repair, secret_scan, structure_repair, substring_dedup,
    token_counts, token_files,
)
from emberscope.llm.registry import LLM_QUERIES, LLM_SQL, query, table

__all__ = ["LLM_QUERIES", "LLM_SQL"]

QUALITY_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    GROUP BY doc_id
), positions AS (
    SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d
), grams AS (
    SELECT doc_id, k, p, words[p : p + k - 1] AS gram FROM positions, (VALUES (3), (8)) AS v(k)
    WHERE p + k - 1 <= len(words)
), twice AS (
    SELECT doc_id, k, unnest(list(p)) AS p FROM grams GROUP BY doc_id, k, gram HAVING count(*) > 1
), spans AS (
    SELECT doc_id, k, p, lead(p) OVER (PARTITION BY doc_id, k ORDER BY p) AS q FROM twice
), covers AS (
    SELECT doc_id, sum(least(k, coalesce(q - p, k))) FILTER (k = 3) AS repeated,
           sum(least(k, coalesce(q - p, k))) FILTER (k = 8) AS covered
    FROM spans GROUP BY doc_id
), long_runs AS (
    SELECT DISTINCT doc_id FROM (
        SELECT doc_id FROM positions WHERE p + 400 <= len(words)
        GROUP BY doc_id, array_to_string(words[p : p + 400], ' ') HAVING count(*) > 1
    )
), measured AS (
    SELECT d.doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(repeated, 0)::BIGINT AS n_repeat_words,
           coalesce(covered, 0)::BIGINT AS covered_words,
           long_runs.doc_id IS NOT NULL AS too_long
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covers USING (doc_id) LEFT JOIN long_runs ON long_runs.doc_id = d.doc_id
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, covered_words,
       NOT base_failed AND NOT too_long AND 100 * covered_words <= 40 * n_words AS kept
FROM judged
"""


@query("op2_suffix_array_quality", QUALITY_SQL)
def op2(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query("op9_arrow_token_files")
def op9(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_line_crf_quality")
def op10(spark, sf_dir):
    return line_crf.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_bm25_wand_decontamination")
def op8(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_block_anchor_dedup")
def op3(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_circulant_minhash_dedup")
def op5(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.SIMILARITY)


@query("op6_splitting_tree_mix")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).alias("taken"))


@query("op1_trie_token_counts")
def op1(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_markov_secret_scan")
def op4(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


@query("op7_role_repair_format")
def op7(spark, sf_dir):
    return role_repair.repair(table(spark, sf_dir, "conversations")).drop("position")


@query("op11_crc_importance_resampling")
def op11(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_residual_best_fit_packing")
def op12(spark, sf_dir):
    return packing.placements(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op13_suffix_automaton_repair")
def op13(spark, sf_dir):
    return structure_repair.repair(table(spark, sf_dir, "conversations"), damaged=True)
