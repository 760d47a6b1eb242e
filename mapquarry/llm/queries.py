"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_dedup, decontam, html_text, line_dedup, mixing, quality, shard_tree, simhash, suffix_dedup, token_shards
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixing.mix(table(spark, sf_dir, "documents"))
    return df.select("doc.doc_id", *df.columns[1:])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.quality(table(spark, sf_dir, "documents"), ["doc_id"])
    first = ["doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return df.select(*first, "quality_probability", *[f"v_{k}" for k in quality.RULES])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.simhash(table(spark, sf_dir, "documents"), ["doc_id"])
    return df.select("doc.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_suffix_dedup, op4_substring_dedup, op5_token_output, op6_line_dedup, op7_html_extraction, op8_simhash, op9_decontamination, op10_sharding)}


_OP3 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 1)) AS i FROM h),
win AS (SELECT doc_id, i, CASE WHEN 2 * i + 400 <= len(x) THEN md5_number(substr(x, 2 * i + 1, 400)) END AS k, substr(x, 2 * i + 1, 2) AS byte FROM p),
rep AS (SELECT doc_id, i, byte, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS r FROM win),
cov AS (SELECT doc_id, i, byte, bool_or(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS c FROM rep),
run AS (SELECT *, c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM cov),
got AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (c) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT c) AS kept FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN got USING (doc_id)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
win AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i + 49 <= len(ws) THEN md5_number(array_to_string(ws[i : i + 49], ' ')) END AS k FROM p),
rep AS (SELECT doc_id, i, w, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS r FROM win),
cov AS (SELECT doc_id, i, w, bool_or(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM rep),
got AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (c) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT c) AS kept FROM cov GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN got USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": _OP3, "op4_substring_dedup": _OP4}
