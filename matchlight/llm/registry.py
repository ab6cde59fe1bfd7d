"""The queries of the text operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_tree, chosen_path, fair_mix, host_rules, license_scan, mpeg_audio, pii_boost, registry_sql, run_index, template_tree, token_trie
from .common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_tree.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_trie.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality(documents(spark, sf_dir))


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(documents(spark, sf_dir))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_tree.lines_report(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.features(mpeg_audio.media(documents(spark, sf_dir)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", mpeg_audio.feature_text().alias("feature"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.report(documents(spark, sf_dir))


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.report(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_bpe_round_trip, op3_token_counts, op4_host_rules, op5_fair_mix, op6_line_templates, op7_jaccard_join, op8_media_columns, op9_pii, op10_run_index)}
SQL = {"op4_host_rules": registry_sql.OP4, "op6_line_templates": registry_sql.OP6, "op7_jaccard_join": registry_sql.OP7, "op10_run_index": registry_sql.OP10}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
