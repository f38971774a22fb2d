"""The queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from volumetra.llm.common import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.licenses import scan

    return scan(documents(spark, sf_dir, "doc_id", "text"))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from volumetra.llm.lines import dedup_lines

    out = dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.langid import cross_parse

    return cross_parse(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op4_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.pii import find

    return find(documents(spark, sf_dir, "doc_id", "text"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.flac import describe, encode_column

    out = describe(encode_column(documents(spark, sf_dir, "doc_id", "text")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from volumetra.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.passages import dedup_passages

    return dedup_passages(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("kept", "kept_sha256")


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from volumetra.llm.bpe import digests

    return digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volumetra.llm.quality import quality

    out = quality(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_fuzzy_lines": op2_fuzzy_lines,
        "op3_cross_parsing": op3_cross_parsing,
        "op4_sanitisation": op4_sanitisation,
        "op5_flac_media": op5_flac_media,
        "op6_slack_packing": op6_slack_packing,
        "op7_minhash_neardup": op7_minhash_neardup,
        "op8_fingerprint_index": op8_fingerprint_index,
        "op9_tree_bpe": op9_tree_bpe,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    from volumetra.llm.oracles import ORACLES

    return dict(ORACLES)
