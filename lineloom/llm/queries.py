"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontam, language, line_dedup, near_dup, pii, quality, resampling, secrets, subwords, token_counts, toxicity, urls
from .common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.secret_scan(docs), ["assign", "access", "hex"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr(
        "doc_id", "cast(n_lines as bigint) as n_lines", "cast(n_removed as bigint) as n_removed", "sha2(coalesce(text, ''), 256) as kept_sha256"
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, urls.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(pii.personal_data(docs), pii.BASE_KINDS)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return out.selectExpr("doc_id", "contaminated", "transform(matches, m -> m.item_id) as item_ids", "coalesce(try_element_at(matches, 1).ratio, 0D) as best_ratio")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.selectExpr("doc_id", "held_out", "score", "predicted", "cast(size(sentences) as bigint) as n_offending")


def op10_sampled_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = subwords.encode_and_sample(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return out.selectExpr(
        "doc_id",
        "n_pieces",
        "ids",
        "ids_hash",
        "round_trip",
        "samples.hash as sample_hashes",
        "samples.ids as sample_ids",
        "samples.pieces as sample_pieces",
        "samples.log_inclusion as log_inclusion",
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_url_filter, op4_token_counts, op5_personal_data, op6_jaccard_join, op7_quality_rules, op8_decontamination, op9_toxicity, op10_sampled_subwords, op11_importance_resampling, op12_token_alignment, op13_language_id)
}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE, "op3_url_filter": urls.ORACLE, "op7_quality_rules": quality.ORACLE, "op11_importance_resampling": resampling.ORACLE}

