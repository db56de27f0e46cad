"""Text corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, subword encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet in the shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm import decontam, line_dedup, near_dup, quality, subwords
from lineloom.llm.common import read_table, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the document rules and the host verdicts keep; rows equal in id and text are judged by their own hosts.

    Null, empty and short texts go, a null host is a host like any other,
    repeated rows stay or go together, an empty table stays empty; only the
    columns of documents count.
    """
    rows = docs.select(COLUMNS).withColumn("_rk", F.xxhash64("doc_id", "text"))
    facts = quality.quality_rules(rows, keep_cols=["doc_id", "_rk", "source"])
    kept = facts.where("kept").select(F.col("doc_id").alias("_id"), F.col("_rk").alias("_k"), F.col("source").alias("_host")).distinct()
    same = (F.col("_rk") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_host"))
    return rows.join(kept, same, "left_semi").select(COLUMNS)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; documents that lose every line go, those that had none stay."""
    out = line_dedup.line_dedup(docs.select(COLUMNS))
    return out.where("n_removed = 0 or n_removed < n_lines").withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of smallest id (null last), then of smallest text hash, lang, source and n_chars.

    Rows without words have no copies: all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(COLUMNS).withColumn("_row", key)
    found = near_dup.near_duplicates(rows, id_col="_row").where(F.col("_row").eqNullSafe(F.col("component_id")))
    first = found.groupBy(F.col("_row").alias("_first")).agg((F.max("n_shingles") > 0).alias("_words"))
    order = Window.partitionBy("_row").orderBy("lang", "source", "n_chars")
    kept = rows.join(first, F.col("_row").eqNullSafe(F.col("_first"))).withColumn("_n", F.row_number().over(order))
    return kept.where("_n = 1 or not _words").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items.

    Null and empty texts hold none and stay, as do all rows where the benchmark
    is empty; null ids and repeated rows are judged by their texts.
    """
    return decontam.decontaminate(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def subword_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text and of two sampled segmentations with their scores, a row for each row; null and empty texts have no pieces."""
    out = subwords.encode_and_sample(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return out.selectExpr(
        "doc_id", "n_pieces", "ids", "ids_hash", "round_trip",
        "samples.ids as sample_ids", "samples.hash as sample_hashes", "samples.log_inclusion as log_inclusion",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_runs),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("subword_encoding", subword_encoding),
]

#: Subword merging and latent retrieval have no SQL form; single stages and operators have tests, ``run`` has none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
