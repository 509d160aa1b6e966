"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from riskloom.llm import (bpe, collocations, embedding_dedup, exact_dedup, line_dedup, mixing, ngram_join, quality,
                          resampling, secret_scan, sharding, substring_dedup, toxicity)
from riskloom.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed passage; documents without one are not listed."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_byte_bpe, op3_mix_sources, op4_line_dedup, op5_quality, op6_secret_scan, op7_exact_dedup,
    op8_substring_dedup, op9_toxicity, op10_embedding_dedup, op11_sharding, op12_collocations,
    op13_resampling, pipeline)}

SQL = {"op4_line_dedup": line_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op11_sharding": sharding.sql(),
       "op12_collocations": collocations.SQL, "op13_resampling": resampling.SQL}
