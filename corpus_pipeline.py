"""The corpus pipeline: documents from raw to token ids, one dealt operator per stage.

Each stage is (name, function of (spark, docs, sf_dir)) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from riskloom.llm.common import table
from riskloom.llm.labelled import fold
from riskloom.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model (learnt outside its held-out fold) does not reject."""
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality.with_score(docs, model, "__score").where("__score >= 0.5").select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key is in ten or more documents go, and documents left without any character.

    Copied text is no boilerplate: its earliest occurrence stays, so one of any number of copies goes on.
    """
    return line_dedup.drop_lines(docs, rule="boilerplate", min_docs=10)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by n-gram Jaccard similarity (five words, 0.8 or more); documents without words stay."""
    return ngram_join.keep_one_per_component(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the sources' target weights, as up to three copies of each document."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of their decoding."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("line_dedup", without_common_lines), ("ngram_join", one_of_each_group),
          ("mix", mixed), ("bpe", token_ids)]

ORACLE_SQL = None  # a learnt filter comes first


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between them in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, os.path.join("pipeline", uuid.uuid4().hex))
    for i, (name, stage) in enumerate(STAGES):
        path = os.path.join(base, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
