"""A training corpus from `documents`: each stage calls one operator; its result is written and read by the next.

quality        the classifier's rejected documents go
near copies    of each group of documents with five-word shingle likeness of 0.8 or more, the smallest doc_id stays
passages       passages of 50 words or more that an earlier document has are cut from the text
mixing         documents are taken to their sources' target weights, in whole or in part, up to twice
encoding       token ids of each row

Stages 1 to 4 return the columns of documents.  Rows with a null doc_id or a blank text pass the first three stages if
the classifier accepts them; mixing drops blank texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluicegate.llm import bpe, jaccard, mixing, passages, quality
from sluicegate.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_passages(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("passages", passages_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A fitted classifier, edit alignment and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
