"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from umbraframe.llm import bpe_transducer, exact_dedup, mixing, near_dedup, quality_pu
from umbraframe.llm.common import scratch, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    model, _ = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return quality_pu.keep_quality(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the document with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each document of the mix."""
    return bpe_transducer.encode_documents(docs, bpe_transducer.tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-dedup", near), ("mixing", mix), ("BPE encoding", encode)]

#: The first stage fits a model and the third samples by hashes that SQL lacks, so no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # a stage's own tables go once its rows are written
            stage(spark, docs, sf_dir).write.parquet(f"{out}/{i}")
        docs = spark.read.parquet(f"{out}/{i}")
    return docs
