"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.blocks import set_aside
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.minhash import one_of_each_group
from tidemark.llm.mixing import ADDED, replicated
from tidemark.llm.queries import table
from tidemark.llm.sharding import sharded
from tidemark.llm.toxicity import without_toxic
from tidemark.operators.stage import checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the limit.

    Null and empty texts have the score of the bias alone; equal texts go or stay together; an
    empty table stays empty, and without labels nothing goes.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, 0.8): the smallest id.

    Rows are chosen, not ids: repeated rows, texts under one id and null ids are told apart.
    """
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage; contaminated ones go.

    Null and empty texts hold none and stay, and so does every document where the benchmark is
    empty; repeated rows are judged alike.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies at tempered source weights, in globally shuffled order.

    Null sources are one source; null ids are drawn alike, as are equal ids of a source; null
    texts are copied like any other; an empty table stays empty.
    """
    own, restore = set_aside(docs, ADDED)
    return restore(replicated(own))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture with their shard and slot.

    Every row gets one place, null ids, null texts and repeated rows included; null sources are
    one source. An empty table stays empty.
    """
    return sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A learned filter and MinHash groups have no SQL counterpart; tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
