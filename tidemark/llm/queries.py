"""The corpus operators as registered queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stage import checkpoint_dir

from . import alignment, collocations, decontaminate, langid, minhash, mixing, nbsvm, pii, rules, sharding, suffix_dedup, toxicity, urls

# fixed values: column types of the tables that are read here
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.match_items(docs, items, keep=["doc_id"])).drop("longest_match")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written by shard; the digest is computed from what stands there."""
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    return sharding.digest(sharding.sharded(table(spark, sf_dir, "documents"), path=path)).drop("source")


def op6_mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: a whole document per copy, in the order of the global shuffle."""
    return mixing.replicated(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replication plan, read from the mixture: whole documents are copied, shuffled and
    written to the shared folder first, and the columns that SQL compares are read there."""
    path = f"{checkpoint_dir(spark)}/mixture-{uuid.uuid4().hex}"
    op6_mixed_rows(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "source", "rate", "n_copies", "copy", "shuffle_key")


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_quality(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_digest(table(spark, sf_dir, "pages"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed rules alone: host, path, the rule that decides and its verdict."""
    return urls.with_rules(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_toxicity,
        op3_suffix_dedup,
        op4_personal_data,
        op5_sharding,
        op6_poisson_mixing,
        op6_mixed_rows,
        op7_circulant_minhash,
        op8_decision_lists,
        op9_language_id,
        op10_quality_nbsvm,
        op11_token_alignment,
        op12_collocations,
        op13_url_filter,
        op13_url_rules,
    )
}
