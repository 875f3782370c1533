"""Bounded, reproducible training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import id_text, remainder


def labelled(
    labels: DataFrame, label: str, *, limit: int, divisor: int, held_out: int, doc_id: str = "doc_id"
) -> DataFrame:
    """(id, y) of at most ``limit`` labelled documents outside the held-out fold.

    The first of them by a digest of the id, so the sample does not depend on row order. Rows
    without a label are left out.
    """
    return (
        labels.where(F.col(label).isNotNull() & (remainder(doc_id, divisor) != held_out))
        .select(F.col(doc_id).alias("labelled_id"), (F.col(label) > 0).cast("int").alias("y"))
        .orderBy(F.md5(id_text("labelled_id")), "labelled_id", "y")
        .limit(limit)
    )


def sample_texts(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, y, text) of the sampled documents, one row for each id and label.

    Of several texts under one id the smallest counts, so the bound on the sample also bounds
    what is read; each task keeps one text for an id before anything is shuffled. The sample is
    bounded, hence the broadcast.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(sample), F.col("id") == F.col("labelled_id")
    )
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))
