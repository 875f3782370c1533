"""Proportional stratified interleaving: shards that all hold the mixture of the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stage import checkpoint_dir, freeze

from .blocks import id_text
from .numbering import positions

SHARDS = 8


def stratum(source: str):
    """The source as a key that keeps null apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))


def placed(
    docs: DataFrame, shards: int, seed: str, doc_id: str, text: str, source: str, row: str | None = None
) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot) of every row, and its number ``row`` if given."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_text(f"`{doc_id}`")))
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.col(f"`{source}`").alias("source"),
        stratum(source).alias("stratum"),
        (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_crc32"),
        key.alias("key"),
        *([] if row is None else [F.col(row)]),
    )
    ties = ["key", "text_crc32", "size", *([] if row is None else [row])]
    ranked = positions(narrow, [F.col(c) for c in ("stratum", *ties)], "at")
    strata = freeze(
        ranked.groupBy("stratum").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    )
    fraction = (F.col("at") - F.col("start") + F.lit(0.5)) / F.col("rows")
    mixed = ranked.join(strata, "stratum").withColumn("fraction", fraction)
    total = strata.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    spots = positions(mixed, [F.col(c) for c in ("fraction", "stratum", *ties)], "spot")
    # Cuts: shard s holds the spots from ceil(s * total / shards) on.
    shard = F.expr(f"cast(spot * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return spots.withColumn("shard", shard).withColumn("slot", F.col("spot") - first)


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, text_crc32, law, shard, slot, grown_shard) of rows that are in shards."""
    return df.select(
        doc_id,
        source,
        (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def interleaved(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    seed: str = "shards",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(id, source, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Rows of a source are ranked by a seeded digest of their id; the fractional rank
    ``(rank + 1/2) / rows of the source`` orders all rows, and equal cuts of that order are the
    shards. So shard sizes in rows differ by one at most, and so do the rows of any source in
    two shards, nearly. Ties fall by source, text checksum and size; rows that tie in all of
    them are interchangeable. Null sources are one stratum, null texts have size 1, an empty
    table gives an empty result, and other columns are ignored. Texts are never shuffled:
    this is the plan of ``sharded``, which returns the rows themselves.
    """
    spots = placed(docs, shards, seed, doc_id, text, source)
    return spots.select(
        F.col("id").alias(doc_id),
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    seed: str = "shards",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    path: str | None = None,
) -> DataFrame:
    """``docs`` with the shard and slot that ``interleaved`` gives each row.

    The rows are numbered and written once to the shared folder, so that a number stands for
    the same row when its place is joined; one shuffle of whole rows. With ``path`` they are
    also written there, a folder for each shard, and read from it. Columns named shard or slot
    are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    numbered = docs.select(*kept, F.monotonically_increasing_id().alias("_row"))
    folder = f"{checkpoint_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    numbered.write.option("compression", "zstd").parquet(folder)
    own = docs.sparkSession.read.schema(numbered.schema).parquet(folder)
    spots = placed(own, shards, seed, doc_id, text, source, "_row").select("_row", "shard", "slot")
    rows = own.join(spots, "_row").drop("_row")
    if path is None:
        return rows
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path).select(*[F.col(f"`{c}`") for c in rows.columns])
