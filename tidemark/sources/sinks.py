"""Restricted patient-level sinks and the provider-only field file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.output import csv_safe
from ..operators.ordered import Order
from ..operators.quality import counted, union_all
from ..schema import LeakageError

# fixed value: byte order mark that makes spreadsheets read UTF-8
BOM = "﻿"
PATIENT_COLUMNS = frozenset({"patient_id", "snapshot_id", "index_date", "risk_score"})


def in_order(df: DataFrame, order: Order) -> DataFrame:
    """Rows in range partitions, sorted within: written files then follow the order by name.

    The number of files is that of the shuffle partitions; no task holds more than its range.
    """
    sorts = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *sorts).sortWithinPartitions(*sorts)


def order_violations(spark: SparkSession, path: str, rank: str) -> DataFrame:
    """Counted rules on an ordered CSV: rows out of order in a file, files whose ranges overlap,
    ranks that repeat. Files are read back, and a row's place is its file, block and number."""
    rows = spark.read.option("header", True).csv(path)
    named = rows.toDF(*[c.removeprefix(BOM) for c in rows.columns]).select(
        F.col(rank).cast("bigint").alias("rank"),
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    before = Window.partitionBy("file").orderBy("block", "at")
    within = named.withColumn("last", F.lag("rank").over(before))
    files = named.groupBy("file").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    spans = files.withColumn("last", F.lag("high").over(Window.orderBy("file")))  # one row per file
    repeats = named.groupBy("rank").agg(F.count("*").alias("n"))
    return union_all(
        [
            counted(within, "field", {"row_out_of_order": F.col("rank") < F.col("last")}),
            counted(spans, "field", {"file_overlaps": F.col("low") < F.col("last")}),
            counted(repeats, "field", {"rank_repeated": F.col("n") > 1}),
        ]
    )


def write_restricted(df: DataFrame, path: str) -> None:
    """Patient-level output, partitioned by index month.

    Rebalancing gathers a month's rows into few files and splits a month that is too large
    for one task, which a plain repartition by month would not.
    """
    monthly = df.withColumn("index_month", F.date_format("index_date", "yyyy-MM"))
    monthly.hint("rebalance", F.col("index_month")).write.mode("overwrite").partitionBy(
        "index_month"
    ).parquet(path)


def write_field_csv(targets: DataFrame, path: str, order: Order = ()) -> None:
    """Provider rows only, formula-safe, UTF-8 with a byte order mark in the header; with
    ``order`` the rows follow it from file to file."""
    exposed = PATIENT_COLUMNS & set(targets.columns)
    if exposed:
        raise LeakageError(f"Field file must not contain patient columns: {sorted(exposed)}")
    safe = csv_safe(in_order(targets, order) if order else targets)
    first = safe.columns[0]
    marked = safe.withColumnRenamed(first, BOM + first)
    marked.write.mode("overwrite").option("header", True).csv(path)


def provider_csv(targets: DataFrame, path: str) -> None:
    """The plain provider opportunity table as CSV."""
    text = [f.name for f in targets.schema if isinstance(f.dataType, T.ArrayType)]
    targets.drop(*text).write.mode("overwrite").option("header", True).csv(path)
