"""Global positions over an order, for tables of any size and with any hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stage import freeze

IN_PARTITION = (1 << 33) - 1


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted, with 0-based positions.

    The sorted partitions are frozen, so that their numbers cannot change; a row's position is
    its place in the partition plus the rows of earlier partitions. One shuffle; what is
    summed in one task, and broadcast, is one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = freeze(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(carry), "_part")
        .withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit(IN_PARTITION)))
        .drop("_part", "_place", "_before")
    )
