"""Interval algebra on half-open day intervals, without expanding days.

All functions first reduce a group's intervals to one row per start day (only the latest
end of a start matters), so the windows below sort at most one row per calendar day of the
observation window however many claims a group holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_starts(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return df.groupBy(*keys, start).agg(F.max(end).alias(end))


def with_reach(df: DataFrame, keys: list[str], start: str, end: str, reach: str) -> DataFrame:
    """``reach``: the latest end among the intervals that start earlier in the group."""
    before = (
        Window.partitionBy(*keys)
        .orderBy(start)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn(reach, F.max(end).over(before))


def _days(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(later, earlier))


def covered_days(start: str, end: str, reach: str, low: Column, high: Column) -> Column:
    """Aggregate: days of ``[low, high)`` covered by the union of the intervals.

    Each row contributes the part of ``[start, end)`` that no earlier start has reached.
    Spark's ``greatest`` skips nulls, which handles a group's first row.
    """
    left = F.greatest(F.col(start), F.col(reach), low)
    piece = F.when(F.col(start).isNotNull(), _days(F.least(F.col(end), high), left))
    return F.coalesce(F.sum(piece), F.lit(0))


def widest_gap(start: str, end: str, reach: str, low: Column, high: Column) -> Column:
    """Aggregate: longest uncovered run of ``[low, high)``, both ends included.

    Rows that do not touch the window only move the reach. No row at all leaves the whole
    window uncovered.
    """
    before = F.when(
        F.col(start).isNotNull(),
        _days(F.least(F.col(start), high), F.greatest(F.col(reach), low)),
    )
    after = F.greatest(F.lit(0), F.datediff(high, F.greatest(F.max(F.col(end)), low)))
    return F.greatest(F.coalesce(F.max(before), F.lit(0)), after)


def coverage(
    df: DataFrame, keys: list[str], start: str, end: str, low: str, high: str
) -> DataFrame:
    """Covered days, widest gap and last-day cover of the window ``[low, high)`` per group.

    ``low`` and ``high`` are date columns, constant per group; every group needs one row at
    least (an empty interval stands for "no cover"), empty intervals cover nothing.
    """
    lo, hi = F.col(low), F.col(high)
    real = (F.col(start) < F.col(end)) & (F.col(end) > lo) & (F.col(start) < hi)
    clipped = df.select(
        *keys,
        low,
        high,
        F.when(real, F.greatest(F.col(start), lo)).alias("_s"),
        F.when(real, F.least(F.col(end), hi)).alias("_e"),
    )
    merged = merge_starts(clipped, [*keys, low, high], "_s", "_e")
    reached = with_reach(merged, keys, "_s", "_e", "_reach")
    return reached.groupBy(*keys, low, high).agg(
        covered_days("_s", "_e", "_reach", lo, hi).cast("int").alias("covered_days"),
        widest_gap("_s", "_e", "_reach", lo, hi).cast("int").alias("maximum_gap_days"),
        F.coalesce(
            F.max((F.col("_s") < hi) & (F.col("_e") >= hi)), F.lit(False)
        ).alias("covered_last_day"),
    )


def islands(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Maximal runs of closed intervals; the next interval may start one day after the end."""
    merged = merge_starts(df, [key], start, end)
    reached = with_reach(merged, [key], start, end, "_reach")
    fresh = F.col("_reach").isNull() | (F.col(start) > F.date_add("_reach", 1))
    run = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    return (
        reached.withColumn("_island", F.sum(F.when(fresh, 1).otherwise(0)).over(run))
        .groupBy(key, "_island")
        .agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"))
        .drop("_island")
    )
