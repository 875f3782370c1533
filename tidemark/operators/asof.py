"""Known-as-of selection and effective-dated mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import known_from, reversal
from ..schema import ContractError
from .skew import lookup, salted_join


def known_claims(
    claims: DataFrame,
    service: str,
    snapshots: DataFrame,
    lag_days: int = 0,
    *,
    start: str | None = None,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Claims known at each snapshot's index date, status as of that date.

    ``snapshots`` holds ``patient_id, index_date`` (plus what the caller wants to carry).
    Service and availability are cut off independently; a reversal counts only once its
    date has passed. ``start`` names an optional lower service bound on the snapshot.
    """
    known = known_from(service, lag_days) <= F.col("index_date")
    if start is not None:
        known = known & (F.col(service) >= F.col(start))
    joined = salted_join(claims, snapshots, ["patient_id"], known, hot)
    return joined.withColumn("status", status_at("status", reversal(claims), "index_date"))


def status_at(status: str, reversed_on, day: str):
    return F.when(reversed_on <= F.col(day), F.lit("reversed")).otherwise(F.col(status))


def mapping_overlaps(mapping: DataFrame) -> DataFrame:
    """Mapping rows that begin on or before the end of an earlier row of the same drug."""
    earlier = (
        Window.partitionBy("drug_id")
        .orderBy("effective_start", "effective_end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (drug, start) suffices to order a drug's intervals, so a drug's group is
    # bounded by the calendar; rows sharing a start overlap by definition.
    starts = mapping.groupBy("drug_id", "effective_start").agg(
        F.max("effective_end").alias("effective_end"), F.count("*").alias("rows")
    )
    return (
        starts.withColumn("previous_end", F.max("effective_end").over(earlier))
        .where((F.col("rows") > 1) | (F.col("effective_start") <= F.col("previous_end")))
        .select("drug_id", "effective_start", "effective_end", "previous_end", "rows")
    )


def with_mapping(pharmacy: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every claim with its mapping multiplicity and mapped class.

    The mapping becomes one row per drug with its intervals, looked up by drug: broadcast after
    its size is counted, so claims are not shuffled; beyond that a join with hot drugs apart.
    """
    intervals = mapping.groupBy("drug_id").agg(
        F.collect_list(
            F.struct(F.col("therapy_class").alias("c"), "effective_start", "effective_end")
        ).alias("_intervals")
    )
    day = F.col("fill_date")
    inside = F.filter(
        "_intervals", lambda i: (i["effective_start"] <= day) & (day <= i["effective_end"])
    )
    return (
        lookup(pharmacy, intervals, "drug_id")
        .select(*pharmacy.columns, F.coalesce(inside, F.array()).alias("_inside"))
        .withColumns(
            {
                "applicable_mappings": F.size("_inside").cast("bigint"),
                "mapped_class": F.array_min(F.transform("_inside", lambda i: i["c"])),
            }
        )
        .drop("_inside")
    )


def effective_mapping(
    pharmacy: DataFrame, mapping: DataFrame, *, check: bool = True
) -> DataFrame:
    """Pharmacy claims with exactly one effective mapping of the same class.

    With ``check`` one counting pass rejects overlapping mappings, claims with zero or
    several mappings, and classes that disagree with the source.
    """
    if check:
        if mapping_overlaps(mapping).limit(1).count():
            raise ContractError("Overlapping therapy mapping effective intervals")
        bad = (
            with_mapping(pharmacy, mapping)
            .agg(
                F.count_if(F.col("applicable_mappings") != 1).alias("multiplicity"),
                F.count_if(
                    (F.col("applicable_mappings") == 1)
                    & ~F.col("mapped_class").eqNullSafe(F.col("therapy_class"))
                ).alias("conflict"),
            )
            .first()
        )
        if bad["multiplicity"]:
            raise ContractError("Each pharmacy claim requires exactly one effective mapping")
        if bad["conflict"]:
            raise ContractError("Pharmacy therapy class conflicts with effective mapping")
        return pharmacy  # every row matched once with its own class: the join adds nothing
    return (
        with_mapping(pharmacy, mapping)
        .where(
            (F.col("applicable_mappings") == 1)
            & F.col("mapped_class").eqNullSafe(F.col("therapy_class"))
        )
        .drop("applicable_mappings", "mapped_class")
    )
