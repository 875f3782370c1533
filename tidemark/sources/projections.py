"""Projections from source-shaped tables to the canonical tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES


def project(source: DataFrame, name: str, expressions: Mapping[str, Column | str]) -> DataFrame:
    """The canonical columns of a table (and its optional ones) from source expressions."""
    spec = TABLES[name]
    missing = sorted(set(spec.required.names) - set(expressions))
    if missing:
        raise ValueError(f"{name}: no expression for {missing}")
    as_column = lambda e: F.col(e) if isinstance(e, str) else e
    return source.select(
        *[
            as_column(expressions[c]).cast(kind).alias(c)
            for c, kind in spec.types.items()
            if c in expressions
        ]
    )


def explode_diagnoses(
    events: DataFrame,
    *,
    event_id: str,
    diagnoses: str,
    procedure: str,
    keep: Iterable[str] = (),
) -> DataFrame:
    """One claim line per diagnosis of an event; an event without diagnoses keeps one line.

    Line ids carry the position (``none`` without diagnoses) and the event's procedure stays
    on the first line only.
    """
    lines = events.select(
        event_id, procedure, *keep, F.posexplode_outer(diagnoses).alias("pos", "diagnosis_code")
    )
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    position = F.coalesce(F.col("pos").cast("string"), F.lit("none"))
    return lines.select(
        F.concat(F.col(event_id).cast("string"), F.lit(":"), position).alias("claim_id"),
        *keep,
        "diagnosis_code",
        F.when(first, F.col(procedure)).alias("procedure_code"),
    )


def patient_scope(
    events: DataFrame,
    *,
    patient: str,
    diagnoses: str,
    service: str,
    available: str,
    codes: Iterable[str],
    start: date,
    end: date,
) -> DataFrame:
    """Distinct patients with a qualifying diagnosis in the window and available by its end."""
    inside = F.col(service).between(F.lit(start), F.lit(end)) & (
        F.col(available) <= F.lit(end)
    )
    return (
        events.where(inside)
        .select(F.col(patient).cast("string").alias("patient_id"), F.explode(diagnoses).alias("d"))
        .where(F.col("d").isin(list(codes)))
        .select("patient_id")
        .distinct()
    )


def in_scope(
    df: DataFrame, scope: DataFrame, *, service: str, start: date, end: date
) -> DataFrame:
    """Rows of scoped patients inside the extraction window (a semi-join)."""
    return df.where(F.col(service).between(F.lit(start), F.lit(end))).join(
        scope, "patient_id", "left_semi"
    )
