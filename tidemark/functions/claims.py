"""Column expressions over claims: arms, validity, tokens, flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import TherapyArms
from ..schema import VALID_STATUSES


def member(column: Column | str, values: Iterable[str]) -> Column:
    """Null-safe list membership: a null is never a member."""
    column = F.col(column) if isinstance(column, str) else column
    values = list(values)
    if not values:
        return F.lit(False)
    return F.coalesce(column.isin(values), F.lit(False))


def is_conventional(arms: TherapyArms) -> Column:
    return member("drug_id", arms.conventional_drugs) | member(
        "therapy_class", arms.conventional_classes
    )


def is_advanced(arms: TherapyArms) -> Column:
    return member("drug_id", arms.advanced_drugs) | member("therapy_class", arms.advanced_classes)


def is_valid(status: Column | str = "status") -> Column:
    """Exposure counts: the claim is paid or final."""
    return member(status, VALID_STATUSES)


def reversal(df: DataFrame) -> Column:
    """The optional reversal date, as a typed null where the table has none."""
    return F.col("reversal_date") if "reversal_date" in df.columns else F.lit(None).cast("date")


def known_from(service: Column | str, lag_days: int) -> Column:
    """First index date on which a claim is known.

    ``service <= index - lag and available <= index`` is one bound on the index:
    ``index >= greatest(service + lag, available)``.
    """
    service = F.col(service) if isinstance(service, str) else service
    return F.greatest(F.date_add(service, lag_days), F.col("available_date"))


def truthy(df: DataFrame, name: str) -> Column:
    """Relevance flags arrive as booleans, numbers or words."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(name) != 0, F.lit(False))
    # fixed values: words read as true
    words = ("1", "true", "yes", "y", "relevant")
    return member(F.trim(F.lower(F.col(name).cast("string"))), words)


def boolean_word(column: Column) -> Column:
    """true/false/1/0 in any case; everything else becomes null."""
    word = F.lower(column.cast("string"))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def relevant(specialties: Iterable[str], specialty: str = "specialty") -> Column:
    """Attribution relevance; the specialty list is case-sensitive here by contract."""
    return is_valid() & (
        member("therapy_class", ["conventional"]) | member(specialty, specialties)
    )


def period_label(day: Column, period: str) -> Column:
    if period == "Q":
        return F.concat(F.year(day), F.lit("Q"), F.quarter(day))
    return F.date_format(day, "yyyy-MM")
