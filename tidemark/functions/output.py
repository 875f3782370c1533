"""Presentation helpers used at sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



# fixed value: blanks of any script, then one of the signs that begin a formula
BLANK_SIGN = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*[=+\-@]"


def csv_safe(df: DataFrame) -> DataFrame:
    """Prefix text that a spreadsheet would run as a formula with an apostrophe.

    Blanks before the sign do not hide it, whatever their kind in Unicode.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {
            c: F.when(
                F.col(c).rlike(BLANK_SIGN), F.concat(F.lit("'"), F.col(c))
            ).otherwise(F.col(c))
            for c in text
        }
    )


def share_percent(part: Column, whole: Column) -> Column:
    """Percentage to two places, half-even as the contract rounds."""
    return F.bround(F.lit(100.0) * part / whole, 2)


def targeting_reason(priority: str, eligible: str) -> Column:
    return F.format_string(
        "%d priority patients among %d attributed eligible patients",
        F.col(priority),
        F.col(eligible),
    )


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null instead of a division error on a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
