"""Hot-key detection and salted joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more rows than one task should sort.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> list[tuple]:
    """Keys with more than ``hot_rows`` rows, each with its row count.

    Every key over the bound is hot, whatever its share of the table, so no task holds more.
    A table of n rows has fewer than n / ``hot_rows`` of them; they are salted through a
    table of keys. The scan reads the key columns only and combines map-side.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    counts = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).groupBy(
        *keys
    ).agg(F.count("*").alias("_n"))
    heavy = counts.where(F.col("_n") > limit)
    return [tuple(r) for r in heavy.collect()]


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    condition: Column | None = None,
    hot: list[tuple] | None = None,
    *,
    hot_on: list[str] | None = None,
    how: str = "inner",
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Equi-join that spreads the hot keys of ``big`` over several tasks.

    ``small`` must hold few rows per key (index dates of a patient, landmarks of a
    prescriber); only its hot rows are replicated. Without hot keys it is a plain join.
    ``hot`` lists hot values of ``hot_on`` (default: of ``keys``) with their row counts.
    ``big`` and ``small`` share only the key names; ``condition`` is the residual. ``how``
    may be ``inner`` or ``left``: a row of ``big`` has exactly one salt, so it meets every
    matching row of ``small`` once.
    """
    hot_on = hot_on or keys
    hot = hot_keys(big, hot_on) if hot is None else hot
    if not hot:
        return _equi(big, small, keys, condition, how)
    per = rows_per_salt or HOT_ROWS
    types = ", ".join(f"{k} {big.schema[k].dataType.simpleString()}" for k in hot_on)
    table = F.broadcast(
        big.sparkSession.createDataFrame(
            [(*row[:-1], max(2, -(-row[-1] // per))) for row in hot], f"{types}, _salts int"
        )
    )
    spread = F.pmod(F.xxhash64(*[c for c in big.columns if c not in hot_on]), F.col("_salts"))
    left = (
        big.join(table, hot_on, "left")
        .withColumn("_salt", F.coalesce(spread.cast("int"), F.lit(0)))
        .drop("_salts")
    )
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = (
        small.join(table, hot_on, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    )
    return _equi(left, right, [*keys, "_salt"], condition, how).drop("_salt")


def _equi(
    left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None, how: str
) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    if condition is not None:
        on = on & condition
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


# Dimensions up to this many rows are broadcast (about 100 bytes a row).
BROADCAST_ROWS = 200_000


def lookup(
    df: DataFrame, dimension: DataFrame, key: str, *, rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join to a dimension that is unique by ``key``.

    A small dimension (counted) is broadcast. A large one is joined by shuffle, however small its
    compressed files look, with the hot keys' few dimension rows broadcast apart so that no task
    receives a hot key whole.
    """
    if dimension.count() <= rows:
        return df.join(F.broadcast(dimension), key, "left")
    hot = [k for k, _ in hot_keys(df, [key])]
    if not hot:
        return df.join(dimension.hint("merge"), key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.where(is_hot).join(
        F.broadcast(dimension.where(F.col(key).isin(hot))), key, "left"
    ).unionByName(df.where(~is_hot).join(dimension.hint("merge"), key, "left"))
