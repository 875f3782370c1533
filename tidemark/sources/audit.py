"""Audit figures of what is written, observed while it is written.

Row counts, nulls, date ranges, statuses and a content digest are aggregates of the writing job
itself: the rows are not scanned a second time. They are observed at the top of the plan, in the
stage that writes, so a task that is run again counts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import STATUSES
from .export import digest_of, row_digest

FIELDS = "table string, measure string, column string, value string"

Measures = dict[tuple[str, str], Column]


def profile_measures(df: DataFrame, *, digest: bool = True) -> Measures:
    """Rows, nulls and date ranges by column, rows by status, and the parts of the digest."""
    out: Measures = {("rows", ""): F.count(F.lit(1))}
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        out["nulls", field.name] = F.count_if(value.isNull())
        if isinstance(field.dataType, T.DateType):
            out["min", field.name], out["max", field.name] = F.min(value), F.max(value)
    if "status" in df.columns:
        for status in STATUSES:
            out["status", status] = F.count_if(F.col("status") == status)
        out["status", "other"] = F.count_if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))
    if digest:
        out["digest", ""] = F.coalesce(F.sum(row_digest(df.columns)), F.lit(0))
    return out


def count_measures(column: str, values: Iterable[str]) -> Measures:
    """Rows by each of a few known values of a column."""
    return {(column, v): F.count_if(F.col(column) == v) for v in values}


class Audit:
    """Writes tables as Parquet below a folder and keeps what was observed of each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rows: list[tuple] = []

    def write(
        self,
        df: DataFrame,
        name: str,
        measures: Mapping[tuple[str, str], Column] | None = None,
        *,
        partition_by: tuple[str, ...] = (),
    ) -> DataFrame:
        """Write ``df`` as ``name``, keep its figures, and return the table that was written."""
        measures = dict(profile_measures(df) if measures is None else measures)
        columns = df.columns
        seen = Observation()
        marked = df.observe(seen, *[c.alias(f"m{k}") for k, c in enumerate(measures.values())])
        path = f"{self.folder}/{name}"
        marked.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        found = [seen.get[f"m{k}"] for k in range(len(measures))]
        rows = next((v for (m, _), v in zip(measures, found, strict=True) if m == "rows"), None)
        for (measure, column), value in zip(measures, found, strict=True):
            if measure == "digest":
                value = digest_of(columns, rows, value)
            self.rows.append((name, measure, column, None if value is None else str(value)))
        return self.spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in columns])

    def add(self, name: str, measure: str, figures: Mapping[str, object]) -> None:
        """Figures known otherwise: timings, counts of a split, scores of a comparison."""
        self.rows += [(name, measure, k, None if v is None else str(v)) for k, v in figures.items()]

    def frame(self) -> DataFrame:
        """(table, measure, column, value), without any patient-level value."""
        return self.spark.createDataFrame(self.rows, FIELDS)
