"""The seven-table directory: CSV or Parquet in, validated canonical tables out."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import effective_mapping
from ..operators.quality import missing_columns, validate_tables
from ..schema import TABLES, ContractError


def read_frame(spark: SparkSession, path: str, file_format: str) -> DataFrame:
    """CSV is read with every column as text, so identifiers keep their leading zeros."""
    if file_format == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    if file_format == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format {file_format!r}; expected csv or parquet")


def rename_columns(df: DataFrame, mapping: Mapping[str, str], name: str) -> DataFrame:
    """Source names to canonical names, then lower case; collisions are an error."""
    names = [mapping.get(c, c).lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ContractError(f"{name}: duplicate columns after renaming")
    return df.toDF(*names)


def typed(df: DataFrame, name: str) -> DataFrame:
    """Cast the contract's dates and numbers (failing on bad input) and lower-case states.

    Fractional supply days are kept from being cut off silently: they fail the cast.
    """
    out = {}
    for column, kind in TABLES[name].types.items():
        if column not in df.columns:
            continue
        source = df.schema[column].dataType
        value = F.col(column)
        if isinstance(kind, T.IntegerType) and not isinstance(source, T.IntegralType):
            number = value.cast("double")
            value = F.when(
                number != F.floor(number),
                F.raise_error(F.lit(f"{name}.{column} must be whole numbers")),
            ).otherwise(number.cast("int"))
        elif source != kind:
            value = value.cast(kind)
        if column == "status":
            value = F.lower(value)
        out[column] = value
    return df.withColumns(out)


def canonicalize(
    tables: Mapping[str, DataFrame],
    columns: Mapping[str, Mapping[str, str]] | None = None,
    *,
    check: bool = True,
) -> dict[str, DataFrame]:
    """Rename, type and validate; pharmacy claims must match one effective mapping each."""
    absent = [n for n in TABLES if n not in tables]
    if absent:
        raise ContractError(f"Missing required table: {', '.join(absent)}")
    result = {
        n: typed(rename_columns(tables[n], (columns or {}).get(n, {}), n), n) for n in TABLES
    }
    problems = missing_columns(result)
    if problems:
        raise ContractError("; ".join(problems))
    if check:
        validate_tables(result)
    result["pharmacy_claims"] = effective_mapping(
        result["pharmacy_claims"], result["therapy_mapping"], check=check
    )
    if "snapshot_candidates" in tables:
        candidates = rename_columns(tables["snapshot_candidates"], {}, "snapshot_candidates")
        result["snapshot_candidates"] = candidates.withColumn(
            "index_date", F.col("index_date").cast("date")
        )
    return result


def table_path(directory: str, name: str, file: str | None, file_format: str) -> str:
    """Default stem, per-table override, absolute override; a bare stem gets the extension."""
    path = PurePosixPath(file or name)
    if not path.suffix:
        path = path.with_suffix("." + file_format)
    if path.is_absolute() or "://" in str(file or ""):
        return str(file) if "://" in str(file or "") else str(path)
    return f"{directory.rstrip('/')}/{path}"


def load_directory(
    spark: SparkSession,
    directory: str,
    *,
    file_format: str = "parquet",
    files: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    check: bool = True,
) -> dict[str, DataFrame]:
    tables = {
        n: read_frame(
            spark, table_path(directory, n, (files or {}).get(n), file_format), file_format
        )
        for n in TABLES
    }
    return canonicalize(tables, columns, check=check)


def save_directory(
    tables: Mapping[str, DataFrame], directory: str, file_format: str = "csv"
) -> None:
    """Write the validated canonical tables; other names are skipped."""
    if file_format not in {"csv", "parquet"}:
        raise ValueError("file_format must be csv or parquet")
    validate_tables(dict(tables))
    for name in TABLES:
        writer = tables[name].write.mode("overwrite")
        path = f"{directory.rstrip('/')}/{name}.{file_format}"
        if file_format == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
