"""Warehouse export by SELECT with a manifest, and its verification on load."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, ContractError
from .directory import load_directory, read_frame, table_path

MANIFEST = "export_manifest"
MANIFEST_SCHEMA = (
    "table string, rows bigint, content_digest string, sql_sha256 string, status string, "
    "data_kind string, extract_as_of_date string, extract_version string, error string"
)


def row_digest(columns: list[str]) -> Column:
    """The first 60 bits of the md5 of a row's values as text, columns by name, as a number.

    Each value follows its length, and a null is a minus sign.
    """
    values = [F.col(f"`{c}`").cast("string") for c in sorted(columns)]
    marked = [F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in values]
    return F.conv(F.substring(F.md5(F.concat(*marked)), 1, 15), 16, 10).cast("decimal(20,0)")


def digest_of(columns: list[str], rows: int, total: object) -> str:
    """The digest of a table from its row count and the sum of its row digests."""
    return hashlib.sha256(f"{','.join(sorted(columns))}|{rows}|{total}".encode()).hexdigest()


def content_digest(df: DataFrame) -> DataFrame:
    """One row: row count and a digest that does not depend on row order or partitioning."""
    counted = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row_digest(df.columns)), F.lit(0)).cast("string").alias("sum"),
    )
    text = F.concat_ws("|", F.lit(",".join(sorted(df.columns))), F.col("rows"), F.col("sum"))
    return counted.select("rows", F.sha2(text, 256).alias("content_digest"))


def select_only(query: str) -> str:
    """The statement without comments, if it is one SELECT or WITH free of placeholders."""
    text = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", _without_comment, query, flags=re.S)
    text = text.strip().removesuffix(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if not re.match(r"(select|with)\b", bare, re.I):
        raise ContractError("An export statement has to begin with SELECT or WITH")
    if ";" in bare:
        raise ContractError("An export takes a single statement")
    if re.match(r"with\b", bare, re.I) and not re.match(r"(select|values|table|from)\b", _after_with(bare), re.I):
        raise ContractError("An export statement may only read")
    if re.search(r"<[A-Za-z_]+>|\{\{|\$\{", bare):
        raise ContractError("An export statement still holds placeholders")
    return text


def _after_with(text: str) -> str:
    """The statement behind the common table expressions: what follows the last closing bracket
    of the list that starts a WITH."""
    depth, quoted, rest = 0, "", text
    for k, c in enumerate(text):
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"`":
            quoted = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            rest = text[k + 1 :].lstrip()
            if depth == 0 and not re.match(r"(,|as\b)", rest, re.I):
                return rest
    return rest


def _without_comment(match: re.Match) -> str:
    return match[0] if match[0].startswith("'") else " "


def read_query(
    spark: SparkSession, name: str, query: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """A canonical SELECT, in the session or (with options) through JDBC.

    With ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` among the
    options the table is read in parallel.
    """
    query = select_only(query)
    if options:
        reader = spark.read.format("jdbc").options(**options)
        if any(k.lower() == "partitioncolumn" for k in options):
            df = reader.option("dbtable", f"({query}) canonical").load()
        else:
            df = reader.option("query", query).load()
    else:
        df = spark.sql(query)
    names = [c.lower() for c in df.columns]
    missing = sorted(set(TABLES[name].required.names) - set(names))
    if missing or len(set(names)) != len(names):
        raise ContractError(f"{name}: missing canonical columns {missing} or duplicates")
    return df.toDF(*names)


def within_cap(df: DataFrame, name: str, max_rows: int) -> DataFrame:
    """Fail when a table exceeds its export cap; never cut it."""
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    if df.limit(max_rows + 1).count() > max_rows:
        raise ContractError(f"{name} exceeds the {max_rows:,}-row export limit")
    return df


def _write_manifest(spark: SparkSession, rows: list[tuple], directory: str) -> None:
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    manifest.write.mode("overwrite").json(f"{directory}/{MANIFEST}")


def export_tables(
    spark: SparkSession,
    queries: Mapping[str, str],
    directory: str,
    *,
    as_of: date,
    kind: str = "unverified",
    version: str = "",
    max_rows: int | None = None,
    options: Mapping[str, str] | None = None,
) -> str:
    """Write the seven tables as CSV, then validate them; the manifest tells how far it got.

    The manifest starts as RUNNING, ends as COMPLETED with a digest per table, or FAILED.
    """
    about = (kind, as_of.isoformat(), version)
    begun = [(n, None, None, _sha(q), "RUNNING", *about, None) for n, q in queries.items()]
    _write_manifest(spark, begun, directory)
    done: list[tuple] = []
    try:
        for name in TABLES:
            df = read_query(spark, name, queries[name], options)
            if max_rows is not None:
                df = within_cap(df, name, max_rows)
            path = f"{directory}/{name}.csv"
            df.write.mode("overwrite").option("header", True).csv(path)
            # The digest describes what was written, so it is taken from the files.
            found = content_digest(read_frame(spark, path, "csv")).first()
            done.append((name, found[0], found[1], _sha(queries[name]), "COMPLETED", *about, None))
        load_directory(spark, directory, file_format="csv")
    except Exception as error:
        text = f"{type(error).__name__}: {error}"
        whole = {r[0] for r in done}
        states = [*done, *[(*r[:4], "FAILED", *about, text) for r in begun if r[0] not in whole]]
        _write_manifest(spark, states, directory)
        raise
    _write_manifest(spark, done, directory)
    return f"{directory}/{MANIFEST}"


def _sha(query: str) -> str:
    return hashlib.sha256(query.encode()).hexdigest()


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{directory}/{MANIFEST}")


def manifest_differences(spark: SparkSession, directory: str) -> DataFrame:
    """Tables whose files no longer give the recorded row count or digest."""
    parts = None
    for name in TABLES:
        now = content_digest(read_frame(spark, f"{directory}/{name}.csv", "csv")).select(
            F.lit(name).alias("table"),
            F.col("rows").alias("rows_now"),
            F.col("content_digest").alias("digest_now"),
        )
        parts = now if parts is None else parts.unionByName(now)
    recorded = read_manifest(spark, directory)
    return parts.join(recorded, "table", "left").where(
        ~F.col("digest_now").eqNullSafe(F.col("content_digest"))
        | ~F.col("rows_now").eqNullSafe(F.col("rows"))
    ).select("table", "rows", "rows_now", "content_digest", "digest_now")


def verify_manifest(
    spark: SparkSession,
    directory: str,
    *,
    as_of: date,
    version: str = "",
    kind: str = "real",
) -> None:
    rows = read_manifest(spark, directory).collect()  # one row per canonical table
    if {r["status"] for r in rows} != {"COMPLETED"} or len(rows) != len(TABLES):
        raise ContractError("Raw export is incomplete or failed; use a completed extract")
    if {r["data_kind"] for r in rows} != {kind}:
        raise ContractError("Raw export is of another data kind")
    if {r["extract_as_of_date"] for r in rows} != {as_of.isoformat()}:
        raise ContractError("Raw export as-of date does not match")
    if {r["extract_version"] or "" for r in rows} != {version}:
        raise ContractError("Raw export version does not match")
    changed = [r["table"] for r in manifest_differences(spark, directory).collect()]
    if changed:
        raise ContractError(f"Raw files changed after export: {sorted(changed)}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file below ``path``, computed by the executors; a file is one row there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


FILES = "file_manifest"
FILE_FIELDS = "table string, file string, rows bigint, digest string"


def digests_by_file(df: DataFrame, name: str) -> DataFrame:
    """(table, file, rows, digest) of the files that ``df`` reads, from one pass over them.

    A file's digest is that of ``content_digest`` over its rows. Partial digests are combined
    map-side, so large files are read by many tasks and none is held as a whole.
    """
    columns = sorted(df.columns)
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    rows = df.select("*", file.alias("_file")).groupBy("_file").agg(
        F.count("*").alias("rows"), F.sum(row_digest(columns)).cast("string").alias("sum")
    )
    text = F.concat_ws("|", F.lit(",".join(columns)), F.col("rows"), F.col("sum"))
    return rows.select(
        F.lit(name).alias("table"), F.col("_file").alias("file"), "rows", F.sha2(text, 256).alias("digest")
    )


def directory_digests(
    spark: SparkSession, directory: str, names: Iterable[str], file_format: str
) -> DataFrame:
    parts = [
        digests_by_file(read_frame(spark, table_path(directory, n, None, file_format), file_format), n)
        for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def write_file_manifest(
    spark: SparkSession, directory: str, names: Iterable[str] = tuple(TABLES), file_format: str = "parquet"
) -> None:
    """Record rows and digest of every file of the tables, beside them."""
    found = directory_digests(spark, directory, names, file_format)
    found.coalesce(1).write.mode("overwrite").json(f"{directory}/{FILES}")  # one row per file


def file_differences(
    spark: SparkSession, directory: str, names: Iterable[str] = tuple(TABLES), file_format: str = "parquet"
) -> DataFrame:
    """(table, file, state, rows, rows_now): files that went, came or changed since the record."""
    recorded = spark.read.schema(FILE_FIELDS).json(f"{directory}/{FILES}")
    now = directory_digests(spark, directory, names, file_format).withColumnsRenamed(
        {"rows": "rows_now", "digest": "digest_now"}
    )
    state = (
        F.when(F.col("digest_now").isNull(), "missing")
        .when(F.col("digest").isNull(), "added")
        .when(F.col("digest") != F.col("digest_now"), "changed")
    )
    return (
        recorded.join(now, ["table", "file"], "full")
        .withColumn("state", state)
        .where("state is not null")
        .select("table", "file", "state", "rows", "rows_now")
    )


def has_file_manifest(spark: SparkSession, directory: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{FILES}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_verified(
    spark: SparkSession,
    directory: str,
    *,
    file_format: str = "parquet",
    required: bool = False,
    **options,
) -> dict[str, DataFrame]:
    """``load_directory`` after its files were held against the record, where there is one.

    ``required`` makes a directory without a record an error.
    """
    if has_file_manifest(spark, directory):
        changed = file_differences(spark, directory, TABLES, file_format)
        states = changed.groupBy("table", "state").count().collect()  # three states a table
        if states:
            text = sorted(f"{r['table']}: {r['count']} {r['state']}" for r in states)
            raise ContractError("Files differ from their manifest; " + "; ".join(text))
    elif required:
        raise ContractError("The directory has no file manifest")
    return load_directory(spark, directory, file_format=file_format, **options)
