"""Row positions, running totals and previous rows over an order, without one big task.

A plain window puts a whole group into one task. Here rows are range-partitioned by
(keys, order), so a group of any size is spread over neighbouring partitions; windows run
per partition, and one small carry row per (partition, group) links neighbours. A group
crosses at most one border between two neighbours, hence there are fewer carries than
partitions, and the carry table may be broadcast at any data size.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import freeze

CHUNK = "_chunk"
Order = list[tuple[str, bool]]  # (column, ascending)


def _sorts(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def chunks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fill(
    df: DataFrame,
    window,
    order: Order,
    position: str | None,
    totals: Mapping[str, str],
    previous: Mapping[str, str],
) -> DataFrame:
    running = window.orderBy(*_sorts(order))
    upto = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {o: F.sum(c).over(upto) for o, c in totals.items()}
    out |= {o: F.lag(c).over(running) for o, c in previous.items()}
    if position:
        out[position] = F.row_number().over(running).cast("bigint")
    return df.withColumns(out)


def numbered(df: DataFrame, order: Order, position: str, chunks: int | None = None) -> DataFrame:
    """1-based positions in one order over all rows, from the sorted range partitions themselves.

    One shuffle of the rows. A row's place in its partition is part of its generated number; the
    rows of earlier partitions are added, one small row per partition.
    """
    ranged = df.repartitionByRange(chunks or chunks_of(df), *_sorts(order))
    placed = freeze(
        ranged.sortWithinPartitions(*_sorts(order)).withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    before, rows = 0, []
    for part_id, n in sorted((r["_part"], r["n"]) for r in sizes):  # one row per partition
        rows.append((part_id, before))
        before += n
    carry = df.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")
    own = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(carry), "_part")
        .withColumn(position, F.col("_before") + own)
        .select(*df.columns, position)
    )


def scan_in_order(
    df: DataFrame,
    order: Order,
    *,
    keys: tuple[str, ...] = (),
    position: str | None = None,
    totals: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    spread: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """Add 1-based positions, inclusive running sums and previous-row values.

    ``order`` must be total within a group. ``totals`` and ``previous`` map output names to
    input columns. ``spread=False`` uses the plain window and is meant for groups whose
    size the caller has checked.
    """
    totals, previous = dict(totals or {}), dict(previous or {})
    if not spread:
        if not keys:
            raise ValueError("A window without keys must be spread")
        return _fill(df, Window.partitionBy(*keys), order, position, totals, previous)

    if position and not (keys or totals or previous):
        return numbered(df, order, position, chunks)
    count = chunks or chunks_of(df)
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *_sorts(order))
    frozen = freeze(ranged.withColumn(CHUNK, F.spark_partition_id()))
    local = _fill(
        frozen, Window.partitionBy(CHUNK, *keys), order, position or "_pos", totals, previous
    )
    rank = position or "_pos"
    summary = local.groupBy(CHUNK, *keys).agg(
        F.max(rank).alias("_n"),
        *[F.max_by(o, rank).alias(f"_t_{o}") for o in totals],
        *[F.max_by(c, rank).alias(f"_p_{o}") for o, c in previous.items()],
    )
    before = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy(CHUNK)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        CHUNK,
        *keys,
        F.sum("_n").over(earlier).alias("_before"),
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_c_{o}") for o in totals],
        *[F.lag(f"_p_{o}").over(before).alias(f"_l_{o}") for o in previous],
    ).where(F.col("_before").isNotNull())
    renamed = carry.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {CHUNK: "_k_chunk"})
    on = reduce(
        Column.__and__,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col(CHUNK) == F.col("_k_chunk"),
    )
    linked = local.join(F.broadcast(renamed), on, "left")
    out = {o: F.coalesce(F.col(o) + F.coalesce(f"_c_{o}", F.lit(0)), f"_c_{o}") for o in totals}
    out |= {o: F.when(F.col(rank) == 1, F.col(f"_l_{o}")).otherwise(F.col(o)) for o in previous}
    if position:
        out[position] = F.col(position) + F.coalesce("_before", F.lit(0))
    kept = [*df.columns, *[o for o in (*totals, *previous)], *([position] if position else [])]
    # `previous` reads the chunk-local rank, so positions are replaced in the same projection.
    return linked.withColumns(out).select(*kept)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row result as scalar subqueries."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def exact_quantiles(df: DataFrame, columns: list[str], fraction: float) -> DataFrame:
    """Linearly interpolated quantile of every column, as rows ``(name, value)``.

    Values are counted first, so the ordered scan sees each distinct value once. Cells carry the
    number of their column; its name is put back at the end.
    """
    columns = list(dict.fromkeys(columns))
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    tall = df.select(F.posexplode(cells).alias("k", "x")).where(F.col("x").isNotNull())
    counts = tall.groupBy("k", "x").agg(F.count("*").alias("n"))
    ordered = scan_in_order(counts, [("x", True)], keys=("k",), totals={"upto": "n"})
    # The last running total is the size; the values themselves are not counted again.
    sizes = ordered.groupBy("k").agg(F.max("upto").alias("size"))
    placed = ordered.join(F.broadcast(sizes), "k")
    at = (F.col("size") - 1) * F.lit(float(fraction))
    low, high = F.floor(at), F.ceil(at)

    def value_at(index: Column) -> Column:
        return F.max(
            F.when((F.col("upto") - F.col("n") <= index) & (index < F.col("upto")), F.col("x"))
        )

    names = F.array(*[F.lit(c) for c in columns])
    return (
        placed.groupBy("k", "size")
        .agg(value_at(low).alias("a"), value_at(high).alias("b"))
        .select(
            F.element_at(names, F.col("k") + 1).alias("name"),
            (F.col("a") + (F.col("b") - F.col("a")) * (at - low)).alias("value"),
        )
    )
