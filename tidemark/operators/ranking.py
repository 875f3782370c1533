"""Latest assessment per patient, capacity ranking and capture at capacity."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.output import safe_ratio
from .metrics import average_precision, score_table, validate_predictions
from .ordered import scan_in_order, with_scalars


def top_k_count(n: int, fraction: float) -> int:
    """Selected population size: at least one, at most all, rounded up."""
    if n <= 0:
        raise ValueError("n must be positive")
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    return min(n, max(1, ceil(n * fraction)))


def capacity(n: Column, fraction: float) -> Column:
    """``top_k_count`` as a column expression over a row count."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    share = F.ceil(n.cast("double") * F.lit(float(fraction))).cast("bigint")
    return F.least(n, F.greatest(F.lit(1).cast("bigint"), share))


def assessment_problems(frame: DataFrame) -> DataFrame:
    """Counts of null keys, repeated snapshots and repeated patient/index pairs."""
    keys = ("patient_id", "snapshot_id", "index_date")
    nulls = frame.agg(
        *[F.count_if(F.col(k).isNull()).alias(k) for k in keys]
    ).select((F.col("patient_id") + F.col("snapshot_id") + F.col("index_date")).alias("n"))
    repeated = [
        frame.groupBy(*on).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"))
        for on in (["snapshot_id"], ["patient_id", "index_date"])
    ]
    names = ("null_key", "repeated_snapshot", "repeated_patient_index")
    out = None
    for name, part in zip(names, (nulls, *repeated)):
        row = part.select(F.lit(name).alias("rule"), F.col("n").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def latest_assessments(
    frame: DataFrame, *, as_of=None, by: tuple[str, ...] = ("patient_id",), check: bool = True
) -> DataFrame:
    """The last supplied assessment of each patient, optionally up to a date.

    One aggregate with map-side combine picks the row; no per-patient sort is needed.
    """
    if check:
        bad = {r[0]: r[1] for r in assessment_problems(frame).collect() if r[1]}
        if bad:
            raise ValueError(f"Ambiguous or unkeyed assessments: {bad}")
    rows = frame if as_of is None else frame.where(F.col("index_date") <= F.lit(as_of))
    rest = [c for c in frame.columns if c not in (*by, "index_date", "snapshot_id")]
    pick = F.max_by(
        F.struct("index_date", "snapshot_id", *rest), F.struct("index_date", "snapshot_id")
    )
    latest = rows.groupBy(*by).agg(pick.alias("row")).select(*by, "row.*").select(*frame.columns)
    if check and not latest.limit(1).count():
        raise ValueError("No eligible assessments before the scoring cutoff")
    return latest


def rank_latest(latest: DataFrame, score: str, fraction: float) -> DataFrame:
    """Global rank by (score descending, patient ascending) with the capacity flag."""
    rows = latest.select(
        "patient_id", "snapshot_id", "index_date", F.col(score).cast("double").alias("risk_score")
    )
    ranked = scan_in_order(
        rows, [("risk_score", False), ("patient_id", True)], position="rank"
    )
    size = rows.count()
    selected = top_k_count(size, fraction) if size else 0
    return ranked.select(
        "patient_id",
        "snapshot_id",
        "index_date",
        "risk_score",
        F.col("rank").cast("int").alias("rank"),
        (F.col("rank") <= selected).alias("selected"),
    )


def rank_patients(
    frame: DataFrame, score: str, *, fraction: float = 0.1, as_of=None, check: bool = True
) -> DataFrame:
    """Latest assessment per patient, ranked; the top ``fraction`` is selected."""
    if check:
        bad = frame.where(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
        if bad.limit(1).count():
            raise ValueError("Patient scores must be finite and aligned with snapshots")
    return rank_latest(latest_assessments(frame, as_of=as_of, check=check), score, fraction)


def capture_metrics(
    frame: DataFrame, score: str, *, fraction: float = 0.1, check: bool = True
) -> DataFrame:
    """One row: patients, positives, selected, captured, recall, precision, lift, ap."""
    if check:
        validate_predictions(frame, "label", score)
    latest = latest_assessments(frame, check=check)
    if check and latest.agg(F.count_distinct("label")).first()[0] != 2:
        raise ValueError("Patient evaluation requires both classes")
    rows = latest.select(
        "patient_id", F.col("label").alias("y"), F.col(score).cast("double").alias("s")
    )
    placed = scan_in_order(rows, [("s", False), ("patient_id", True)], position="rank")
    totals = rows.agg(F.count("*").alias("patients"), F.sum("y").alias("positives")).withColumn(
        "selected", capacity(F.col("patients"), fraction)
    )
    hit = F.when(F.col("rank") <= F.col("selected"), F.col("y")).otherwise(0)
    captured = (
        with_scalars(placed, totals)
        .groupBy("patients", "positives", "selected")
        .agg(F.sum(hit).alias("captured"))
    )
    ap = score_table(rows, "y", "s").agg(average_precision().alias("ap"))
    return with_scalars(captured, ap).select(
        "patients",
        "positives",
        "selected",
        "captured",
        safe_ratio(F.col("captured"), F.col("positives")).alias("recall"),
        safe_ratio(F.col("captured"), F.col("selected")).alias("precision"),
        safe_ratio(
            F.col("captured") / F.col("selected"), F.col("positives") / F.col("patients")
        ).alias("lift"),
        "ap",
    )
