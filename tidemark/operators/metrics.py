"""Ranking and threshold metrics from cumulative counts per distinct score.

Every metric reads one table: rows per distinct score with the running numbers of positives
and of rows at or above it. That table is built with the spread scan, so neither the number
of rows nor the number of distinct scores meets a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.output import safe_ratio
from .ordered import scan_in_order, with_scalars

# fixed values: default capacity shares
TOP_FRACTIONS = (0.01, 0.05, 0.10, 0.20, 0.30)
# fixed value: smallest probability in the log loss (double machine epsilon)
EPSILON = 2.220446049250313e-16
OBJECTIVES = ("f1", "recall", "precision", "balanced_accuracy", "target_recall")


def prediction_problems(df: DataFrame, label: str, score: str, *, probabilities: bool = True):
    """One row of violation counts: missing or non-binary labels, non-finite or outside scores."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    outside = finite & ((s < 0) | (s > 1)) if probabilities else F.lit(False)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(~y.isin(0.0, 1.0), F.lit(True))).alias("bad_label"),
        F.count_if(~finite).alias("bad_score"),
        F.count_if(outside).alias("outside_unit"),
    )


def validate_predictions(
    df: DataFrame, label: str, score: str, *, probabilities: bool = True
) -> None:
    found = prediction_problems(df, label, score, probabilities=probabilities).first()
    if not found["rows"]:
        raise ValueError("There are no predictions to judge")
    if found["bad_label"]:
        raise ValueError("A label is missing or neither 0 nor 1")
    if found["bad_score"]:
        raise ValueError("A score is missing or not finite")
    if found["outside_unit"]:
        raise ValueError("A probability lies outside [0, 1]")


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: ``n``, ``pos``, running ``tp`` and ``k`` (rows at or above), totals."""
    groups = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    totals = df.agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )
    running = scan_in_order(groups, [("s", False)], totals={"tp": "pos", "k": "n"})
    return with_scalars(running, totals)


def average_precision() -> Column:
    """Aggregate over ``score_table``: recall steps times precision; null without positives."""
    step = F.col("pos") / F.nullif("positives", F.lit(0))
    return F.sum(step * F.col("tp") / F.col("k"))


def roc_auc() -> Column:
    """Aggregate over ``score_table``: trapezoids; null when one class is missing."""
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg * (F.col("tp") - F.col("pos") / 2.0))
    positives, rows = F.max("positives"), F.max("rows")
    return area / F.nullif((positives * (rows - positives)).cast("double"), F.lit(0.0))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _confusion(tp: Column, k: Column, positives: Column, rows: Column) -> dict[str, Column]:
    fp = k - tp
    fn = positives - tp
    tn = rows - positives - fp
    recall, specificity = safe_ratio(tp, positives), safe_ratio(tn, tn + fp)
    # Balanced accuracy averages over the classes that occur.
    present = recall.isNotNull().cast("int") + specificity.isNotNull().cast("int")
    balanced = (_or_zero(recall) + _or_zero(specificity)) / F.nullif(present, F.lit(0))
    return {
        "precision": _or_zero(safe_ratio(tp, k)),
        "recall": _or_zero(recall),
        "specificity": specificity,
        "f1": _or_zero(safe_ratio(2 * tp, 2 * tp + fp + fn)),
        "balanced_accuracy": balanced,
    }


def classification_metrics(
    df: DataFrame, label: str, score: str, *, threshold: float = 0.5, check: bool = True
) -> DataFrame:
    """One row of probability and threshold metrics; undefined ones are null."""
    if check:
        validate_predictions(df, label, score)
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be within [0, 1]")
    table = score_table(df, label, score)
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    p = F.greatest(F.lit(EPSILON), F.least(s, F.lit(1.0 - EPSILON)))
    losses = df.agg(
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
        F.avg((s - y) * (s - y)).alias("brier_score"),
    )
    hit = F.col("s") >= F.lit(float(threshold))
    counted = table.agg(
        roc_auc().alias("roc_auc"),
        average_precision().alias("pr_auc"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("k"),
        F.max("positives").alias("positives"),
        F.max("rows").alias("rows"),
    )
    parts = _confusion(*[F.col(c) for c in ("tp", "k", "positives", "rows")])
    return with_scalars(counted, losses).select(
        "roc_auc",
        "pr_auc",
        *[e.alias(n) for n, e in parts.items()],
        "log_loss",
        "brier_score",
        F.lit(float(threshold)).alias("threshold"),
    )


def fraction_label(fraction: float) -> str:
    return f"{fraction * 100:g}%"


def ranking_metrics(
    df: DataFrame,
    label: str,
    score: str,
    *,
    tie: str = "patient_id",
    fractions: tuple[float, ...] = TOP_FRACTIONS,
    check: bool = True,
) -> DataFrame:
    """One row per capacity share: recall, precision, lift and true positives in the top k.

    Ties are ordered by ``tie``, which makes the selection independent of input order.
    """
    from .ranking import capacity

    if check:
        validate_predictions(df, label, score, probabilities=False)
    rows = df.select(
        F.col(tie).alias("tie"),
        F.col(label).cast("bigint").alias("y"),
        F.col(score).cast("double").alias("s"),
    )
    placed = scan_in_order(rows, [("s", False), ("tie", True)], position="rank")
    totals = rows.agg(F.count("*").alias("rows"), F.sum("y").alias("positives"))
    shares = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(float(f)).alias("fraction"),
                    F.lit(fraction_label(f)).alias("at"),
                    capacity(F.col("rows"), f).alias("selected_count"),
                )
                for i, f in enumerate(fractions)
            ]
        )
    ).alias("f")
    # One pass over the ranked rows: a conditional sum per share.
    limits = totals.select(
        "rows",
        "positives",
        *[capacity(F.col("rows"), f).alias(f"k{i}") for i, f in enumerate(fractions)],
    )
    hits = with_scalars(placed, limits).agg(
        F.max("rows").alias("rows"),
        F.max("positives").alias("positives"),
        *[
            F.sum(F.when(F.col("rank") <= F.col(f"k{i}"), F.col("y")).otherwise(0)).alias(f"tp{i}")
            for i in range(len(fractions))
        ],
    )
    picked = reduce(
        lambda rest, i: F.when(F.col("f.i") == i, F.col(f"tp{i}")).otherwise(rest),
        range(len(fractions)),
        F.lit(None).cast("bigint"),
    )
    tp, k = F.col("selected_positives"), F.col("selected_count")
    return (
        hits.select("*", shares)
        .select("rows", "positives", "f.at", "f.fraction", "f.selected_count",
                picked.alias("selected_positives"))
        .select(
            "at",
            "fraction",
            "selected_count",
            "selected_positives",
            F.col("positives").alias("total_positives"),
            safe_ratio(tp, F.col("positives")).alias("recall"),
            safe_ratio(tp, k).alias("precision"),
            safe_ratio(tp / k, F.col("positives") / F.col("rows")).alias("lift"),
        )
    )


def evaluate_predictions(
    df: DataFrame,
    label: str,
    score: str,
    *,
    tie: str = "patient_id",
    threshold: float = 0.5,
    fractions: tuple[float, ...] = TOP_FRACTIONS,
) -> DataFrame:
    """All metrics in one row; capacity metrics are named like ``Recall@10%``."""
    ranked = ranking_metrics(df, label, score, tie=tie, fractions=fractions)
    names = {
        "Recall": "recall",
        "Precision": "precision",
        "Lift": "lift",
        "TruePositives": "selected_positives",
    }
    wide = ranked.agg(
        *[
            F.max(F.when(F.col("at") == fraction_label(f), F.col(c).cast("double"))).alias(
                f"{n}@{fraction_label(f)}"
            )
            for f in fractions
            for n, c in names.items()
        ]
    )
    return with_scalars(classification_metrics(df, label, score, threshold=threshold), wide)


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    counted = df.agg(
        F.sum(F.col(label).cast("bigint")).alias("positive_patients"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("negative_patients"),
        F.avg(F.col(label).cast("double")).alias("positive_prevalence"),
    )
    positive, negative = F.col("positive_patients"), F.col("negative_patients")
    return counted.select(
        "*",
        F.concat_ws(":", positive, negative).alias("positive_to_negative_ratio"),
        safe_ratio(positive, negative).alias("positive_negative_ratio_numeric"),
        safe_ratio(negative, positive).alias("positive_class_weight"),
    )


def threshold_curve(
    df: DataFrame,
    label: str,
    score: str,
    *,
    thresholds: list[float] | None = None,
    check: bool = True,
) -> DataFrame:
    """Metrics at every candidate threshold: the given list, or each score plus 0 and 1."""
    if check:
        validate_predictions(df, label, score)
    table = score_table(df, label, score)
    sizes = df.agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )
    if thresholds is None:
        at = table.select(F.col("s").alias("threshold"), "tp", "k", "rows", "positives")
        # 0 selects every row; 1 selects the rows scored exactly 1, or none.
        low = sizes.select(
            F.lit(0.0).alias("threshold"), F.col("positives").alias("tp"),
            F.col("rows").alias("k"), "rows", "positives",
        )
        none = F.lit(0).cast("bigint")
        high = sizes.select(
            F.lit(1.0).alias("threshold"), none.alias("tp"), none.alias("k"), "rows", "positives"
        )
        curve = (
            at.unionByName(low)
            .unionByName(high)
            .groupBy("threshold", "rows", "positives")
            .agg(F.max("tp").alias("tp"), F.max("k").alias("k"))
        )
    else:
        values = sorted({float(v) for v in thresholds})
        if not values or any(not 0.0 <= v <= 1.0 for v in values):
            raise ValueError("A given threshold is not a number from 0 to 1")
        curve = table.select(
            "rows",
            "positives",
            "n",
            "pos",
            F.explode(
                F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= F.col("s"))
            ).alias("threshold"),
        ).groupBy("threshold").agg(F.sum("pos").alias("tp"), F.sum("n").alias("k"))
        given = df.sparkSession.createDataFrame([(v,) for v in values], "threshold double")
        zero = F.lit(0).cast("bigint")
        curve = (
            with_scalars(given.join(curve, "threshold", "left"), sizes)
            .select(
                "threshold", "rows", "positives",
                F.coalesce("tp", zero).alias("tp"), F.coalesce("k", zero).alias("k"),
            )
        )
    parts = _confusion(*[F.col(c) for c in ("tp", "k", "positives", "rows")])
    return curve.select("threshold", *[e.alias(n) for n, e in parts.items()], "rows")


def tune_thresholds(
    df: DataFrame,
    label: str,
    score: str,
    objectives: tuple[str, ...],
    *,
    thresholds: list[float] | None = None,
    target_recall: float | None = None,
) -> DataFrame:
    """The best threshold by each objective, a row each, from one curve and one aggregate over it;
    equal values go to the higher threshold."""
    # fixed values: accepted long names of two objectives
    alias = {"max_f1": "f1", "max_recall": "recall"}
    names = [o.lower().replace("-", "_").replace(" ", "_") for o in objectives]
    names = [alias.get(n, n) for n in names]
    if not set(names) <= set(OBJECTIVES):
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    if "target_recall" in names and not (target_recall and 0.0 < target_recall <= 1.0):
        raise ValueError("This objective needs a target_recall above 0, at most 1")
    curve = threshold_curve(df, label, score, thresholds=thresholds)
    if "target_recall" in names and not df.where(F.col(label) == 1).limit(1).count():
        raise ValueError("A target recall has no meaning without positive labels")
    best, shown = [], []
    for k, (name, objective) in enumerate(zip(names, objectives, strict=True)):
        value = F.col(name) if name != "target_recall" else F.when(
            F.col("recall") >= F.lit(float(target_recall)), F.col("precision")
        )
        shown.append(objective if name != "target_recall" else f"precision_at_recall_{target_recall:g}")
        # Values that differ only by rounding noise count as equal.
        best.append(F.max(F.struct(F.round(value, 9).alias("v"), "threshold", value.alias("value"))).alias(f"b{k}"))
    row = curve.agg(
        *best, F.max("rows").alias("validation_sample_size"), F.count("*").alias("candidate_count")
    )
    cells = [
        F.struct(
            F.col(f"b{k}.threshold").alias("threshold"),
            F.lit(text).alias("objective"),
            F.col(f"b{k}.value").alias("objective_value"),
        )
        for k, text in enumerate(shown)
    ]
    return row.select(F.explode(F.array(*cells)).alias("b"), "validation_sample_size", "candidate_count").select(
        "b.*", "validation_sample_size", "candidate_count"
    )


def tune_threshold(
    df: DataFrame,
    label: str,
    score: str,
    *,
    objective: str = "f1",
    thresholds: list[float] | None = None,
    target_recall: float | None = None,
) -> DataFrame:
    """One row with the best threshold; equal values go to the higher threshold."""
    return tune_thresholds(
        df, label, score, (objective,), thresholds=thresholds, target_recall=target_recall
    )


def select_threshold(
    df: DataFrame, label: str, score: str, *, strategy: str = "f1", fixed: float = 0.5
) -> float:
    """The F1-optimal threshold, or a fixed one."""
    if strategy == "fixed":
        if not 0.0 <= fixed <= 1.0:
            raise ValueError("The fixed threshold is not a number from 0 to 1")
        return float(fixed)
    if strategy != "f1":
        raise ValueError("strategy must be f1 or fixed")
    best = tune_threshold(df, label, score).first()
    return float(fixed) if best["threshold"] is None else best["threshold"]
