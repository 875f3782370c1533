"""Provider opportunity: aggregated patient propensities, weighted scores and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import OpportunityRules, OpportunityScore
from .ordered import scan_in_order, with_scalars
from .ranking import capacity
from .stage import freeze


def top_flag(fraction: float) -> str:
    return "patients_top_" + f"{fraction * 100:g}".replace(".", "_p") + "pct"


def _null_safe(keys: tuple[str, ...], suffix: str) -> Column:
    return reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys], F.lit(True)
    )


def check_scores(
    scores: DataFrame, attribution: DataFrame, rules: OpportunityRules, by: tuple[str, ...] = ()
) -> None:
    """Finite probabilities, and one row per patient (of a period) in both tables."""
    s = F.col(rules.score_col).cast("double")
    bad = scores.where(s.isNull() | F.isnan(s) | (s < 0) | (s > 1))
    if bad.limit(1).count():
        raise ValueError(f"{rules.score_col} must contain finite probabilities within [0, 1]")
    for df, name in ((scores, "patient_scores"), (attribution, "attribution")):
        if df.groupBy(*by, "patient_id").count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} must contain one row per patient")


def flagged_scores(
    scores: DataFrame, rules: OpportunityRules, by: tuple[str, ...] = ()
) -> DataFrame:
    """Patient scores with top-share flags and the high-propensity flag.

    The exact percentile threshold is interpolated between two ranks of the same ordered
    scan that decides the top shares, so no value list is gathered anywhere. ``by`` splits
    the ranking into independent groups, such as targeting periods.
    """
    rows = scores.select(
        *by, "patient_id", F.col(rules.score_col).cast("double").alias("score")
    )
    ranked = scan_in_order(
        rows,
        [("score", False), ("patient_id", True)],
        keys=by,
        position="place",
    )
    sizes = rows.groupBy(*by).agg(F.count("*").alias("size"))
    if rules.threshold_percentile is not None:
        asc = (F.col("size") - 1) * F.lit(rules.threshold_percentile / 100.0)
        low, high = F.floor(asc), F.ceil(asc)
        up = F.col("size") - F.col("place")  # 0-based ascending position
        sized = _with_sizes(ranked, sizes, by)
        picked = sized.groupBy(*by, "size").agg(
            F.max(F.when(up == low, F.col("score"))).alias("a"),
            F.max(F.when(up == high, F.col("score"))).alias("b"),
        )
        limits = picked.select(
            *by,
            "size",
            (F.col("a") + (F.col("b") - F.col("a")) * (asc - low)).alias("high_threshold"),
        )
    else:
        limits = sizes.withColumn("high_threshold", F.lit(float(rules.threshold)))
    flagged = _with_sizes(ranked, limits, by)
    return flagged.select(
        *by,
        "patient_id",
        "score",
        (F.col("score") >= F.col("high_threshold")).cast("int").alias("high_propensity"),
        *[
            (F.col("place") <= capacity(F.col("size"), f)).cast("int").alias(top_flag(f))
            for f in rules.top_fractions
        ],
    )


def _with_sizes(rows: DataFrame, sizes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Attach per-group scalars; there is one row per period (or one in all)."""
    if not by:
        return with_scalars(rows, sizes)
    renamed = sizes.withColumnsRenamed({k: f"{k}_g" for k in by})
    return rows.join(F.broadcast(renamed), _null_safe(by, "_g")).drop(*[f"{k}_g" for k in by])


def opportunity_metrics(
    scores: DataFrame,
    attribution: DataFrame,
    rules: OpportunityRules,
    by: tuple[str, ...] = (),
    *,
    check: bool = True,
) -> DataFrame:
    """Per provider: eligible and high-propensity patients, top-share counts, score sums."""
    if check:
        check_scores(scores, attribution, rules, by)
    mapped = attribution.select(*by, "patient_id", "hcp_id").dropna()
    return (
        mapped.join(flagged_scores(scores, rules, by), [*by, "patient_id"])
        .groupBy(*by, "hcp_id")
        .agg(
            F.count("*").alias("eligible_patient_count"),
            F.sum("high_propensity").alias("high_propensity_patient_count"),
            *[F.sum(top_flag(f)).alias(top_flag(f)) for f in rules.top_fractions],
            F.avg("score").alias("mean_patient_propensity"),
            F.max("score").alias("max_patient_propensity"),
            F.sum("score").alias("expected_switchers"),
        )
    )


def _normalized(df: DataFrame, metric: str, how: str, by: tuple[str, ...]) -> DataFrame:
    """Add ``_x_<metric>``: the metric as is, min-max scaled, or as average percentile rank."""
    value, out = F.col(metric).cast("double"), f"_x_{metric}"
    if how == "none":
        return df.withColumn(out, value)
    if how == "minmax":
        ends = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        low, high = F.col("_low"), F.col("_high")
        flat = F.abs(high - low) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(high)
        return (
            _with_sizes(df, ends, by)
            .withColumn(out, F.when(flat, 0.0).otherwise((value - low) / (high - low)))
            .drop("_low", "_high")
        )
    ties = df.groupBy(*by, value.alias("_v")).agg(F.count("*").alias("_n"))
    ranked = scan_in_order(ties, [("_v", True)], keys=by, totals={"_upto": "_n"})
    sizes = df.groupBy(*by).agg(F.count("*").alias("_all"))
    share = (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0) / F.col("_all")
    placed = _with_sizes(ranked, sizes, by).select(
        *[F.col(k).alias(f"{k}_v") for k in by], "_v", share.alias(out)
    )
    return df.join(placed, (value == F.col("_v")) & _null_safe(by, "_v"), "left").drop(
        "_v", *[f"{k}_v" for k in by]
    )


def check_components(metrics: DataFrame, weights: list[str]) -> None:
    nulls = metrics.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in weights]).first()
    bad = [c for c in weights if nulls[c]]
    if bad:
        raise ValueError(f"Score components contain missing values: {bad}")


def score_opportunities(
    metrics: DataFrame, rules: OpportunityScore, by: tuple[str, ...] = (), *, check: bool = True
) -> DataFrame:
    """Weighted components, opportunity score, its rank (ties share the best) and the formula."""
    missing = sorted({"hcp_id", *rules.weights} - set(metrics.columns))
    if missing:
        raise ValueError(f"hcp_metrics is missing required columns: {missing}")
    if check:
        check_components(metrics, list(rules.weights))
    total = float(sum(rules.weights.values()))
    # Sums of doubles may differ in the last bit when recomputed; the rank join below needs
    # both of its sides to see the same numbers.
    out, terms, score = freeze(metrics), [], F.lit(0.0)
    for metric, raw in rules.weights.items():
        weight = float(raw) / total
        out = _normalized(out, metric, rules.normalization, by)
        component = f"score_component__{metric}"
        out = out.withColumn(component, F.lit(weight) * F.col(f"_x_{metric}")).drop(
            f"_x_{metric}"
        )
        score = score + F.col(component)
        terms.append(f"{weight:.6g}*{rules.normalization}({metric})")
    out = out.withColumn("hcp_opportunity_score", score)
    ties = out.groupBy(*by, F.col("hcp_opportunity_score").alias("_s")).agg(
        F.count("*").alias("_n")
    )
    ranks = scan_in_order(ties, [("_s", False)], keys=by, totals={"_upto": "_n"}).select(
        *[F.col(k).alias(f"{k}_r") for k in by],
        "_s",
        (F.col("_upto") - F.col("_n") + 1).cast("int").alias("hcp_rank"),
    )
    same = F.col("hcp_opportunity_score") == F.col("_s")
    return (
        out.join(ranks, same & _null_safe(by, "_r"), "left")
        .drop("_s", *[f"{k}_r" for k in by])
        .withColumn("opportunity_score_formula", F.lit(" + ".join(terms)))
    )
