"""Patient-to-provider attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.claims import member, truthy
from ..params import EXISTING, RECENT, SPECIALIST, AttributionRules

ATTRIBUTION_SCHEMA = (
    "patient_id string, hcp_id string, attribution_method string, "
    "attribution_claim_count bigint, attribution_last_date date"
)


def _require(df: DataFrame, columns: list[str], name: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")


def candidate_events(events: DataFrame, rules: AttributionRules) -> DataFrame:
    """Events that may decide the attribution under the configured rule."""
    _require(events, [rules.patient_col, rules.hcp_col, rules.date_col], "provider_events")
    keep = F.col(rules.patient_col).isNotNull() & F.col(rules.hcp_col).isNotNull()
    if rules.relevant_col is not None:
        _require(events, [rules.relevant_col], "provider_events")
        keep = keep & truthy(events, rules.relevant_col)
    if rules.rule == RECENT and rules.role_col is not None:
        _require(events, [rules.role_col], "provider_events")
        keep = keep & member(F.lower(rules.role_col), [r.lower() for r in rules.roles])
    if rules.rule == SPECIALIST:
        _require(events, [rules.specialty_col], "provider_events")
        if rules.specialists:
            names = [s.lower() for s in rules.specialists]
            keep = keep & member(F.lower(rules.specialty_col), names)
        else:
            keep = keep & F.col(rules.specialty_col).isNotNull()
    return events.where(keep)


def rule_attribution(
    events: DataFrame, rules: AttributionRules, by: tuple[str, ...] = ()
) -> DataFrame:
    """One provider per patient (and per ``by`` value) by the configured rule.

    Two combinable aggregates: claims per (patient, provider), then the smallest ordering
    key per patient. Ties go to the provider id in string order.
    """
    day = F.col(rules.date_col).cast("date")
    per_pair = (
        candidate_events(events, rules)
        .where(day.isNotNull())
        .groupBy(
            *by,
            F.col(rules.patient_col).alias("patient_id"),
            F.col(rules.hcp_col).cast("string").alias("hcp_id"),
        )
        .agg(
            F.count("*").alias("attribution_claim_count"),
            F.max(day).alias("attribution_last_date"),
        )
    )
    count, last = -F.col("attribution_claim_count"), -F.unix_date("attribution_last_date")
    order = (last, count) if rules.rule == RECENT else (count, last)
    return (
        per_pair.groupBy(*by, "patient_id")
        .agg(
            F.min_by(
                F.struct("hcp_id", "attribution_claim_count", "attribution_last_date"),
                F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "hcp_id"),
            ).alias("winner")
        )
        .select(
            *by,
            "patient_id",
            "winner.hcp_id",
            F.lit(rules.rule).alias("attribution_method"),
            "winner.attribution_claim_count",
            "winner.attribution_last_date",
        )
    )


def existing_conflicts(mapping: DataFrame) -> DataFrame:
    """Patients mapped to more than one provider."""
    return (
        mapping.groupBy("patient_id")
        .agg(F.count_distinct("hcp_id").alias("providers"))
        .where("providers > 1")
    )


def existing_attribution(
    existing: DataFrame, rules: AttributionRules, *, check: bool = True
) -> DataFrame:
    """A supplied business mapping in attribution form; conflicting rows are an error."""
    options = dict.fromkeys((rules.existing_col, rules.hcp_col, "hcp_id"))
    present = [c for c in options if c in existing.columns]
    filled = existing.agg(*[F.count(c).alias(c) for c in present]).first() if present else {}
    column = next((c for c in present if filled[c]), None)
    if column is None:
        raise ValueError(f"existing attribution needs one of {list(options)}")
    _require(existing, [rules.patient_col, column], "existing_attribution")
    mapping = (
        existing.select(
            F.col(rules.patient_col).alias("patient_id"),
            F.col(column).cast("string").alias("hcp_id"),
        )
        .dropna()
        .distinct()
    )
    if check:
        examples = [r["patient_id"] for r in existing_conflicts(mapping).take(5)]
        if examples:
            raise ValueError(
                f"Existing attribution contains multiple HCPs for a patient: {examples}"
            )
    return mapping.select(
        "patient_id",
        "hcp_id",
        F.lit(EXISTING).alias("attribution_method"),
        F.lit(None).cast("bigint").alias("attribution_claim_count"),
        F.lit(None).cast("date").alias("attribution_last_date"),
    )


def attribute_patients(
    events: DataFrame, rules: AttributionRules, existing: DataFrame | None = None
) -> DataFrame:
    """Existing attribution first, the rule for the patients it leaves open."""
    if existing is None and rules.existing_col in events.columns:
        if events.where(F.col(rules.existing_col).isNotNull()).limit(1).count():
            existing = events
    if rules.rule == EXISTING:
        if existing is None:
            raise ValueError("existing_attribution needs a mapping or its column")
        return existing_attribution(existing, rules)
    by_rule = rule_attribution(events, rules)
    if existing is None or not rules.prefer_existing:
        return by_rule
    known = existing_attribution(existing, rules)
    return known.unionByName(by_rule.join(known, "patient_id", "left_anti"))
