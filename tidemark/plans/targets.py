"""Provider targets from a patient list, and the per-period opportunity output."""

from __future__ import annotations

from datetime import date
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.claims import period_label, relevant
from ..functions.output import share_percent, targeting_reason
from ..operators.attribution import attribute_patients, rule_attribution
from ..operators.opportunity import opportunity_metrics, score_opportunities
from ..operators.ordered import scan_in_order
from ..operators.ranking import latest_assessments
from ..operators.skew import lookup
from ..params import AttributionRules, OpportunityRules, OpportunityScore, TargetRules
from ..schema import LeakageError

# fixed values: columns of the field table, in order
FIELD_COLUMNS = (
    "hcp_rank", "hcp_id", "specialty", "geography", "organization", "eligible_patient_count",
    "priority_patient_count", "priority_share_percent", "priority_tier", "targeting_reason",
    "assessment_date",
)


def provider_events(events: DataFrame, specialties: tuple[str, ...]) -> DataFrame:
    """Events in attribution form: role by event kind, relevance flag, provider columns."""
    renamed = events.withColumnsRenamed(
        {"hcp_id": "provider_id", "provider_specialty": "specialty"}
    )
    pharmacy = F.col("event_type").startswith("pharmacy")
    return renamed.withColumns(
        {
            "role": F.when(pharmacy, "prescriber").otherwise("visit"),
            "is_relevant": relevant(specialties),
        }
    )


def attribution_rules(rules: TargetRules) -> AttributionRules:
    return AttributionRules(
        method=rules.attribution_rule,
        date_col="event_date",
        relevant_col="is_relevant",
        role_col="role",
        specialists=rules.relevant_specialties,
    )


def hcp_targeting(
    scores: DataFrame,
    events: DataFrame,
    *,
    attribution: AttributionRules = AttributionRules(),
    opportunity: OpportunityRules = OpportunityRules(),
    score: OpportunityScore = OpportunityScore(),
    existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scored providers, patient attribution)."""
    mapped = attribute_patients(events, attribution, existing)
    return score_opportunities(opportunity_metrics(scores, mapped, opportunity), score), mapped


def period_targeting(
    scores: DataFrame, events: DataFrame, rules: TargetRules, score_col: str, *, check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Opportunity per provider and month or quarter, from each patient's latest snapshot in it.

    The period is one more grouping key; only events linked to the chosen snapshot count.
    """
    if check:
        repeated = scores.groupBy("snapshot_id").count().where("count > 1")
        if repeated.limit(1).count():
            raise ValueError("Duplicate patient scores for snapshot")
    labelled = scores.select(
        "patient_id",
        "snapshot_id",
        "index_date",
        score_col,
        period_label(F.col("index_date"), rules.period).alias("targeting_period"),
    )
    chosen = latest_assessments(labelled, by=("patient_id", "targeting_period"), check=False)
    own = chosen.select(
        "snapshot_id",
        F.col("patient_id").alias("_patient"),
        F.col("index_date").alias("_index"),
        "targeting_period",
    )
    linked = events.drop("index_date").join(own, "snapshot_id")
    if check:
        found = linked.agg(
            F.count_if(F.col("patient_id") != F.col("_patient")).alias("foreign"),
            F.count_if(
                (F.col("event_date") > F.col("_index"))
                | (F.col("available_date") > F.col("_index"))
            ).alias("late"),
        ).first()
        if found["foreign"]:
            raise ValueError("HCP event is linked to a different patient")
        if found["late"]:
            raise LeakageError("HCP attribution includes unavailable or future events")
    # Equal event ids inside a snapshot count once: the least row over all columns.
    named = provider_events(linked, rules.relevant_specialties)
    rest = [c for c in named.columns if c not in ("snapshot_id", "event_id")]
    used = (
        named.groupBy("snapshot_id", "event_id")
        .agg(F.min(F.struct(*rest)).alias("row"))
        .select("snapshot_id", "event_id", "row.*")
    )
    by = ("targeting_period",)
    attribution = rule_attribution(used, attribution_rules(rules), by)
    metrics = opportunity_metrics(
        chosen,
        attribution,
        OpportunityRules(
            score_col=score_col, threshold=None, threshold_percentile=rules.threshold_percentile
        ),
        by,
    )
    scored = score_opportunities(metrics, rules.score, by, check=check)
    ids = chosen.select("patient_id", "targeting_period", "snapshot_id")
    return scored, attribution.join(ids, ["patient_id", "targeting_period"])


def attributed_patients(
    patients: DataFrame, events: DataFrame, rules: TargetRules
) -> DataFrame:
    """The patient list with its attribution (null provider: unattributed)."""
    linked = events.join(patients.select("snapshot_id"), "snapshot_id", "left_semi")
    attribution = attribute_patients(
        provider_events(linked, rules.relevant_specialties), attribution_rules(rules)
    )
    return patients.join(attribution, "patient_id", "left")


def unknown_providers(attributed: DataFrame, providers: DataFrame) -> DataFrame:
    return (
        attributed.where(F.col("hcp_id").isNotNull())
        .select(F.col("hcp_id").alias("provider_id"))
        .distinct()
        .join(providers, "provider_id", "left_anti")
    )


def _per_provider(attributed: DataFrame) -> DataFrame:
    return (
        attributed.where(F.col("hcp_id").isNotNull())
        .groupBy("hcp_id")
        .agg(
            F.count_distinct("patient_id").alias("eligible_patient_count"),
            F.count_if("selected").alias("priority_patient_count"),
        )
    )


def field_targets(
    attributed: DataFrame, providers: DataFrame, rules: TargetRules, scoring_date: date
) -> DataFrame:
    """The provider table for the field: no patient columns, ranked and tiered."""
    hcp = (
        _per_provider(attributed)
        .withColumn(
            "priority_share_percent",
            share_percent(F.col("priority_patient_count"), F.col("eligible_patient_count")),
        )
        .where(F.col("priority_patient_count") >= rules.minimum_priority_patients)
    )
    ranked = scan_in_order(
        hcp,
        [
            ("priority_patient_count", False),
            ("priority_share_percent", False),
            ("hcp_id", True),
        ],
        position="hcp_rank",
    )
    size = hcp.count()
    first, second = (max(1, ceil(size * f)) for f in rules.tier_fractions)
    directory = providers.select(
        F.col("provider_id").alias("hcp_id"), "specialty", "geography", "organization"
    )
    return (
        lookup(ranked, directory, "hcp_id")
        .withColumns(
            {
                "hcp_rank": F.col("hcp_rank").cast("int"),
                "priority_tier": F.when(F.col("hcp_rank") <= first, "Tier 1")
                .when(F.col("hcp_rank") <= second, "Tier 2")
                .otherwise("Tier 3"),
                "targeting_reason": targeting_reason(
                    "priority_patient_count", "eligible_patient_count"
                ),
                "assessment_date": F.lit(scoring_date.isoformat()),
            }
        )
        .select(*FIELD_COLUMNS)
    )


def field_coverage(attributed: DataFrame, rules: TargetRules) -> DataFrame:
    """One row: how many patients are eligible, prioritised, attributed, exported, withheld."""
    none = F.col("hcp_id").isNull()
    per_provider = attributed.groupBy("hcp_id").agg(
        F.count("*").alias("patients"), F.count_if("selected").alias("priority")
    )
    exported = ~none & (F.col("priority") >= rules.minimum_priority_patients)
    zero = F.lit(0)

    def total(column: str, when=None):
        value = F.col(column) if when is None else F.when(when, F.col(column)).otherwise(zero)
        return F.coalesce(F.sum(value), zero).cast("bigint")

    return per_provider.agg(
        total("patients").alias("eligible_patients"),
        total("priority").alias("priority_patients"),
        total("patients", ~none).alias("attributed_patients"),
        total("patients", none).alias("unattributed_patients"),
        total("priority", none).alias("unattributed_priority_patients"),
        total("priority", exported).alias("exported_priority_patients"),
        total("priority", ~none & ~exported).alias("withheld_priority_patients"),
    )


def target_view(
    targets: DataFrame,
    *,
    search: str = "",
    specialty: str | None = None,
    geography: str | None = None,
    sort: str = "hcp_rank",
    ascending: bool = True,
    top: int | None = None,
) -> DataFrame:
    """The interactive table of the field report: search, filters, sort, leading bars."""
    text = F.lower(F.concat_ws(" ", "hcp_id", "organization"))
    view = targets.where(text.contains(search.lower()))
    if specialty:
        view = view.where(F.col("specialty") == specialty)
    if geography:
        view = view.where(F.col("geography") == geography)
    order = F.col(sort).asc() if ascending else F.col(sort).desc()
    view = view.orderBy(order, F.col("hcp_rank").asc())
    return view if top is None else view.limit(top)
