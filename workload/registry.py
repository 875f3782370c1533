"""Every operator as a query over the generated tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.output import csv_safe
from tidemark.operators import asof, intervals, metrics, quality, ranking
from tidemark.operators.attribution import attribute_patients, rule_attribution
from tidemark.operators.opportunity import opportunity_metrics, score_opportunities
from tidemark.operators.ordered import exact_quantiles
from tidemark.operators.skew import hot_keys
from tidemark.operators.stage import checkpoint_dir, freeze, stored
from tidemark.params import AttributionRules, OpportunityRules, OpportunityScore, TargetRules
from tidemark.plans import cohort as cohorts
from tidemark.plans import delivery, features, models, splits, targets
from tidemark.plans.events import build_events, event_claims, raw_events
from tidemark.plans.history import HistoryEncoder, eligible_events, token_counts
from tidemark.plans.prepared import Prepared, ScoringBatch, prepared_violations, scoring_violations
from tidemark.plans.sequences import (
    encode_claims,
    encode_sequences,
    fit_vocabularies,
    sequence_split,
    sequence_tail,
    sequence_violations,
)
from tidemark.sources.audit import Audit
from tidemark.sources.export import content_digest, file_differences, write_file_manifest
from tidemark.sources.projections import explode_diagnoses, in_scope, patient_scope
from tidemark.sources.sinks import order_violations, write_field_csv

from .tables import PRIORITIES, SCORING_DATE, STUDY, canonical, source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROBE = date(1999, 7, 1)
SCORE = "score"
#: Rows of a key from which the queries named ``..._hot`` take the salted path.
SMALL_HOT = 50


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a comparable precision."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


def eligible_and_hot(
    spark: SparkSession, sf_dir: str, fills: tuple[str, ...] = ("*",)
) -> tuple[dict[str, DataFrame], DataFrame, list[tuple]]:
    """Canonical tables, the stored eligible snapshots and the hot patients.

    The fills are a join of four source tables and are read by every plan that follows, so they
    are derived and written once. ``fills`` names the columns of theirs that the query and the
    cohort read; no other is shuffled or written.
    """
    tables = canonical(spark, sf_dir)
    tables["pharmacy_claims"] = stored(tables["pharmacy_claims"].select(*fills))
    hot = cohorts.hot_patients(tables)
    return tables, stored(cohorts.build_cohort(tables, STUDY, hot=hot).snapshots), hot


def eligible(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return eligible_and_hot(spark, sf_dir)[:2]


def scored(snapshots: DataFrame) -> DataFrame:
    """A score every engine computes alike, with ties: an integer expression in hundredths."""
    mixed = (F.col("covered_days") * 7 + F.col("maximum_gap_days") * 3) % 101
    return snapshots.withColumn(SCORE, mixed / F.lit(100.0))


def latest_scored(snapshots: DataFrame) -> DataFrame:
    return freeze(ranking.latest_assessments(scored(snapshots), check=False))


# --- evidence ---------------------------------------------------------------------------


@query("profile_tables")
def _(spark, sf):
    return quality.table_profile(canonical(spark, sf))


@query("medical_grain")
def _(spark, sf):
    return quality.medical_grain(canonical(spark, sf)["medical_claims"])


@query("diagnosis_frequency")
def _(spark, sf):
    return quality.diagnosis_frequency(canonical(spark, sf)["medical_claims"])


@query("pharmacy_status")
def _(spark, sf):
    return quality.pharmacy_status(canonical(spark, sf)["pharmacy_claims"])


@query("drug_id_shape")
def _(spark, sf):
    return quality.identifier_shape(canonical(spark, sf)["pharmacy_claims"], "drug_id")


def touching(mapping: DataFrame) -> DataFrame:
    """The mapping with every interval a day longer, so that split drugs overlap."""
    return mapping.withColumn("effective_end", F.date_add("effective_end", 1))


@query("mapping_multiplicity")
def _(spark, sf):
    t = canonical(spark, sf)
    return quality.mapping_multiplicity(t["pharmacy_claims"], touching(t["therapy_mapping"]))


@query("mapping_overlap")
def _(spark, sf):
    return asof.mapping_overlaps(touching(canonical(spark, sf)["therapy_mapping"]))


@query("enrollment_quality")
def _(spark, sf):
    return quality.enrollment_quality(canonical(spark, sf)["enrollment"])


def defective(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The canonical tables with planted defects."""
    med, rx = tables["medical_claims"], tables["pharmacy_claims"]
    rejected = F.col("status") == "rejected"
    return {
        **tables,
        "medical_claims": med.withColumns(
            {
                "provider_id": F.when(rejected, F.concat(F.lit("x"), "provider_id")).otherwise(
                    F.col("provider_id")
                ),
                "status": F.when(rejected, "denied").otherwise(F.col("status")),
                "available_date": F.date_sub("available_date", 3),
            }
        ),
        "pharmacy_claims": rx.withColumns(
            {
                "quantity": F.col("quantity") - 5,
                "reversal_date": F.date_sub("reversal_date", 31),
                "plan_id": F.lower("plan_id"),
            }
        ),
        "enrollment": tables["enrollment"].withColumn(
            "coverage_end", F.date_sub("coverage_end", 1300)
        ),
        "therapy_mapping": tables["therapy_mapping"].withColumn(
            "effective_start", F.nullif("effective_start", F.lit(date(1998, 7, 1)))
        ),
    }


@query("table_violations")
def _(spark, sf):
    return quality.table_violations(defective(canonical(spark, sf)))


@query("content_digest")
def _(spark, sf):
    parts = [
        content_digest(df).withColumn("table", F.lit(n)) for n, df in canonical(spark, sf).items()
    ]
    return quality.union_all(parts)


@query("audit_tables")
def _(spark, sf):
    """Profile and digest of the canonical tables, observed while they are written."""
    audit = Audit(spark, scratch(spark))
    for name, df in canonical(spark, sf).items():
        audit.write(df, name)
    return audit.frame()


@query("audit_cohort")
def _(spark, sf):
    """Candidates by outcome, observed while the cohort is written."""
    audit = Audit(spark, scratch(spark))
    cohorts.write_cohort(canonical(spark, sf), STUDY, audit)
    return audit.frame()


@query("manifest_changes")
def _(spark, sf):
    """Rows by table and state of file, after one file was added, one table rewritten and one
    left alone since the manifest."""
    folder, t = scratch(spark), canonical(spark, sf)
    names = ("providers", "plans", "enrollment")
    for name in names:
        t[name].write.parquet(f"{folder}/{name}.parquet")
    write_file_manifest(spark, folder, names)
    one = t["providers"].where(F.col("geography") == "FRANCE")
    one.coalesce(1).write.mode("append").parquet(f"{folder}/providers.parquet")
    t["plans"].withColumn("plan_id", F.lower("plan_id")).write.mode("overwrite").parquet(
        f"{folder}/plans.parquet"
    )
    return file_differences(spark, folder, names).groupBy("table", "state").agg(
        F.sum(F.coalesce("rows_now", "rows")).alias("rows")
    )


@query("csv_safe")
def _(spark, sf):
    """Product names behind every leading sign, as a field file would show them."""
    part = source(spark, sf, "part")
    sign = F.element_at(
        F.array(*[F.lit(s) for s in ("=", "+", "-", "@", " =", "", "'")]),
        (F.col("p_partkey") % 7 + 1).cast("int"),
    )
    return csv_safe(part.select("p_partkey", F.concat(sign, "p_name").alias("name"), "p_brand"))


# --- as-of and intervals ----------------------------------------------------------------


@query("effective_mapping")
def _(spark, sf):
    t = canonical(spark, sf)
    return asof.effective_mapping(
        t["pharmacy_claims"], t["therapy_mapping"], check=False
    ).select("claim_id", "patient_id", "fill_date", "drug_id", "therapy_class")


@query("known_claims_asof")
def _(spark, sf):
    """Per patient at one date: known claims by state as of that date."""
    t = canonical(spark, sf)
    at = t["patients"].select("patient_id", F.lit(PROBE).alias("index_date"))
    known = asof.known_claims(t["pharmacy_claims"], "fill_date", at, STUDY.timeline.lag_days)
    return known.groupBy("patient_id", "status").agg(
        F.count("*").alias("claims"),
        F.max("fill_date").alias("last_fill"),
        F.count_if(F.col("status").isin("paid", "final")).alias("valid_claims"),
    )


@query("coverage_union")
def _(spark, sf):
    """Union cover of all valid fills in one calendar year, per patient."""
    t = canonical(spark, sf)
    low, high = date(1998, 1, 1), date(1999, 1, 1)
    fills = t["pharmacy_claims"].where(F.col("status").isin("paid", "final")).select(
        "patient_id",
        F.col("fill_date").alias("s"),
        F.date_add("fill_date", F.col("days_supply")).alias("e"),
    )
    nothing = t["patients"].select(
        "patient_id", F.lit(low).alias("s"), F.lit(low).alias("e")
    )
    spans = fills.unionByName(nothing).withColumns({"low": F.lit(low), "high": F.lit(high)})
    return intervals.coverage(spans, ["patient_id"], "s", "e", "low", "high").drop("low", "high")


@query("enrollment_islands")
def _(spark, sf):
    return intervals.islands(
        canonical(spark, sf)["enrollment"], "patient_id", "coverage_start", "coverage_end"
    )


# --- cohort -----------------------------------------------------------------------------


@query("candidates")
def _(spark, sf):
    return cohorts.snapshot_candidates(canonical(spark, sf), STUDY.timeline)


@query("candidates_provided")
def _(spark, sf):
    """Three monthly assessments from each patient's own first date, month ends clamped."""
    t = canonical(spark, sf)
    own = F.date_add(F.lit(date(1998, 1, 1)), (F.col("patient_id").cast("int") % 31))
    t["patients"] = t["patients"].withColumn("index_date", own)
    return cohorts.snapshot_candidates(t, replace(STUDY.timeline, strategy="provided"))


@query("cohort_labels")
def _(spark, sf):
    return cohorts.build_cohort(canonical(spark, sf), STUDY).snapshots


@query("cohort_exclusions")
def _(spark, sf):
    return cohorts.build_cohort(canonical(spark, sf), STUDY).exclusions


@query("cohort_hot")
def _(spark, sf):
    """The snapshots with every patient over a small bound on the salted path."""
    t = canonical(spark, sf)
    return cohorts.build_cohort(t, STUDY, hot=cohorts.hot_patients(t, SMALL_HOT)).snapshots


@query("exclusion_counts")
def _(spark, sf):
    return cohorts.build_cohort(canonical(spark, sf), STUDY).exclusion_counts()


@query("scoring_cohort")
def _(spark, sf):
    return delivery.scoring_cohort(canonical(spark, sf), STUDY, SCORING_DATE).snapshots


@query("cohort_written")
def _(spark, sf):
    """Both outputs of one written derivation: every candidate with its outcome."""
    audit = Audit(spark, scratch(spark))
    made = cohorts.write_cohort(canonical(spark, sf), STUDY, audit)
    kept = made.snapshots.select(
        "snapshot_id", "patient_id", "index_date", F.lit(cohorts.KEPT).alias("reason")
    )
    return kept.unionByName(made.exclusions)


@query("timeline_differences")
def _(spark, sf):
    """Supplied snapshots with every outcome a day late, against a fresh derivation."""
    t, s = eligible(spark, sf)
    late = s.withColumn("outcome_date", F.date_add("outcome_date", 1))
    return cohorts.timeline_differences(late, t, STUDY)


# --- events and features ----------------------------------------------------------------


@query("events")
def _(spark, sf):
    t, s = eligible(spark, sf)
    return build_events(t, s)


@query("features_counts")
def _(spark, sf):
    t, s = eligible(spark, sf)
    return rounded(features.count_features(t, s, STUDY), 2)


@query("features_counts_hot")
def _(spark, sf):
    """Claim counts with every patient over a small bound on the salted path."""
    t, s = eligible(spark, sf)
    hot = cohorts.hot_patients(t, SMALL_HOT)
    return rounded(features.count_features(t, s, STUDY, hot=hot), 2)


@query("features_coverage")
def _(spark, sf):
    t, s = eligible(spark, sf)
    return rounded(features.coverage_features(t, s, STUDY))


@query("features_therapy")
def _(spark, sf):
    t, s = eligible(spark, sf)
    return features.therapy_features(t, s, STUDY)


@query("features_peers")
def _(spark, sf):
    t, s = eligible(spark, sf)
    return features.peer_features(t, s, STUDY)


@query("features_peers_hot")
def _(spark, sf):
    """Peer counts with patients and prescribers over a small bound on the salted path."""
    t, s = eligible(spark, sf)
    busy = hot_keys(t["pharmacy_claims"], ["prescriber_id"], SMALL_HOT)
    return features.peer_features(
        t, s, STUDY, hot=cohorts.hot_patients(t, SMALL_HOT), hot_prescribers=busy
    )


@query("features_payer")
def _(spark, sf):
    t, s = eligible(spark, sf)
    return features.payer_features(t, s)


@query("features_wide")
def _(spark, sf):
    _, wide = with_features(spark, sf)
    return rounded(wide, 4)


#: Columns of the fills that events and the cohort read.
EVENT_FILLS = (
    "claim_id", "patient_id", "fill_date", "available_date", "status", "reversal_date", "drug_id",
    "therapy_class", "days_supply", "prescriber_id",
)


#: Columns of the fills that the feature table and the cohort read.
FEATURE_FILLS = (*EVENT_FILLS, "patient_cost")


def with_features(spark, sf):
    """The eligible snapshots and their feature table."""
    t, s, hot = eligible_and_hot(spark, sf, FEATURE_FILLS)
    return s, features.build_features(t, s, STUDY, hot=hot)


def with_events(spark, sf):
    t, s, hot = eligible_and_hot(spark, sf, EVENT_FILLS)
    return t, s, stored(raw_events(t, s, hot=hot))


@query("history_vocab")
def _(spark, sf):
    _, s, e = with_events(spark, sf)
    counts = token_counts(eligible_events(e, s))
    return counts.orderBy(F.desc("events"), F.asc("history_token")).limit(24)


@query("history_features")
def _(spark, sf):
    _, s, e = with_events(spark, sf)
    encoder = HistoryEncoder().fit(e, s, check=False)
    return rounded(encoder.transform(e, s, check=False))


@query("sequence_vocab")
def _(spark, sf):
    t, s, hot = eligible_and_hot(spark, sf, EVENT_FILLS)
    events = stored(raw_events(t, s, hot=hot)) if hot else event_claims(t, s)
    return fit_vocabularies(events, STUDY.sequence.min_frequency)


@query("sequence_tail")
def _(spark, sf):
    _, _, e = with_events(spark, sf)
    return sequence_tail(e, STUDY.sequence.max_length).select(
        "snapshot_id", "event_id", "event_date", "time_since_previous_event", "position"
    )


def encoded(spark, sf):
    t, s, hot = eligible_and_hot(spark, sf, EVENT_FILLS)
    if hot:  # the events of a hot patient are spread over several tasks
        events = stored(raw_events(t, s, hot=hot))
        vocabularies = stored(fit_vocabularies(events, STUDY.sequence.min_frequency))
        return encode_sequences(events, s, vocabularies, STUDY.sequence), vocabularies
    claims = event_claims(t, s)
    vocabularies = stored(fit_vocabularies(claims, STUDY.sequence.min_frequency))
    return encode_claims(claims, s, vocabularies, STUDY.sequence), vocabularies


@query("sequence_encoded")
def _(spark, sf):
    """Padded arrays as joined strings."""
    out, _ = encoded(spark, sf)
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    whole = lambda c: F.transform(c, lambda x: x.cast("int"))
    return out.select(
        "snapshot_id",
        "label",
        *[joined(c).alias(c) for c in ("event_type_ids", "code_ids", "therapy_class_ids",
                                       "specialty_ids", "attention_mask")],
        *[joined(whole(c)).alias(c) for c in ("time_delta_days", "days_before_index")],
        joined("event_dates").alias("event_dates"),
        "length",
    )


@query("sequence_split")
def _(spark, sf):
    """Channel sums over the zipped model input."""
    out, _ = encoded(spark, sf)
    zipped = sequence_split(out)

    def total(i: int):
        zero = F.lit(0).cast("bigint")
        return F.aggregate("values", zero, lambda a, v: a + v[i].cast("bigint"))

    return zipped.select("snapshot_id", *[total(i).alias(f"channel_{i}") for i in range(5)])


@query("sequence_violations")
def _(spark, sf):
    """Sequences checked against vocabularies one token short, so one rule fires."""
    out, vocabularies = encoded(spark, sf)
    sizes = {
        r["vocab_key"]: r["n"] - 1
        for r in vocabularies.groupBy("vocab_key").agg(F.count("*").alias("n")).collect()
    }
    return sequence_violations(out, sizes, STUDY.sequence.max_length)


# --- splits -----------------------------------------------------------------------------


@query("temporal_split")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return splits.temporal_split(s, STUDY.split).select(
        "snapshot_id", "patient_id", "index_date", "label", "split"
    )


@query("temporal_cuts")
def _(spark, sf):
    """Cut dates from the patients' first index dates."""
    _, s = eligible(spark, sf)
    rules = replace(STUDY.split, train_end=None, validation_end=None)
    a, b = splits.temporal_cuts(s, rules)
    return s.agg(F.count("*").alias("snapshots")).select(
        "snapshots", F.lit(a).alias("train_end"), F.lit(b).alias("validation_end")
    )


@query("split_manifest")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return splits.split_manifest(splits.temporal_split(s, STUDY.split))


@query("split_counts")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return splits.split_counts(splits.temporal_split(s, STUDY.split))


@query("tabular_split_violations")
def _(spark, sf):
    """Parts of which one has another type, one another order and rows without a label."""
    _, s = eligible(spark, sf)
    split = splits.temporal_split(s, STUDY.split).withColumnsRenamed(
        {"covered_days": "cover", "maximum_gap_days": "gap"}
    )
    part = lambda n: split.where(F.col("split") == n)
    names = ("cover", "gap")
    return splits.tabular_split_violations(
        {
            "train": (part("train"), names),
            "validation": (part("validation").withColumn("cover", F.col("cover") / 2), names),
            "test": (part("test").withColumn("label", F.nullif("label", F.lit(1))), (*names[::-1], "outcome_date")),
            "later": (part("train").where("1 = 0"), names),
        }
    )


@query("sequence_split_violations")
def _(spark, sf):
    """Sequence parts of which one is shorter and lacks the rows of some targets."""
    out, _ = encoded(spark, sf)
    values = sequence_split(out).select("snapshot_id", "values", "label")
    even = F.substring("snapshot_id", -3, 1).cast("int") % 2 == 0  # the month
    parts = {
        "train": values.where(even),
        "validation": values.where(~even & (F.col("label") == 0)).withColumn("values", F.slice("values", 1, 5)),
        "test": values.where(even).withColumn("values", F.transform("values", lambda v: F.slice(v, 1, 4))),
    }
    targets = {"train": parts["train"], "validation": values.where(~even), "test": values.where(even & (F.col("label") == 0))}
    return splits.sequence_split_violations(freeze(splits.sequence_shapes(parts, targets)))


@query("stratified_split")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return splits.stratified_split(s, STUDY.split).select("snapshot_id", "patient_id", "split")


# --- ranking and metrics ----------------------------------------------------------------


@query("latest_snapshot")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return ranking.latest_assessments(s, as_of=PROBE).select(
        "patient_id", "snapshot_id", "index_date"
    )


@query("rank_patients")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return ranking.rank_patients(scored(s), SCORE, fraction=0.1)


@query("capture_metrics")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return rounded(ranking.capture_metrics(scored(s), SCORE, fraction=0.1, check=False))


@query("class_metrics")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return rounded(
        metrics.classification_metrics(latest_scored(s), "label", SCORE, threshold=0.5)
    )


@query("ranking_metrics")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return rounded(metrics.ranking_metrics(latest_scored(s), "label", SCORE))


@query("evaluate_predictions")
def _(spark, sf):
    _, s = eligible(spark, sf)
    wide = metrics.evaluate_predictions(latest_scored(s), "label", SCORE)
    names = {c: c.lower().replace("@", "_at_").replace("%", "pct") for c in wide.columns}
    return rounded(wide.withColumnsRenamed(names))


@query("prediction_problems")
def _(spark, sf):
    """Violation counts of scores stretched beyond the unit interval."""
    _, s = eligible(spark, sf)
    wild = scored(s).withColumn(SCORE, F.col(SCORE) * 2 - 0.5)
    return metrics.prediction_problems(wild, "label", SCORE)


@query("threshold_tuning")
def _(spark, sf):
    """The best threshold by every objective."""
    _, s = eligible(spark, sf)
    return rounded(
        metrics.tune_thresholds(
            latest_scored(s), "label", SCORE, metrics.OBJECTIVES, target_recall=0.5
        )
    )


@query("threshold_grid")
def _(spark, sf):
    _, s = eligible(spark, sf)
    grid = [i / 20 for i in range(21)]
    return rounded(metrics.threshold_curve(latest_scored(s), "label", SCORE, thresholds=grid))


@query("class_imbalance")
def _(spark, sf):
    _, s = eligible(spark, sf)
    return rounded(metrics.class_imbalance(s, "label"))


# --- providers --------------------------------------------------------------------------


def all_provider_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Every claim as a provider event: who, when, in which role, and whether it counts."""
    specialties = tables["providers"].select("provider_id", "specialty")
    valid = F.col("status").isin("paid", "final")
    visits = tables["medical_claims"].select(
        "patient_id", "provider_id", "claim_date", F.lit("visit").alias("role"),
        F.when(valid, "Yes").otherwise("no").alias("is_relevant"),
    )
    fills = tables["pharmacy_claims"].select(
        "patient_id", F.col("prescriber_id").alias("provider_id"),
        F.col("fill_date").alias("claim_date"), F.lit("Prescriber").alias("role"),
        F.when(valid, "Yes").otherwise("no").alias("is_relevant"),
    )
    return visits.unionByName(fills).join(specialties, "provider_id", "left")


def _attributed(spark, sf, method: str, **options) -> DataFrame:
    events = all_provider_events(canonical(spark, sf))
    rules = AttributionRules(method=method, relevant_col="is_relevant", **options)
    return rule_attribution(events, rules)


@query("attribution_recent")
def _(spark, sf):
    return _attributed(spark, sf, "recent_prescriber", role_col="role")


@query("attribution_plurality")
def _(spark, sf):
    return _attributed(spark, sf, "plurality")


@query("attribution_specialist")
def _(spark, sf):
    return _attributed(spark, sf, "frequent_specialist", specialists=("europe", "Asia"))


def business_mapping(tables: dict[str, DataFrame]) -> DataFrame:
    """A supplied mapping for the patients of one plan group: provider by patient number."""
    key = F.col("patient_id").cast("bigint")
    return (
        tables["enrollment"]
        .where(F.col("plan_id").isin("BUILDING", "AUTOMOBILE"))
        .select("patient_id", (key % 10).cast("string").alias("attributed_provider_id"))
    )


@query("attribution_existing")
def _(spark, sf):
    t = canonical(spark, sf)
    rules = AttributionRules(method="plurality", relevant_col="is_relevant")
    return attribute_patients(all_provider_events(t), rules, business_mapping(t))


OPPORTUNITY = OpportunityRules(
    score_col=SCORE, threshold=None, threshold_percentile=90.0, top_fractions=(0.05, 0.1, 0.2)
)


def _opportunity(spark, sf):
    t, s = eligible(spark, sf)
    latest = latest_scored(s)
    rules = AttributionRules(method="plurality", relevant_col="is_relevant")
    return opportunity_metrics(
        latest, attribute_patients(all_provider_events(t), rules), OPPORTUNITY, check=False
    )


@query("hcp_opportunity")
def _(spark, sf):
    return rounded(_opportunity(spark, sf), 10)


WEIGHTS = {"expected_switchers": 2.0, "patients_top_10pct": 1.0, "eligible_patient_count": 1.0}


@query("hcp_score")
def _(spark, sf):
    # Sums are rounded before ranking, so equal providers tie whatever the summation order.
    rows = rounded(_opportunity(spark, sf), 10)
    return rounded(score_opportunities(rows, OpportunityScore(WEIGHTS, "minmax")), 10)


@query("hcp_score_percentile")
def _(spark, sf):
    rows = rounded(_opportunity(spark, sf), 10)
    return rounded(score_opportunities(rows, OpportunityScore(WEIGHTS, "percentile")), 10)


def _by_period(spark, sf, period: str) -> DataFrame:
    t, s = eligible(spark, sf)
    rules = TargetRules(
        attribution_rule="recent_prescriber",
        relevant_specialties=STUDY.targets.relevant_specialties,
        period=period,
    )
    events = stored(raw_events(t, s))
    out, _ = targets.period_targeting(scored(s), events, rules, SCORE, check=False)
    # The rank is left to hcp_score: here sums of scores differ in the last bit between engines.
    return rounded(out.drop("hcp_rank"), 10)


@query("hcp_by_month")
def _(spark, sf):
    return _by_period(spark, sf, "M")


@query("hcp_by_quarter")
def _(spark, sf):
    return _by_period(spark, sf, "Q")


def live_list(spark, sf):
    """Scoring cohort ranked by the comparable score, with events and attribution."""
    t = canonical(spark, sf)
    s = freeze(delivery.scoring_cohort(t, STUDY, SCORING_DATE).snapshots)
    patients = freeze(ranking.rank_patients(scored(s), SCORE, fraction=0.2, check=False))
    events = raw_events(t, s)
    return t, freeze(targets.attributed_patients(patients, events, STUDY.targets))


@query("field_targets")
def _(spark, sf):
    t, attributed = live_list(spark, sf)
    return targets.field_targets(attributed, t["providers"], STUDY.targets, SCORING_DATE)


@query("field_coverage")
def _(spark, sf):
    _, attributed = live_list(spark, sf)
    return targets.field_coverage(attributed, replace(STUDY.targets, minimum_priority_patients=2))


@query("target_view")
def _(spark, sf):
    t, attributed = live_list(spark, sf)
    table = targets.field_targets(attributed, t["providers"], STUDY.targets, SCORING_DATE)
    view = targets.target_view(
        table, search="SUPPLIER", specialty="EUROPE", sort="eligible_patient_count",
        ascending=False, top=12,
    )
    return view


@query("field_file")
def _(spark, sf):
    """The field file written in rank order: rules on what stands there, and its rows."""
    t, attributed = live_list(spark, sf)
    table = targets.field_targets(attributed, t["providers"], STUDY.targets, SCORING_DATE)
    folder = scratch(spark)
    write_field_csv(table, folder, order=[("hcp_rank", True)])
    found = order_violations(spark, folder, "hcp_rank")
    rows = spark.read.option("header", True).csv(folder)
    return found.unionByName(quality.grouped(rows, "field", "rows"))


# --- sources ----------------------------------------------------------------------------


def source_visits(spark, sf) -> DataFrame:
    """Orders of a customer on one day as a visit with the array of its priorities."""
    orders = source(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    urgent = F.col("o_orderpriority").isin(*PRIORITIES)
    return orders.groupBy(
        F.col("o_custkey").cast("string").alias("patient_id"), day.alias("service_date")
    ).agg(
        F.array_sort(F.collect_set(F.when(urgent, F.col("o_orderpriority")))).alias("diagnoses"),
        F.concat(F.lit("PX"), F.min("o_orderkey") % 10).alias("procedure"),
        F.date_add(F.col("service_date"), 2).alias("available_date"),
        F.concat("patient_id", F.lit("-"), F.col("service_date")).alias("event_id"),
    )


@query("diagnosis_explode")
def _(spark, sf):
    return explode_diagnoses(
        source_visits(spark, sf),
        event_id="event_id",
        diagnoses="diagnoses",
        procedure="procedure",
        keep=("patient_id", "service_date"),
    )


@query("patient_scope")
def _(spark, sf):
    """Fills of the patients in scope inside the extraction window, per patient."""
    start, end = date(1998, 1, 1), date(1998, 6, 30)
    scope = patient_scope(
        source_visits(spark, sf), patient="patient_id", diagnoses="diagnoses",
        service="service_date", available="available_date", codes=PRIORITIES[:1],
        start=start, end=end,
    )
    rx = canonical(spark, sf)["pharmacy_claims"]
    kept = in_scope(rx, scope, service="fill_date", start=start, end=end)
    return kept.groupBy("patient_id").agg(F.count("*").alias("fills"))


# --- leakage ----------------------------------------------------------------------------


@query("post_index_events")
def _(spark, sf):
    t = canonical(spark, sf)
    at = t["patients"].select("patient_id", F.lit(PROBE).alias("index_date"))
    return quality.late_events(t["medical_claims"], at, "claim_date", key="patient_id").select(
        "claim_id", "patient_id", "claim_date", "index_date"
    )


@query("event_date_violations")
def _(spark, sf):
    """Claims against probe dates that some patients lack and some have twice."""
    t = canonical(spark, sf)
    number = F.col("patient_id").cast("bigint")
    at = t["patients"].select("patient_id", F.lit(PROBE).alias("index_date")).where(number % 5 > 0)
    twice = at.unionByName(at.where(number % 7 == 0))
    return quality.event_date_violations(t["medical_claims"], twice, "claim_date", key="patient_id")


@query("feature_violations")
def _(spark, sf):
    """A feature table with an outcome among the predictors, infinite ratios and repeated rows."""
    _, s = eligible(spark, sf)
    wide = s.select(
        "snapshot_id",
        F.col("index_date").alias("feature_as_of"),
        F.when(F.col("maximum_gap_days") > 100, float("inf")).otherwise(F.col("covered_days") / 180.0)
        .alias("covered"),
        F.col("label").alias("label"),
    )
    return quality.feature_violations(wide.unionByName(wide.where("label = 1")))


@query("event_timing")
def _(spark, sf):
    """Prepared-bundle rules with planted defects: late cutoffs and outcomes before index."""
    t, s = eligible(spark, sf)
    bad = s.withColumns(
        {
            "outcome_date": F.date_sub("outcome_date", 60),
            "feature_cutoff": F.date_sub("feature_cutoff", 20),
        }
    )
    wide = s.select("snapshot_id", F.date_add("index_date", 1).alias("feature_as_of"),
                    F.col("covered_days").cast("double").alias("covered"))
    bundle = Prepared(bad, wide, raw_events(t, s), ("covered",))
    return prepared_violations(bundle, STUDY).where("violations > 0")


@query("scoring_violations")
def _(spark, sf):
    """Live-batch rules on a batch whose cutoffs ignore the lag."""
    t = canonical(spark, sf)
    s = freeze(delivery.scoring_cohort(t, STUDY, SCORING_DATE).snapshots)
    bad = s.withColumn("feature_cutoff", F.col("index_date"))
    wide = s.select("snapshot_id", F.col("index_date").alias("feature_as_of"),
                    F.col("covered_days").cast("double").alias("covered"))
    batch = ScoringBatch(bad, wide, raw_events(t, s), t["providers"], ("covered",))
    live = delivery.scoring_study(STUDY, SCORING_DATE)
    return scoring_violations(batch, live, SCORING_DATE).where("violations > 0")


# --- models -----------------------------------------------------------------------------


@query("exact_medians")
def _(spark, sf):
    """Training medians used for imputation."""
    _, s = eligible(spark, sf)
    return exact_quantiles(s, ["covered_days", "maximum_gap_days"], 0.5)


@query("model_matrix")
def _(spark, sf):
    """The sparse matrix over all predictors, with gaps in two of them filled."""
    _, made = with_features(spark, sf)
    names = features.feature_names(STUDY)
    wide = made.withColumns(
        {
            "age": F.nullif("age", F.lit(40)),
            "gender": F.when(F.col("therapies_tried") > 1, F.col("gender")),
        }
    )
    wide = stored(wide)
    fill = models.Imputation.fit(wide, names)
    return rounded(models.model_matrix(wide, names, fill), 4)


MODEL_FEATURES = [
    "age", "gender", "proportion_days_covered", "maximum_therapy_gap_days", "therapy_changes",
    "therapies_tried", "diagnosis_count_180d", "pharmacy_count_365d", "patient_cost_365d",
    "days_since_last_rx", "coverage_change", "payer_type",
]


@query("baseline_models")
def _(spark, sf):
    """Two baselines fitted on train, selected on validation, compared on held-out parts.

    The partitions are stratified so that every scale has both outcomes in each of them.
    """
    s, made = with_features(spark, sf)
    wide = made.select("snapshot_id", *MODEL_FEATURES)
    frame = freeze(splits.stratified_split(s, STUDY.split).join(wide, "snapshot_id"))
    parts = {n: frame.where(F.col("split") == n).drop("split") for n in splits.SPLITS}
    fitted = models.fit_baselines(
        parts["train"], parts["validation"], MODEL_FEATURES, seed=42, fraction=0.1
    )
    held_out = {n: parts[n] for n in ("validation", "test")}
    return models.comparison(fitted, held_out, 0.1)
