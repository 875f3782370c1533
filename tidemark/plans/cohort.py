"""Eligible patient snapshots, labels and the exclusion log.

The plan shuffles claims once, by patient. Pharmacy fills, diagnoses, enrolment runs and one
anchor row per patient are unioned into a narrow *timeline* and joined to the patient's index
dates with a residual predicate that keeps only the (claim, index date) pairs that can change
an answer:

* facts about the whole known history (first diagnosis, first fill, prior advanced therapy)
  need a never-reversed claim only at the first index date that knows it; a running minimum
  or maximum over the patient's index dates carries it on. Reversed claims are paired with
  each index date between becoming known and being reversed;
* coverage needs a fill at the index dates whose window its supply reaches;
* the outcome needs advanced fills at the index dates whose horizon contains them.

So the fan-out per claim is bounded by window lengths, not by the length of the history, and
everything after the join is grouped on keys that include the patient.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import is_advanced, is_conventional, is_valid, known_from, member, reversal
from ..operators.intervals import covered_days, islands, widest_gap, with_reach
from ..operators.skew import hot_keys, salted_join
from ..sources.audit import Audit, count_measures
from ..params import Study, Timeline

# fixed values: exclusion reasons, in the order they are tested
REASONS = (
    "future_index",
    "immature_label",
    "insufficient_observation_or_enrollment",
    "diagnosis_not_confirmed",
    "no_conventional_exposure",
    "insufficient_conventional_coverage",
    "no_conventional_coverage_on_index",
    "conventional_gap",
    "known_prior_advanced",
)
# fixed values: columns of a snapshot
SNAPSHOT_COLUMNS = (
    "snapshot_id", "patient_id", "cohort_id", "start_dt", "index_date", "feature_cutoff",
    "lookback_start", "prediction_end", "label_available_date", "resp", "label",
    "outcome_date", "eligible", "followup_complete", "covered_days", "maximum_gap_days",
)
OUTCOME_COLUMNS = ("label", "resp", "outcome_date", "label_available_date", "followup_complete")

_ANCHOR, _FILL, _DIAGNOSIS, _ENROLLED = 0, 1, 2, 3


def first_month_start(day: date) -> date:
    if day.day == 1:
        return day
    return (day.replace(day=1) + timedelta(days=32)).replace(day=1)


def snapshot_candidates(tables: dict[str, DataFrame], timeline: Timeline) -> DataFrame:
    """(patient, index date) pairs: supplied table, else the patient's own dates, else months."""
    t, patients = timeline, tables["patients"]
    if "snapshot_candidates" in tables:
        pairs = tables["snapshot_candidates"].select(
            "patient_id", F.col("index_date").cast("date").alias("index_date")
        )
        bad = pairs.groupBy("patient_id", "index_date").agg(F.count("*").alias("n")).where(
            F.col("patient_id").isNull() | F.col("index_date").isNull() | (F.col("n") > 1)
        )
        if bad.limit(1).count():
            raise ValueError("Every candidate needs a patient and an index date, and no pair may repeat")
        if pairs.join(patients, "patient_id", "left_anti").limit(1).count():
            raise ValueError("A candidate's patient is not in the patients table")
    elif "index_date" in patients.columns:
        if patients.where(F.col("index_date").isNull()).limit(1).count():
            raise ValueError("Every candidate needs a patient and an index date, and no pair may repeat")
        steps = F.sequence(F.lit(0), F.lit(t.snapshots_per_patient - 1))
        pairs = patients.select("patient_id", "index_date", F.explode(steps).alias("i")).select(
            "patient_id", F.add_months("index_date", F.col("i")).alias("index_date")
        )
    elif t.strategy == "monthly" and t.index_start and t.index_end:
        first = first_month_start(t.index_start)
        if first > t.index_end:
            return patients.select("patient_id", F.lit(first).alias("index_date")).limit(0)
        months = F.sequence(F.lit(first), F.lit(t.index_end), F.expr("interval 1 month"))
        pairs = patients.select("patient_id", F.explode(months).alias("index_date"))
    else:
        raise ValueError("No source of index dates: neither candidates nor patient dates nor a month range")
    if t.index_start:
        pairs = pairs.where(F.col("index_date") >= F.lit(t.index_start))
    if t.index_end:
        pairs = pairs.where(F.col("index_date") <= F.lit(t.index_end))
    return pairs


def hot_patients(tables: dict[str, DataFrame], hot_rows: int | None = None) -> list[tuple]:
    """Patients whose claims are too many for one task; reads the patient columns only."""
    ids = tables["pharmacy_claims"].select("patient_id").unionByName(
        tables["medical_claims"].select("patient_id")
    )
    return hot_keys(ids, ["patient_id"], hot_rows)


def _far(day: str) -> Column:
    return F.lit(day).cast("date")


# Bounds of empty and of unlimited ranges.
_EARLY, _LATE = "0001-01-01", "9999-12-31"


def _or_late(day: Column) -> Column:
    return F.coalesce(day, _far(_LATE))


def _timeline(tables: dict[str, DataFrame], study: Study) -> DataFrame:
    """Claims, enrolment runs and anchors, as narrow as they are shuffled.

    ``d .. d_end`` is the supply of a fill, an enrolment run or an observation period.
    """
    lag, rules = study.timeline.lag_days, study.cohort
    rx, med = tables["pharmacy_claims"], tables["medical_claims"]
    no, no_day = F.lit(False), F.lit(None).cast("date")
    fills = (
        rx.where(is_valid())
        .withColumns({"conv": is_conventional(study.arms), "adv": is_advanced(study.arms)})
        .where("conv or adv")
        .select(
            "patient_id",
            F.lit(_FILL).alias("kind"),
            F.col("fill_date").alias("d"),
            F.date_add("fill_date", F.greatest(F.lit(0), F.col("days_supply"))).alias("d_end"),
            known_from("fill_date", lag).alias("known"),
            F.greatest("fill_date", "available_date").alias("known_now"),
            reversal(rx).alias("gone"),
            "conv",
            "adv",
            no.alias("dx"),
            no.alias("cf"),
        )
    )
    diagnoses = (
        med.where(is_valid())
        .withColumns(
            {
                "dx": member("diagnosis_code", rules.diagnosis_codes),
                "cf": member("diagnosis_code", rules.confirmation_codes),
            }
        )
        .where("dx or cf")
        .select(
            "patient_id",
            F.lit(_DIAGNOSIS).alias("kind"),
            F.col("claim_date").alias("d"),
            no_day.alias("d_end"),
            known_from("claim_date", lag).alias("known"),
            no_day.alias("known_now"),
            reversal(med).alias("gone"),
            no.alias("conv"),
            no.alias("adv"),
            "dx",
            "cf",
        )
    )

    def plain(df: DataFrame, kind: int, start: str, end: str):
        return df.select(
            "patient_id",
            F.lit(kind).alias("kind"),
            F.col(start).alias("d"),
            F.col(end).alias("d_end"),
            *[no_day.alias(c) for c in ("known", "known_now", "gone")],
            *[no.alias(c) for c in ("conv", "adv", "dx", "cf")],
        )

    runs = islands(tables["enrollment"], "patient_id", "coverage_start", "coverage_end")
    enrolled = plain(runs, _ENROLLED, "island_start", "island_end")
    anchors = plain(tables["patients"], _ANCHOR, "observation_start", "observation_end")
    return fills.unionByName(diagnoses).unionByName(enrolled).unionByName(anchors)


def _with_ranges(timeline: DataFrame, study: Study, labelled: bool) -> DataFrame:
    """The index dates that the rows of the timeline matter to, as ranges.

    ``near_from .. near_to`` (closed) covers coverage, reversed facts, enrolment and anchors;
    ``event_from .. event_to`` covers outcomes; ``opens`` is the day a never-reversed fact
    becomes known. They are computed once per row, so the join compares plain dates.
    """
    t, window = study.timeline, study.cohort.coverage_window_days
    empty_from, empty_to = _far(_LATE), _far(_EARLY)
    kind, gone, known, now = F.col("kind"), F.col("gone"), F.col("known"), F.col("known_now")
    conv, adv, d, d_end = F.col("conv"), F.col("adv"), F.col("d"), F.col("d_end")
    fill, lasting = kind == _FILL, gone.isNull()
    ready = t.horizon_days + t.runout_days
    history = max(t.observation_days, t.history_days, window)
    follow = t.followup_days if labelled else 0

    known_adv = known if labelled else now
    first = F.when(conv & adv, F.least(known, known_adv)).when(conv, known).otherwise(known_adv)
    near_from = F.when(lasting, known).otherwise(first)
    covers_to = F.when(conv & (d_end > d), F.date_add("d_end", window - 2)).otherwise(empty_to)
    near_to = F.when(lasting, covers_to).otherwise(F.date_sub(gone, 1))
    # A claim of both arms with two first-known days is open from the earlier one on; the
    # facts themselves are decided per arm after the join.
    if not labelled:
        near_to = F.when(lasting & conv & adv, F.greatest(near_to, known)).otherwise(near_to)
        near_from = F.when(conv & adv, first).otherwise(near_from)
    event_from, event_to = empty_from, empty_to
    if labelled:
        outcome = fill & adv
        event_from = F.when(
            outcome, F.greatest(F.date_sub(d, t.horizon_days), F.date_sub(now, ready))
        ).otherwise(empty_from)
        event_to = F.when(
            outcome, F.least(F.date_sub(d, 1), F.date_sub(_or_late(gone), ready + 1))
        ).otherwise(empty_to)
    seen = fill | (kind == _DIAGNOSIS)

    def by_kind(of_fill: Column, of_reversed: Column, of_run: Column, whole: Column, never: Column):
        return (
            F.when(fill, of_fill)
            .when(kind == _DIAGNOSIS, F.when(lasting, never).otherwise(of_reversed))
            .when(kind == _ENROLLED, of_run)
            .otherwise(whole)
        )

    return timeline.withColumns(
        {
            "near_from": by_kind(near_from, known, F.date_add(d, history), empty_to, empty_from),
            "near_to": by_kind(
                near_to, F.date_sub(gone, 1), F.date_sub(d_end, follow), empty_from, empty_to
            ),
            "event_from": event_from,
            "event_to": event_to,
            "opens": F.when(seen & lasting, F.when(fill, first).otherwise(known)).otherwise(empty_from),
        }
    )


#: Candidates one task decides. With their claims and the sorts over them they take some 400 MB.
CANDIDATES_PER_TASK = 200_000


def tasks_for(candidates: DataFrame, per_task: int | None = None) -> int:
    """Tasks that the number of candidates asks for.

    A candidate takes a few bytes in a shuffle but meets many claims behind it, so the bytes
    shuffled say little about what a task will hold.
    """
    tasks = -(-candidates.count() // (per_task or CANDIDATES_PER_TASK))
    return max(tasks, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_patient(candidates: DataFrame, per_task: int | None = None) -> DataFrame:
    """Candidates dealt by patient over as many tasks as their number asks for."""
    return candidates.repartition(tasks_for(candidates, per_task), "patient_id")


def _dealt(tables: dict[str, DataFrame], pairs: DataFrame, timeline: Timeline, tasks: int) -> DataFrame:
    """The candidates by patient; those made from patients are made after these are dealt."""
    if "snapshot_candidates" in tables:
        return pairs.repartition(tasks, "patient_id")
    dealt = tables["patients"].repartition(tasks, "patient_id")
    return snapshot_candidates({**tables, "patients": dealt}, timeline)


def assess(
    tables: dict[str, DataFrame],
    study: Study,
    *,
    labelled: bool = True,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Every candidate with its facts and its first failing rule (null when eligible)."""
    t, rules = study.timeline, study.cohort
    index, before = F.col("index_date"), F.col("previous_index")
    order = Window.partitionBy("patient_id").orderBy("index_date")
    if hot is None:
        hot = hot_patients(tables)
    pairs, facts_of = snapshot_candidates(tables, t), _timeline(tables, study)
    if not hot:  # both are dealt narrow; dates are derived from them behind the shuffle
        tasks = tasks_for(pairs)
        pairs = _dealt(tables, pairs, t, tasks)
        facts_of = facts_of.repartition(tasks, "patient_id")
    candidates = pairs.withColumn(
        "previous_index", F.coalesce(F.lag("index_date").over(order), _far(_EARLY))
    )

    window = rules.coverage_window_days
    low, high = F.date_sub(index, window - 1), F.date_add(index, 1)
    end = F.date_add(index, t.horizon_days)
    mature = F.date_add(index, t.horizon_days + t.runout_days)
    history = max(t.observation_days, t.history_days, window)
    need_start = F.date_sub(index, history)
    need_end = F.date_add(index, t.followup_days) if labelled else index

    wanted = (
        ((F.col("near_from") <= index) & (index <= F.col("near_to")))
        | ((F.col("opens") <= index) & (F.col("opens") > before))
        | ((F.col("event_from") <= index) & (index <= F.col("event_to")))
    )
    if not labelled:  # a fill of both arms may open twice, once per arm's lag
        wanted = wanted | (
            F.col("conv") & F.col("adv") & (F.col("known") <= index) & (F.col("known") > before)
        )
    ranged = _with_ranges(facts_of, study, labelled)
    joined = salted_join(ranged, candidates, ["patient_id"], wanted, hot)

    kind, gone = F.col("kind"), F.col("gone")

    def opened(known: str) -> Column:
        return gone.isNull() & (F.col(known) <= index) & (F.col(known) > before)

    def passing(known: str) -> Column:
        return (F.col(known) <= index) & (index < gone)

    advanced_known = "known" if labelled else "known_now"
    is_fill, is_dx = kind == _FILL, kind == _DIAGNOSIS
    covers = (
        is_fill
        & F.col("conv")
        & (F.col("known") <= index)
        & (gone.isNull() | (gone > index))
        & (F.col("d_end") > low)
        & (F.col("d_end") > F.col("d"))
    )
    outcome = is_fill & F.col("adv") & F.lit(labelled)
    outcome = outcome & (F.col("event_from") <= index) & (index <= F.col("event_to"))

    def dated(*flags: Column) -> Column:
        return F.when(reduce(Column.__and__, flags), F.col("d"))

    facts = joined.select(
        "patient_id",
        "index_date",
        F.when(covers, F.greatest(F.col("d"), low)).alias("seg_start"),
        F.when(covers, F.least(F.col("d_end"), high)).alias("seg_end"),
        dated(is_fill, F.col("conv"), opened("known")).alias("fill_open"),
        dated(is_fill, F.col("conv"), passing("known")).alias("fill_closed"),
        F.when(is_fill & F.col("adv") & opened(advanced_known), 1).alias("adv_open"),
        F.when(is_fill & F.col("adv") & passing(advanced_known), 1).alias("adv_closed"),
        dated(is_dx, F.col("dx"), opened("known")).alias("dx_open"),
        dated(is_dx, F.col("dx"), passing("known")).alias("dx_closed"),
        dated(is_dx, F.col("cf"), opened("known")).alias("cf_open"),
        dated(is_dx, F.col("cf"), passing("known")).alias("cf_closed"),
        F.when(outcome, F.col("d")).alias("outcome_date"),
        F.when(kind == _ENROLLED, 1).alias("enrolled"),
        dated(kind == _ANCHOR).alias("observed_from"),
        F.when(kind == _ANCHOR, F.col("d_end")).alias("observed_to"),
    )
    least = ("fill_open", "fill_closed", "dx_open", "dx_closed", "outcome_date", "observed_from")
    most = ("adv_open", "adv_closed", "cf_open", "cf_closed", "enrolled", "observed_to")
    ends = [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    if hot:  # bounds what one (patient, index) group holds; needless for patients of known size
        facts = facts.groupBy("patient_id", "index_date", "seg_start").agg(
            F.max("seg_end").alias("seg_end"), *ends
        )
    reached = with_reach(facts, ["patient_id", "index_date"], "seg_start", "seg_end", "reach")
    per_index = reached.groupBy("patient_id", "index_date").agg(
        covered_days("seg_start", "seg_end", "reach", low, high).cast("int").alias("covered_days"),
        widest_gap("seg_start", "seg_end", "reach", low, high)
        .cast("int")
        .alias("maximum_gap_days"),
        F.coalesce(F.max(F.col("seg_end") >= high), F.lit(False)).alias("covered_on_index"),
        *ends,
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = per_index.withColumns(
        {
            "first_fill": F.least(F.min("fill_open").over(so_far), "fill_closed"),
            "first_dx": F.least(F.min("dx_open").over(so_far), "dx_closed"),
            "last_confirm": F.greatest(F.max("cf_open").over(so_far), "cf_closed"),
            "prior_advanced": F.greatest(F.max("adv_open").over(so_far), "adv_closed").isNotNull(),
        }
    )
    confirmed = F.coalesce(
        F.col("last_confirm") > F.date_add("first_dx", rules.separation_days), F.lit(False)
    )
    outside = (
        (F.col("observed_from") > need_start)
        | (F.col("observed_to") < need_end)
        | F.col("enrolled").isNull()
    )
    failing = [
        index > F.lit(t.as_of),
        (mature > F.lit(t.as_of)) if labelled else F.lit(False),
        outside,
        ~confirmed if rules.require_confirmation else F.lit(False),
        F.col("first_fill").isNull(),
        F.col("covered_days") < rules.minimum_covered_days,
        ~F.col("covered_on_index") if rules.require_on_index else F.lit(False),
        F.lit(False)
        if rules.maximum_gap_days is None
        else F.col("maximum_gap_days") > rules.maximum_gap_days,
        F.col("prior_advanced"),
    ]
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in zip(failing, REASONS)])
    label = F.col("outcome_date").isNotNull().cast("int")
    result = known.select(
        F.concat("patient_id", F.lit("__"), F.date_format("index_date", "yyyyMMdd")).alias(
            "snapshot_id"
        ),
        "patient_id",
        F.lit(rules.cohort_id).alias("cohort_id"),
        F.col("first_fill").alias("start_dt"),
        "index_date",
        F.date_sub(index, t.lag_days).alias("feature_cutoff"),
        F.date_sub(index, t.observation_days).alias("lookback_start"),
        end.alias("prediction_end"),
        mature.alias("label_available_date"),
        label.alias("resp"),
        label.alias("label"),
        "outcome_date",
        F.lit(True).alias("eligible"),
        F.lit(True).alias("followup_complete"),
        "covered_days",
        "maximum_gap_days",
        reason.alias("reason"),
    )
    return result if labelled else result.drop(*OUTCOME_COLUMNS)


@dataclass
class Cohort:
    snapshots: DataFrame
    exclusions: DataFrame

    def exclusion_counts(self) -> DataFrame:
        return self.exclusions.groupBy("reason").agg(F.count("*").alias("snapshots"))


def build_cohort(
    tables: dict[str, DataFrame],
    study: Study,
    *,
    labelled: bool = True,
    hot: list[tuple] | None = None,
) -> Cohort:
    """Eligible snapshots and the log of excluded ones, both lazy.

    Labelled snapshots are mature at ``as_of``; scoring snapshots carry no outcome column,
    need observation only up to the index, and exclude every advanced exposure known then,
    including inside the predictor lag. A caller that consumes both outputs takes
    ``write_cohort``, which derives them once.
    """
    assessed = assess(tables, study, labelled=labelled, hot=hot)
    return Cohort(
        assessed.where(F.col("reason").isNull()).drop("reason"),
        assessed.where(F.col("reason").isNotNull()).select(
            "snapshot_id", "patient_id", "index_date", "reason"
        ),
    )


#: Outcome of the candidates that passed every rule, as a folder name beside the reasons.
KEPT = "eligible"


def write_cohort(
    tables: dict[str, DataFrame],
    study: Study,
    audit: Audit,
    name: str = "cohort",
    *,
    labelled: bool = True,
    hot: list[tuple] | None = None,
) -> Cohort:
    """The cohort of ``build_cohort`` from one derivation: every candidate's facts are written
    once, a folder for each outcome, and both outputs read their own folders. The number of
    candidates by outcome is observed while writing and goes to the audit."""
    assessed = assess(tables, study, labelled=labelled, hot=hot)
    facts = assessed.withColumn("outcome", F.coalesce("reason", F.lit(KEPT))).drop("reason")
    measures = {("rows", ""): F.count(F.lit(1))} | count_measures("outcome", (KEPT, *REASONS))
    written = audit.write(facts, name, measures, partition_by=("outcome",))
    return Cohort(
        written.where(F.col("outcome") == KEPT).drop("outcome"),
        written.where(F.col("outcome") != KEPT).select(
            "snapshot_id", "patient_id", "index_date", F.col("outcome").alias("reason")
        ),
    )


def require_snapshots(snapshots: DataFrame) -> DataFrame:
    if not snapshots.limit(1).count():
        raise ValueError("The cohort is empty: no snapshot passed every rule")
    return snapshots


def timeline_differences(
    snapshots: DataFrame, tables: dict[str, DataFrame], study: Study
) -> DataFrame:
    """Rows on which supplied snapshots and a fresh derivation disagree, in both directions."""
    columns = [
        "snapshot_id", "patient_id", "index_date", "label", "outcome_date",
        "label_available_date",
    ]
    given = snapshots.select(*columns)
    derived = build_cohort(tables, study).snapshots.select(*columns)
    return (
        given.exceptAll(derived)
        .withColumn("side", F.lit("supplied"))
        .unionByName(derived.exceptAll(given).withColumn("side", F.lit("derived")))
    )
