"""The wide feature table, one row per snapshot.

Trailing-window counts are aggregated in two levels: claims are first reduced to one row per
(snapshot, age band), then the bands are rolled up into the nested windows. So the wide list
of conditional sums runs over a handful of rows per snapshot instead of over every claim.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import (
    is_advanced,
    is_conventional,
    is_valid,
    known_from,
    member,
    reversal,
)
from ..operators.asof import status_at
from ..operators.intervals import covered_days, merge_starts, widest_gap, with_reach
from ..operators.ordered import scan_in_order
from ..operators.skew import hot_keys, lookup, salted_join
from ..operators.stage import stored
from ..params import Study
from ..functions.leakage import validate_predictor_names
from .cohort import hot_patients, tasks_for

#: Snapshots whose fills one task takes in one pass.
SNAPSHOTS_PER_TASK = 50_000
BANDED = (
    "diagnosis_count", "procedure_count", "pharmacy_count", "specialist_visits",
    "emergency_visits", "urgent_visits", "rejected_rx", "reversed_rx", "patient_cost",
)


def _landmarks(snapshots: DataFrame, tasks: int | None = None) -> DataFrame:
    """Snapshot keys and dates; ``previous_index`` is the patient's preceding snapshot."""
    order = Window.partitionBy("patient_id").orderBy("index_date")
    keys = _windows_of(snapshots)
    dealt = keys.repartition(tasks, "patient_id") if tasks else keys
    return dealt.withColumn("previous_index", F.lag("index_date").over(order))


def _bands(study: Study) -> list[int]:
    return sorted({*study.features.windows, 90, 180})


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _medical_rows(tables, marks: DataFrame, study: Study, hot) -> DataFrame:
    """Medical claims in view of each snapshot, as flags to be summed."""
    rules = study.features
    specialists = tables["providers"].where(member("specialty", rules.specialists)).select(
        "provider_id", F.lit(True).alias("is_specialist")
    )
    med = tables["medical_claims"]
    med = lookup(med.withColumn("gone", reversal(med)), specialists, "provider_id")
    seen = (
        (F.col("claim_date") <= F.col("feature_cutoff"))
        & (F.col("claim_date") >= F.col("lookback_start"))
        & (F.col("available_date") <= F.col("index_date"))
    )
    med = salted_join(
        med.select(
            "patient_id", "claim_date", "available_date", "status", "gone", "diagnosis_code",
            "procedure_code", "place_of_service", "is_specialist",
        ),
        marks,
        ["patient_id"],
        seen,
        hot,
    )
    has_code = F.col("diagnosis_code").isNotNull()
    valid = is_valid(status_at("status", F.col("gone"), "index_date")) & has_code
    special = valid & F.col("is_specialist").isNotNull()
    days = F.datediff("index_date", "claim_date")
    nothing = F.lit(0)
    return med.select(
        "patient_id",
        "snapshot_id",
        days.alias("days"),
        _flag(has_code).alias("diagnosis_count"),
        _flag(F.col("procedure_code").isNotNull()).alias("procedure_count"),
        nothing.alias("pharmacy_count"),
        _flag(special).alias("specialist_visits"),
        _flag(valid & member("place_of_service", ["emergency"])).alias("emergency_visits"),
        _flag(valid & member("place_of_service", ["urgent_care"])).alias("urgent_visits"),
        nothing.alias("rejected_rx"),
        nothing.alias("reversed_rx"),
        F.lit(0.0).alias("patient_cost"),
        _flag(valid).alias("valid_diagnosis"),
        _flag(valid & member("diagnosis_code", rules.symptom_codes)).alias("symptom_count"),
        _flag(valid & member("diagnosis_code", rules.comorbidity_codes)).alias(
            "comorbidity_count"
        ),
        F.when(valid, days).alias("diagnosis_age"),
        F.when(special, days).alias("specialist_age"),
    )


def _in_events() -> Column:
    return (F.col("fill_date") <= F.col("feature_cutoff")) & (
        F.col("fill_date") >= F.col("lookback_start")
    )


def _pharmacy_rows(tables, marks: DataFrame, study: Study, hot) -> DataFrame:
    """Fills in view of each snapshot, as flags to be summed."""
    rules, timeline = study.features, study.timeline
    nothing = F.lit(0)
    rx = tables["pharmacy_claims"]
    known = (known_from("fill_date", timeline.lag_days) <= F.col("index_date")) & (
        F.col("fill_date") >= F.date_sub("index_date", max(rules.windows))
    )
    in_events = _in_events()
    rx = salted_join(
        rx.withColumn("gone", reversal(rx)).select(
            "patient_id", "fill_date", "available_date", "status", "gone", "drug_id",
            "patient_cost",
        ),
        marks,
        ["patient_id"],
        known | (in_events & (F.col("available_date") <= F.col("index_date"))),
        hot,
    )
    now = status_at("status", F.col("gone"), "index_date")
    no_age = F.lit(None).cast("int")
    return rx.select(
        "patient_id",
        "snapshot_id",
        F.datediff("index_date", "fill_date").alias("days"),
        nothing.alias("diagnosis_count"),
        nothing.alias("procedure_count"),
        _flag(in_events & F.col("drug_id").isNotNull()).alias("pharmacy_count"),
        nothing.alias("specialist_visits"),
        nothing.alias("emergency_visits"),
        nothing.alias("urgent_visits"),
        _flag(known & (now == "rejected")).alias("rejected_rx"),
        _flag(known & (now == "reversed")).alias("reversed_rx"),
        F.when(known, F.coalesce("patient_cost", F.lit(0.0))).otherwise(0.0).alias("patient_cost"),
        *[nothing.alias(c) for c in ("valid_diagnosis", "symptom_count", "comorbidity_count")],
        no_age.alias("diagnosis_age"),
        no_age.alias("specialist_age"),
    )


def _rolled_up(rows: DataFrame, study: Study) -> DataFrame:
    """Flags by snapshot and age band first, then the nested windows over the few bands."""
    rules = study.features
    bands = _bands(study)
    band = reduce(
        lambda rest, edge: F.when(F.col("days") <= edge, edge).otherwise(rest),
        reversed(bands),
        F.lit(bands[-1] + 1),
    )
    summed = (*BANDED, "valid_diagnosis", "symptom_count", "comorbidity_count")
    by_band = rows.groupBy("patient_id", "snapshot_id", band.alias("band")).agg(
        *[F.sum(c).alias(c) for c in summed],
        F.min("diagnosis_age").alias("diagnosis_age"),
        F.min("specialist_age").alias("specialist_age"),
    )

    def within(column: str, low: int, high: int) -> Column:
        inside = (F.col("band") > low) & (F.col("band") <= high)
        return F.sum(F.when(inside, F.col(column)).otherwise(F.lit(0)))

    columns = {
        f"{c}_{w}d": within(c, 0, w).cast("double" if c == "patient_cost" else "int")
        for w in rules.windows
        for c in BANDED
    }
    sentinel = F.lit(rules.sentinel(study.timeline))
    for name, counted in (("diagnosis", "valid_diagnosis"), ("specialist", "specialist_visits")):
        recent, prior = within(counted, 0, 90), within(counted, 90, 180)
        columns[f"days_since_last_{name}"] = F.coalesce(F.min(f"{name}_age"), sentinel)
        columns[f"{name}_acceleration"] = (recent - prior).cast("int")
        columns[f"{name}_recent_prior_ratio"] = (recent + 1) / (prior + 1)
    for name in ("symptom_count", "comorbidity_count"):
        columns[name] = F.sum(name).cast("int")
    return by_band.groupBy("patient_id", "snapshot_id").agg(*[e.alias(n) for n, e in columns.items()])


def _windows_of(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "patient_id", "snapshot_id", "index_date", "feature_cutoff", "lookback_start"
    )


def count_features(
    tables: dict[str, DataFrame],
    snapshots: DataFrame,
    study: Study,
    *,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Trailing counts, costs, recencies, accelerations and code-list counts."""
    hot = hot_patients(tables) if hot is None else hot
    marks = _windows_of(snapshots)
    rows = _medical_rows(tables, marks, study, hot).unionByName(
        _pharmacy_rows(tables, marks, study, hot)
    )
    return _rolled_up(rows, study).drop("patient_id")


def count_defaults(study: Study) -> dict[str, float]:
    """Values of ``count_features`` for a snapshot without any claim in view."""
    sentinel = study.features.sentinel(study.timeline)
    values = {f"{c}_{w}d": 0 for w in study.features.windows for c in BANDED}
    for name in ("diagnosis", "specialist"):
        values |= {
            f"days_since_last_{name}": sentinel,
            f"{name}_acceleration": 0,
            f"{name}_recent_prior_ratio": 1.0,
        }
    return values | {"symptom_count": 0, "comorbidity_count": 0}


def _conventional(tables: dict[str, DataFrame], study: Study) -> DataFrame:
    rx = tables["pharmacy_claims"]
    return rx.where(is_valid() & is_conventional(study.arms)).select(
        "patient_id",
        "claim_id",
        "fill_date",
        F.date_add("fill_date", F.greatest(F.lit(0), F.col("days_supply"))).alias("supply_end"),
        known_from("fill_date", study.timeline.lag_days).alias("known"),
        reversal(rx).alias("gone"),
        "drug_id",
        "prescriber_id",
    )


def _known_now() -> Column:
    alive = F.col("gone").isNull() | (F.col("gone") > F.col("index_date"))
    return (F.col("known") <= F.col("index_date")) & alive


def coverage_features(
    tables: dict[str, DataFrame],
    snapshots: DataFrame,
    study: Study,
    *,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Days covered and widest gap of the history, and the cover of its last two quarters."""
    hot = hot_patients(tables) if hot is None else hot
    index = F.col("index_date")
    high = F.date_add(index, 1)
    history, recent = F.col("lookback_start"), F.date_sub(index, 89)
    previous = F.date_sub(index, 179)
    low = F.least(history, previous)
    useful = (
        _known_now() & (F.col("supply_end") > low) & (F.col("supply_end") > F.col("fill_date"))
    )
    marks = snapshots.select("patient_id", "snapshot_id", "index_date", "lookback_start")
    keys = ["patient_id", "snapshot_id", "index_date", "lookback_start"]
    pieces = salted_join(_conventional(tables, study), marks, ["patient_id"], useful, hot).select(
        *keys,
        F.greatest("fill_date", low).alias("s"),
        F.least("supply_end", high).alias("e"),
    )
    reached = with_reach(merge_starts(pieces, keys, "s", "e"), keys, "s", "e", "reach")
    days = reached.groupBy(*keys).agg(
        covered_days("s", "e", "reach", history, high).alias("history_days"),
        covered_days("s", "e", "reach", recent, high).alias("recent_days"),
        covered_days("s", "e", "reach", previous, recent).alias("previous_days"),
        widest_gap("s", "e", "reach", history, high).cast("int").alias("maximum_therapy_gap_days"),
    )
    now, then = F.col("recent_days") / 90.0, F.col("previous_days") / 90.0
    return days.select(
        "snapshot_id",
        (F.col("history_days") / F.datediff(high, history)).alias("proportion_days_covered"),
        "maximum_therapy_gap_days",
        now.alias("recent_coverage_90d"),
        then.alias("previous_coverage_90d"),
        (now - then).alias("coverage_change"),
    )


def _therapy_facts(
    tables: dict[str, DataFrame], snapshots: DataFrame, study: Study, hot
) -> DataFrame:
    """Known conventional fills per snapshot: all recent ones, older ones once.

    An older fill matters only for the first and the last fill of the whole history. It is
    paired with the first snapshot that knows it, and carried on by running extremes.
    """
    index, before, gone = F.col("index_date"), F.col("previous_index"), F.col("gone")
    fresh = gone.isNotNull() | before.isNull() | (F.col("known") > before)
    recent = F.col("fill_date") >= F.col("lookback_start")
    return salted_join(
        _conventional(tables, study).drop("supply_end"),
        _landmarks(snapshots),
        ["patient_id"],
        _known_now() & (recent | fresh),
        hot,
    ).withColumns(
        {
            "recent": recent,
            "carried": gone.isNull() & fresh,
            "passing": gone.isNotNull() & (index < gone),
            "fill": F.struct("fill_date", "claim_id", "drug_id", "prescriber_id"),
        }
    )


def last_fills(
    tables: dict[str, DataFrame],
    snapshots: DataFrame,
    study: Study,
    *,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Per snapshot the latest known conventional fill and the earliest fill date."""
    hot = hot_patients(tables) if hot is None else hot
    facts = _therapy_facts(tables, snapshots, study, hot)
    per = facts.groupBy("patient_id", "snapshot_id", "index_date").agg(
        *[
            call(F.when(F.col(flag), F.col(column))).alias(f"{name}_{flag}")
            for flag in ("carried", "passing")
            for name, call, column in (("last", F.max, "fill"), ("first", F.min, "fill_date"))
        ]
    )
    # Snapshots without a new fact still take part in the running extremes.
    marks = snapshots.select("patient_id", "snapshot_id", "index_date")
    all_marks = marks.join(per.drop("patient_id", "index_date"), "snapshot_id", "left")
    so_far = (
        Window.partitionBy("patient_id")
        .orderBy("index_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return all_marks.select(
        "snapshot_id",
        "patient_id",
        "index_date",
        F.greatest(F.max("last_carried").over(so_far), "last_passing").alias("last"),
        F.least(F.min("first_carried").over(so_far), "first_passing").alias("first_fill"),
    ).select(
        "snapshot_id",
        "patient_id",
        "index_date",
        F.col("last.drug_id").alias("last_drug"),
        F.col("last.prescriber_id").alias("last_prescriber"),
        F.col("last.claim_id").isNotNull().alias("has_fill"),
        "first_fill",
    )


def therapy_features(
    tables: dict[str, DataFrame],
    snapshots: DataFrame,
    study: Study,
    *,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Current drug, changes and drugs tried in the history, therapy duration, recencies."""
    hot = hot_patients(tables) if hot is None else hot
    recent = _therapy_facts(tables, snapshots, study, hot).where("recent").select(
        "patient_id", "snapshot_id", "index_date", "fill_date", "claim_id", "drug_id"
    )
    scanned = scan_in_order(
        recent,
        [("fill_date", True), ("claim_id", True)],
        keys=("patient_id", "snapshot_id"),
        previous={"before_claim": "claim_id", "before_drug": "drug_id"},
        spread=bool(hot),
    )
    changed = F.col("before_claim").isNotNull() & F.coalesce(
        F.col("drug_id") != F.col("before_drug"), F.lit(True)
    )
    per_drug = (
        scanned.withColumn("changed", changed)
        .groupBy("patient_id", "snapshot_id", "index_date", "drug_id")
        .agg(
            F.count_if("changed").alias("changes"),
            F.max(F.when(F.col("changed"), F.col("fill_date"))).alias("changed_on"),
            F.max("fill_date").alias("filled_on"),
        )
    )
    sentinel = F.lit(study.features.sentinel(study.timeline))

    def since(column: str) -> Column:
        return F.coalesce(F.datediff(F.col("index_date"), F.max(column)), sentinel)

    history = per_drug.groupBy("snapshot_id", "index_date").agg(
        F.sum("changes").cast("int").alias("therapy_changes"),
        F.count("drug_id").cast("int").alias("therapies_tried"),
        since("filled_on").alias("days_since_last_rx"),
        since("changed_on").alias("days_since_last_treatment_change"),
    )
    return (
        last_fills(tables, snapshots, study, hot=hot)
        .join(history.drop("index_date"), "snapshot_id", "left")
        .select(
            "snapshot_id",
            F.when(F.col("has_fill"), F.col("last_drug"))
            .otherwise("unknown")
            .alias("current_therapy"),
            F.coalesce("therapy_changes", F.lit(0)).alias("therapy_changes"),
            F.coalesce("therapies_tried", F.lit(0)).alias("therapies_tried"),
            F.coalesce(F.datediff("index_date", "first_fill"), F.lit(0)).alias(
                "therapy_duration_days"
            ),
            F.coalesce("days_since_last_rx", sentinel).alias("days_since_last_rx"),
            F.coalesce("days_since_last_treatment_change", sentinel).alias(
                "days_since_last_treatment_change"
            ),
        )
    )


PHARMACY = ("pharmacy_count", "rejected_rx", "reversed_rx", "patient_cost")


def pharmacy_pass(tables: dict[str, DataFrame], snapshots: DataFrame, study: Study) -> DataFrame:
    """Counts, coverage, therapy and last fill of every snapshot, from one pass over the fills.

    The fills meet the landmarks once, by patient. Everything after that keeps the patient's
    partitioning, so nothing is shuffled again: one window sorts the fills of a snapshot and
    gives each the reach of earlier cover and the conventional fill before it; sums per drug and
    then per snapshot follow; running extremes over a patient's snapshots carry the first and
    the last fill of the whole history. For patients whose fills fit a task; hot ones go
    through the separate plans, which spread them.
    """
    rules, timeline = study.features, study.timeline
    source, index = tables["pharmacy_claims"], F.col("index_date")
    tasks = tasks_for(snapshots, SNAPSHOTS_PER_TASK)
    # Dealt as narrow as they are read; the derived days follow behind the shuffle.
    rx = source.select(
        "patient_id", "claim_id", "fill_date", "available_date", "status",
        reversal(source).alias("reversal_date"), "drug_id", "prescriber_id", "patient_cost", "therapy_class",
        "days_supply",
    ).repartition(tasks, "patient_id")
    fills = rx.select(
        F.col("patient_id").alias("owner"),
        "claim_id",
        "fill_date",
        "available_date",
        "status",
        reversal(rx).alias("gone"),
        known_from("fill_date", timeline.lag_days).alias("known"),
        "drug_id",
        "prescriber_id",
        "patient_cost",
        F.date_add("fill_date", F.greatest(F.lit(0), F.col("days_supply"))).alias("supply_end"),
        F.coalesce(is_valid() & is_conventional(study.arms), F.lit(False)).alias("conventional"),
    )
    high, history = F.date_add(index, 1), F.col("lookback_start")
    recent_from, previous_from = F.date_sub(index, 89), F.date_sub(index, 179)
    low = F.least(history, previous_from)
    gone, known, before = F.col("gone"), F.col("known"), F.col("previous_index")
    costed = (known <= index) & (F.col("fill_date") >= F.date_sub("index_date", max(rules.windows)))
    listed = _in_events() & (costed | (F.col("available_date") <= index))
    therapy = F.col("conventional") & _known_now()
    recent = therapy & (F.col("fill_date") >= history)
    fresh = therapy & (gone.isNotNull() | before.isNull() | (known > before))
    covers = therapy & (F.col("supply_end") > low) & (F.col("supply_end") > F.col("fill_date"))
    # Every snapshot stays, also without a fill: it takes part in the running extremes.
    pairs = _landmarks(snapshots, tasks).join(
        fills, (F.col("patient_id") == F.col("owner")) & (costed | listed | recent | fresh | covers), "left"
    )
    now = status_at("status", gone, "index_date")
    fill = F.struct("fill_date", "claim_id", "drug_id", "prescriber_id")
    key = ["patient_id", "snapshot_id", "index_date", "lookback_start"]
    flagged = pairs.select(
        *key,
        "fill_date",
        "claim_id",
        "drug_id",
        F.datediff("index_date", "fill_date").alias("days"),
        _flag(listed & F.col("drug_id").isNotNull()).alias("pharmacy_count"),
        _flag(costed & (now == "rejected")).alias("rejected_rx"),
        _flag(costed & (now == "reversed")).alias("reversed_rx"),
        F.when(costed, F.coalesce("patient_cost", F.lit(0.0))).otherwise(0.0).alias("patient_cost"),
        F.when(covers, F.greatest("fill_date", low)).alias("s"),
        F.when(covers, F.least("supply_end", high)).alias("e"),
        F.coalesce(recent, F.lit(False)).alias("recent"),
        "prescriber_id",
        (fresh & gone.isNull()).alias("carried"),
        (fresh & gone.isNotNull()).alias("passing"),
    )
    order = Window.partitionBy("patient_id", "snapshot_id").orderBy(
        "fill_date", "claim_id", "drug_id", "prescriber_id"
    )
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    former = F.last(F.when(F.col("recent"), F.struct("claim_id", "drug_id")), ignorenulls=True).over(earlier)
    latest = [F.last(F.when(F.col(c), fill), ignorenulls=True).over(whole) for c in ("carried", "passing")]
    scanned = flagged.withColumns(
        {
            "reach": F.max("e").over(earlier),
            "former": former,
            "last_carried": latest[0],
            "last_passing": latest[1],
        }
    ).withColumn(
        "changed",
        F.col("recent")
        & F.col("former.claim_id").isNotNull()
        & F.coalesce(F.col("drug_id") != F.col("former.drug_id"), F.lit(True)),
    )
    totals = {
        f"{c}_{w}d": F.sum(F.when(F.col("days") <= w, F.col(c)).otherwise(F.lit(0)))
        for w in rules.windows
        for c in PHARMACY
    }
    # The last fills are keys, since sums over plain numbers are hashed while those over fills
    # would sort all rows once more.
    per_snapshot = [*key, "last_carried", "last_passing"]
    first = {f"first_{c}": F.min(F.when(F.col(c), F.col("fill_date"))) for c in ("carried", "passing")}
    days = {
        "history_days": (history, high),
        "recent_days": (recent_from, high),
        "previous_days": (previous_from, recent_from),
    }
    # The widest gap is the largest of the gaps before a fill and of the one behind the last end.
    before_fill = F.when(
        F.col("s").isNotNull(),
        F.greatest(F.lit(0), F.datediff(F.least("s", high), F.greatest("reach", history))),
    )
    per_drug = scanned.groupBy(*per_snapshot, "drug_id").agg(
        *[e.alias(n) for n, e in (totals | first).items()],
        *[covered_days("s", "e", "reach", a, b).alias(n) for n, (a, b) in days.items()],
        F.max(before_fill).alias("gap"),
        F.max("e").alias("end"),
        F.count_if("changed").alias("changes"),
        F.max(F.when(F.col("changed"), F.col("fill_date"))).alias("changed_on"),
        F.max(F.when(F.col("recent"), F.col("fill_date"))).alias("filled_on"),
    )
    per = per_drug.groupBy(*per_snapshot).agg(
        *[F.sum(n).alias(n) for n in (*totals, *days)],
        *[F.min(n).alias(n) for n in first],
        F.max("gap").alias("gap"),
        F.max("end").alias("end"),
        F.sum("changes").cast("int").alias("therapy_changes"),
        F.count(F.when(F.col("filled_on").isNotNull(), F.col("drug_id"))).cast("int").alias("therapies_tried"),
        F.max("changed_on").alias("changed_on"),
        F.max("filled_on").alias("filled_on"),
    )
    so_far = (
        Window.partitionBy("patient_id")
        .orderBy("index_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.greatest(F.max("last_carried").over(so_far), "last_passing")
    earliest = F.least(F.min("first_carried").over(so_far), "first_passing")
    carried = per.withColumns({"last": last, "first_fill": earliest})
    sentinel = F.lit(rules.sentinel(timeline))
    covered = F.col("end").isNotNull()
    widest = F.greatest(
        F.coalesce("gap", F.lit(0)),
        F.greatest(F.lit(0), F.datediff(high, F.greatest("end", history))),
    )
    return carried.select(
        "patient_id",
        "snapshot_id",
        *[F.col(n).cast("double" if n.startswith("patient_cost") else "int").alias(n) for n in totals],
        F.when(covered, F.col("history_days") / F.datediff(high, history)).alias("proportion_days_covered"),
        F.when(covered, widest).cast("int").alias("maximum_therapy_gap_days"),
        F.when(covered, F.col("recent_days") / 90.0).alias("recent_coverage_90d"),
        F.when(covered, F.col("previous_days") / 90.0).alias("previous_coverage_90d"),
        F.when(covered, F.col("recent_days") / 90.0 - F.col("previous_days") / 90.0).alias("coverage_change"),
        F.when(F.col("last.claim_id").isNotNull(), F.col("last.drug_id"))
        .otherwise("unknown")
        .alias("current_therapy"),
        F.col("last.prescriber_id").alias("last_prescriber"),
        "therapy_changes",
        "therapies_tried",
        F.coalesce(F.datediff("index_date", "first_fill"), F.lit(0)).alias("therapy_duration_days"),
        F.coalesce(F.datediff("index_date", "filled_on"), sentinel).alias("days_since_last_rx"),
        F.coalesce(F.datediff("index_date", "changed_on"), sentinel).alias(
            "days_since_last_treatment_change"
        ),
    )


def peer_features(
    tables: dict[str, DataFrame],
    snapshots: DataFrame,
    study: Study,
    *,
    hot: list[tuple] | None = None,
    hot_prescribers: list[tuple] | None = None,
    last: DataFrame | None = None,
) -> DataFrame:
    """Other patients of the last conventional prescriber, and those on advanced therapy.

    ``last`` may name the last prescriber of each snapshot, if the caller knows it already.

    The answer depends on (prescriber, index date) apart from leaving out the patient's own
    row. So patients are counted once per distinct landmark and the patient's own presence
    is subtracted, instead of pairing each snapshot with all fills of its prescriber.
    """
    if last is None:
        hot = hot_patients(tables) if hot is None else hot
        last = last_fills(tables, snapshots, study, hot=hot)
    dates = snapshots.select("snapshot_id", "patient_id", "index_date", "lookback_start")
    focal = (
        last.select("snapshot_id", "last_prescriber")
        .join(dates, "snapshot_id")
        .select(
            "snapshot_id",
            "patient_id",
            "index_date",
            "lookback_start",
            F.col("last_prescriber").alias("prescriber_id"),
        )
    )
    marks = (
        focal.where(F.col("prescriber_id").isNotNull())
        .select("prescriber_id", "index_date", "lookback_start")
        .distinct()
    )
    rx = tables["pharmacy_claims"]
    fills = rx.where(is_valid() & F.col("prescriber_id").isNotNull()).select(
        "prescriber_id",
        F.col("patient_id").alias("peer_id"),
        "fill_date",
        known_from("fill_date", study.timeline.lag_days).alias("known"),
        reversal(rx).alias("gone"),
        is_advanced(study.arms).cast("int").alias("advanced"),
    )
    if hot_prescribers is None:
        hot_prescribers = hot_keys(
            rx.select("prescriber_id"), ["prescriber_id"]
        )
    seen = _known_now() & (F.col("fill_date") >= F.col("lookback_start"))
    key = ["prescriber_id", "index_date", "lookback_start"]
    peers = (
        salted_join(fills, marks, ["prescriber_id"], seen, hot_prescribers)
        .groupBy(*key, "peer_id")
        .agg(F.max("advanced").alias("advanced"))
    )
    totals = peers.groupBy(*key).agg(
        F.count("*").alias("patients"), F.sum("advanced").alias("advanced_patients")
    )
    # The patient's own presence comes from the own fills, not from a second pass over all peers.
    own_fills = fills.withColumnsRenamed({"prescriber_id": "own_prescriber", "peer_id": "owner"})
    mine = (F.col("prescriber_id") == F.col("own_prescriber")) & (F.col("patient_id") == F.col("owner"))
    with_own = (
        focal.join(own_fills, mine & seen, "left")
        .groupBy("snapshot_id", "patient_id", *key)
        .agg(F.max("advanced").alias("own_advanced"))
    )
    none = F.lit(0)
    present = F.col("own_advanced").isNotNull().cast("int")
    # A (prescriber, index date) holds at most as many snapshots as the prescriber has fills,
    # so the prescribers that are hot among the fills are the only ones to spread here.
    return (
        salted_join(
            with_own, totals, key, hot=hot_prescribers, hot_on=["prescriber_id"], how="left"
        )
        .select(
            "snapshot_id",
            (F.coalesce("advanced_patients", none) - F.coalesce("own_advanced", none))
            .cast("int")
            .alias("hcp_historical_advanced_patients"),
            (F.coalesce("patients", none) - present).cast("int").alias("hcp_historical_patients"),
        )
    )


def payer_features(tables: dict[str, DataFrame], snapshots: DataFrame) -> DataFrame:
    """Payer type of the plan in force at the index date; two plans at once are an error."""
    marks = snapshots.select("patient_id", "snapshot_id", "index_date")
    inside = (F.col("coverage_start") <= F.col("index_date")) & (
        F.col("coverage_end") >= F.col("index_date")
    )
    spans = tables["enrollment"].select("patient_id", "coverage_start", "coverage_end", "plan_id")
    in_force = (
        salted_join(spans, marks, ["patient_id"], inside)
        .groupBy("snapshot_id")
        .agg(F.min("plan_id").alias("plan_id"), F.max("plan_id").alias("other"))
    )
    checked = in_force.select(
        "snapshot_id",
        F.when(
            F.col("plan_id") != F.col("other"),
            F.raise_error(F.lit("Concurrent plans require an approved primary-plan mapping")),
        )
        .otherwise(F.col("plan_id"))
        .alias("plan_id"),
    )
    return lookup(checked, tables["plans"].select("plan_id", "payer_type"), "plan_id").select(
        "snapshot_id", "payer_type"
    )


def feature_names(study: Study) -> list[str]:
    """Predictors in contract order."""
    rules = study.features
    return [
        "age", "gender", "current_therapy", "proportion_days_covered",
        "maximum_therapy_gap_days", "therapy_changes", "therapies_tried",
        "therapy_duration_days",
        *(["geography"] if rules.include_geography else []),
        "payer_type",
        *[f"{c}_{w}d" for w in rules.windows for c in BANDED],
        *[
            f"days_since_last_{n}"
            for n in ("diagnosis", "specialist", "rx", "treatment_change")
        ],
        *[
            f"{n}_{k}"
            for n in ("diagnosis", "specialist")
            for k in ("acceleration", "recent_prior_ratio")
        ],
        "recent_coverage_90d", "previous_coverage_90d", "coverage_change",
        "symptom_count", "comorbidity_count",
        "hcp_historical_advanced_patients", "hcp_historical_patients",
    ]


def build_features(
    tables: dict[str, DataFrame],
    snapshots: DataFrame,
    study: Study,
    *,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """``snapshot_id, feature_as_of`` and the predictors, one row per snapshot.

    Fills and medical claims are exchanged by patient once each; what the fills give is stored
    at snapshot grain, since the peer counts start from it. With hot patients every feature
    group is a plan of its own that spreads them.
    """
    study.features.check(study.timeline)
    names = feature_names(study)
    validate_predictor_names(names)
    hot = hot_patients(tables) if hot is None else hot
    person = tables["patients"].select("patient_id", "birth_year", "gender", "geography")
    base = (
        snapshots.select("snapshot_id", "patient_id", "index_date", "lookback_start")
        .join(person, "patient_id", "left")
        .join(payer_features(tables, snapshots), "snapshot_id", "left")
    )
    if hot:
        groups = [
            count_features(tables, snapshots, study, hot=hot),
            coverage_features(tables, snapshots, study, hot=hot),
            therapy_features(tables, snapshots, study, hot=hot),
            peer_features(tables, snapshots, study, hot=hot),
        ]
    else:
        fills = stored(pharmacy_pass(tables, snapshots, study))
        counts = _rolled_up(_medical_rows(tables, _windows_of(snapshots), study, hot), study)
        own = [c for c in counts.columns if c not in {"patient_id", *fills.columns}]
        groups = [
            fills.drop("patient_id", "last_prescriber"),
            counts.select("snapshot_id", *own),
            peer_features(tables, snapshots, study, hot=hot, last=fills),
        ]
    wide = reduce(lambda left, group: left.join(group, "snapshot_id", "left"), groups, base)
    window = F.datediff("index_date", "lookback_start") + 1
    missing = {
        "payer_type": F.lit("unknown"),
        "proportion_days_covered": F.lit(0.0),
        "maximum_therapy_gap_days": window,
        "recent_coverage_90d": F.lit(0.0),
        "previous_coverage_90d": F.lit(0.0),
        "coverage_change": F.lit(0.0),
        **{c: F.lit(v) for c, v in count_defaults(study).items()},
    }
    filled = wide.withColumns(
        {
            "age": F.year("index_date") - F.col("birth_year"),
            **{c: F.coalesce(F.col(c), v) for c, v in missing.items()},
        }
    )
    return filled.select("snapshot_id", F.col("index_date").alias("feature_as_of"), *names)
