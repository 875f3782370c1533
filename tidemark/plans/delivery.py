"""From raw tables to provider targets: prepare, split, fit, score, rank, attribute, write."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_patients
from ..operators.stage import freeze
from ..params import Study
from ..schema import ContractError
from ..sources.audit import Audit
from ..sources.directory import canonicalize
from ..sources.sinks import write_field_csv, write_restricted
from .cohort import Cohort, build_cohort, hot_patients, require_snapshots, write_cohort
from .events import build_events
from .features import build_features, feature_names
from .models import (
    SCORE,
    Baselines,
    DeliveryModel,
    comparison,
    feature_schema,
    fit_baselines,
    score_difference,
)
from .prepared import Prepared, ScoringBatch, validate_prepared, validate_scoring
from .splits import SPLITS, check_split, split_counts, temporal_split
from .targets import attributed_patients, field_coverage, field_targets, unknown_providers

RELOAD_TOLERANCE = 1e-7


def check_maturity(study: Study, scoring_date: date) -> None:
    t = study.timeline
    if scoring_date > t.as_of:
        raise ContractError("Scoring date exceeds the extract's as-of date")
    ready = t.horizon_days + t.runout_days
    if t.index_end and t.index_end + timedelta(days=ready) > scoring_date:
        raise ContractError("Historical index_end needs mature outcomes by scoring_date")


def prepare(
    tables: dict[str, DataFrame],
    study: Study,
    *,
    check: bool = True,
    hot=None,
    audit: Audit | None = None,
) -> Prepared:
    """Canonical tables to a validated training bundle.

    With an audit, cohort, features and events are written to its folder instead of being frozen;
    their figures, and the number of excluded candidates by reason, come from those writes.
    """
    hot = hot_patients(tables) if hot is None else hot
    if audit is None:
        keep = lambda df, _: freeze(df)
        snapshots = freeze(build_cohort(tables, study, hot=hot).snapshots)
    else:
        keep = audit.write
        snapshots = write_cohort(tables, study, audit, "training_cohort", hot=hot).snapshots
    require_snapshots(snapshots)
    bundle = Prepared(
        snapshots,
        keep(build_features(tables, snapshots, study, hot=hot), "training_features"),
        keep(build_events(tables, snapshots, hot=hot), "training_events"),
        tuple(feature_names(study)),
    )
    return validate_prepared(bundle, study) if check else bundle


def scoring_study(study: Study, scoring_date: date) -> Study:
    return replace(
        study,
        timeline=replace(study.timeline, as_of=scoring_date, index_start=None, index_end=None),
    )


def scoring_cohort(
    tables: dict[str, DataFrame], study: Study, scoring_date: date, *, hot=None
) -> Cohort:
    """One candidate per patient at the scoring date, without labels."""
    candidates = tables["patients"].select(
        "patient_id", F.lit(scoring_date).alias("index_date")
    )
    return build_cohort(
        {**tables, "snapshot_candidates": candidates},
        scoring_study(study, scoring_date),
        labelled=False,
        hot=hot,
    )


def scoring_batch(
    tables: dict[str, DataFrame], study: Study, scoring_date: date, *, check=True, hot=None
) -> ScoringBatch:
    hot = hot_patients(tables) if hot is None else hot
    live = scoring_study(study, scoring_date)
    snapshots = freeze(scoring_cohort(tables, study, scoring_date, hot=hot).snapshots)
    batch = ScoringBatch(
        snapshots,
        freeze(build_features(tables, snapshots, live, hot=hot)),
        freeze(build_events(tables, snapshots, hot=hot)),
        tables["providers"],
        tuple(feature_names(live)),
    )
    return validate_scoring(batch, live, scoring_date) if check else batch


def training_bundle(
    tables: dict[str, DataFrame],
    study: Study,
    scoring_date: date,
    *,
    check=True,
    hot=None,
    audit: Audit | None = None,
) -> Prepared:
    """Training data as it stood at the scoring date."""
    mature = replace(study, timeline=replace(study.timeline, as_of=scoring_date))
    return prepare(tables, mature, check=check, hot=hot, audit=audit)


@dataclass
class Training:
    model: DeliveryModel
    baselines: Baselines
    split: DataFrame
    counts: DataFrame
    comparison: DataFrame


Trainer = Callable[..., Baselines]


def train(
    bundle: Prepared,
    study: Study,
    scoring_date: date,
    *,
    trainer: Trainer = fit_baselines,
    kind: str = "unverified",
    **options,
) -> Training:
    """Split, fit on train, select on validation, compare on validation and test."""
    frame = bundle.modeling_frame()
    latest = frame.agg(F.max("label_available_date")).first()[0]
    if latest is None or latest > scoring_date:
        raise ContractError("Training input is empty or contains immature outcomes")
    split = freeze(temporal_split(frame, study.split))
    check_split(split)
    parts = {s: split.where(F.col("split") == s).drop("split") for s in SPLITS}
    fraction = study.targets.patient_fraction
    baselines = trainer(
        parts["train"],
        parts["validation"],
        list(bundle.features),
        seed=study.split.seed,
        fraction=fraction,
        **options,
    )
    cutoff = split.where(F.col("split").isin("train", "validation")).agg(
        F.max("label_available_date")
    ).first()[0]
    model = DeliveryModel(
        baselines.candidates[baselines.selected],
        bundle.features,
        cutoff,
        study.policy_hash(),
        baselines.evidence,
        feature_schema(frame, bundle.features),
        kind,
    )
    held_out = {s: parts[s] for s in ("validation", "test")}
    return Training(
        model, baselines, split, split_counts(split), comparison(baselines, held_out, fraction)
    )


def verify_reload(model: DeliveryModel, frame: DataFrame, path: str) -> DeliveryModel:
    """Save, load and compare scores; returns the loaded model."""
    spark = frame.sparkSession
    model.save(spark, path)
    loaded = DeliveryModel.load(spark, path)
    gap = score_difference(model.ranker.score(frame), loaded.ranker.score(frame))
    if gap > RELOAD_TOLERANCE:
        raise ContractError(f"Reloaded model differs by {gap}")
    return loaded


@dataclass
class Delivery:
    patients: DataFrame
    attribution: DataFrame
    targets: DataFrame
    coverage: DataFrame
    batch: ScoringBatch


def deliver(
    batch: ScoringBatch,
    model: DeliveryModel,
    study: Study,
    scoring_date: date,
    *,
    data_scope: str = "unverified local data",
    kind: str = "unverified",
) -> Delivery:
    """Score the live batch and turn it into the provider table."""
    rules = study.targets
    scored = freeze(
        model.predict(
            batch.modeling_frame(), study, scoring_date, offered=batch.features, kind=kind
        )
    )
    if batch.snapshots.limit(1).count():
        patients = freeze(rank_patients(scored, SCORE, fraction=rules.patient_fraction))
    else:
        patients = batch.snapshots.select(
            "patient_id",
            "snapshot_id",
            "index_date",
            F.lit(0.0).alias("risk_score"),
            F.lit(0).alias("rank"),
            F.lit(False).alias("selected"),
        )
    attributed = freeze(attributed_patients(patients, batch.events, rules))
    if unknown_providers(attributed, batch.providers).limit(1).count():
        raise ContractError("Attribution contains an HCP absent from the provider directory")
    targets = field_targets(attributed, batch.providers, rules, scoring_date).withColumns(
        {"data_scope": F.lit(data_scope), "model_evidence": F.lit(model.evidence)}
    )
    return Delivery(patients, attributed, targets, field_coverage(attributed, rules), batch)


def write_delivery(result: Delivery, output: str, restricted: str) -> None:
    """Patient-level records go to the restricted folder, provider rows to the output."""
    write_restricted(result.patients, f"{restricted}/patient_scores")
    write_restricted(result.attribution, f"{restricted}/patient_hcp_attribution")
    write_restricted(result.batch.snapshots, f"{restricted}/scoring_cohort")
    write_field_csv(result.targets, f"{output}/hcp_targets", order=[("hcp_rank", True)])


def run(
    tables: dict[str, DataFrame],
    study: Study,
    scoring_date: date,
    *,
    output: str,
    restricted: str,
    model_path: str | None = None,
    columns=None,
    kind: str = "unverified",
    **options,
) -> tuple[Delivery, Training | None]:
    """Train and score (or, with ``model_path`` of an earlier run, score only) and write.

    The canonical tables and the training bundle are written once below ``restricted``, and all
    steps read them there; the audit observed in these writes, with split counts, comparison and
    seconds by step, goes to ``output``.
    """
    check_maturity(study, scoring_date)
    began = time.perf_counter()
    audit = Audit(tables["patients"].sparkSession, f"{restricted}/data")
    checked = canonicalize(tables, columns)
    canonical = {name: audit.write(df, name) for name, df in checked.items()}
    hot = hot_patients(canonical)
    training = None
    batch = scoring_batch(canonical, study, scoring_date, hot=hot)
    seconds = {"tables_and_batch": time.perf_counter() - began}
    if model_path is None:
        began = time.perf_counter()
        bundle = training_bundle(canonical, study, scoring_date, hot=hot, audit=audit)
        training = train(bundle, study, scoring_date, kind=kind, **options)
        seconds["training"] = time.perf_counter() - began
        for row in (r.asDict() for r in training.counts.collect()):  # one row per part
            audit.add(f"split:{row.pop('split')}", "count", row)
        for row in (r.asDict() for r in training.comparison.collect()):  # models x parts
            audit.add(f"model:{row.pop('model')}:{row.pop('split')}", "comparison", row)
        sample = training.split.where(F.col("split") == "validation")
        model = verify_reload(training.model, sample, f"{restricted}/model")
    else:
        model = DeliveryModel.load(canonical["patients"].sparkSession, model_path)
    began = time.perf_counter()
    result = deliver(batch, model, study, scoring_date, kind=kind)
    write_delivery(result, output, restricted)
    audit.add("run", "seconds", seconds | {"delivery": time.perf_counter() - began})
    audit.frame().coalesce(1).write.mode("overwrite").json(f"{output}/audit")
    return result, training
