"""The seven-table contract case and the end-to-end case."""

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import contract_rows, day, literal
from tidemark.operators import quality
from tidemark.operators.asof import effective_mapping
from tidemark.operators.stage import freeze
from tidemark.params import SplitRules
from tidemark.plans import delivery
from tidemark.plans.cohort import build_cohort, require_snapshots, timeline_differences
from tidemark.plans.events import build_events
from tidemark.plans.features import build_features, feature_names
from tidemark.plans.models import DeliveryModel
from tidemark.plans.prepared import Prepared, load_prepared, validate_prepared
from tidemark.schema import TABLES, ContractError, LeakageError
from tidemark.sources.directory import (
    canonicalize,
    load_directory,
    rename_columns,
    save_directory,
    table_path,
)


LABELS = {"ines": 1, "otto": 0, "ruth": 0}


def labels(cohort):
    return {r["patient_id"]: r["label"] for r in cohort.snapshots.collect()}


def test_parquet_round_trip(spark, tables, study, tmp_path):
    save_directory(tables, str(tmp_path), "parquet")
    loaded = load_directory(spark, str(tmp_path), file_format="parquet", check=False)
    assert labels(build_cohort(loaded, study)) == LABELS


def test_csv_round_trip_gives_labels_and_features(spark, tables, study, tmp_path):
    save_directory(tables, str(tmp_path), "csv")
    loaded = load_directory(spark, str(tmp_path), file_format="csv")
    drugs = {r[0] for r in loaded["therapy_mapping"].select("drug_id").collect()}
    assert drugs == {"00417", "90088"}
    cohort = build_cohort(loaded, study)
    cohort.snapshots = freeze(cohort.snapshots)
    assert labels(cohort) == LABELS
    assert not timeline_differences(cohort.snapshots, loaded, study).collect()
    wide = freeze(build_features(loaded, cohort.snapshots, study))
    assert len(wide.columns) - 2 == len(feature_names(study)) == 70
    fills = wide.join(cohort.snapshots.select("snapshot_id", "patient_id"), "snapshot_id")
    assert {r["patient_id"]: r["pharmacy_count_30d"] for r in fills.collect()} == {
        "ines": 0, "otto": 1, "ruth": 1,
    }
    events = freeze(build_events(loaded, cohort.snapshots))
    assert len(events.columns) == 19
    bundle = Prepared(cohort.snapshots, wide, events, tuple(feature_names(study)))
    validate_prepared(bundle, study)
    profile = quality.table_profile(loaded)
    found = profile.where("table = 'patients' and measure = 'distinct'").first()
    assert found["value"] == "3"


def test_late_availability_drops_the_confirmation(tables, study):
    late = F.when(F.col("claim_id") == "v4", F.lit(day("2022-03-05")))
    med = tables["medical_claims"].withColumn(
        "available_date", F.coalesce(late, "available_date")
    )
    cohort = build_cohort({**tables, "medical_claims": med}, study)
    assert labels(cohort) == {"ines": 1, "ruth": 0}
    assert [r["reason"] for r in cohort.exclusions.collect()] == ["diagnosis_not_confirmed"]


def test_empty_training_cohort_is_an_error(tables, study):
    early = replace(study, timeline=replace(study.timeline, as_of=day("2022-02-20")))
    cohort = build_cohort(tables, early)
    assert {r["reason"] for r in cohort.exclusions.collect()} == {"future_index"}
    with pytest.raises(ValueError):
        require_snapshots(cohort.snapshots)


def test_contract_violations_are_counted_and_raised(tables):
    planted = [
        ("medical_claims", "status", "denied", "status_unsupported", 6),
        ("pharmacy_claims", "quantity", -1.0, "quantity_negative_or_missing", 5),
        ("pharmacy_claims", "prescriber_id", "zz", "prescriber_id_unknown", 1),
        ("patients", "patient_id", "otto", "patient_id_repeated", 1),
        ("enrollment", "coverage_end", day("2001-01-01"), "coverage_start_after_coverage_end", 4),
    ]
    bad = dict(tables)
    for table, column, value, _, _ in planted:
        bad[table] = bad[table].withColumn(column, F.lit(value))
    found = freeze(quality.table_violations(bad))
    counts = {(r["table"], r["rule"]): r["violations"] for r in found.collect()}
    for table, _, _, rule, n in planted:
        assert counts[table, rule] == n
    with pytest.raises(ContractError, match="status_unsupported"):
        quality.require_clean(found)
    with pytest.raises(ContractError, match="Missing required table"):
        canonicalize({k: v for k, v in tables.items() if k != "plans"})


def test_mapping_must_match_once_and_agree(tables):
    rx, mapping = tables["pharmacy_claims"], tables["therapy_mapping"]
    with pytest.raises(ContractError, match="conflicts"):
        effective_mapping(rx.withColumn("therapy_class", F.lit("advanced")), mapping)
    short = mapping.withColumn("effective_end", F.lit(day("2022-01-24")))
    with pytest.raises(ContractError, match="exactly one"):
        effective_mapping(rx, short)


def test_overlapping_mapping_is_inclusive(tables):
    extra = tables["therapy_mapping"].withColumn("effective_start", F.lit(day("2024-12-31")))
    extra = extra.withColumn("effective_end", F.lit(day("2026-12-31")))
    with pytest.raises(ContractError, match="Overlapping"):
        effective_mapping(tables["pharmacy_claims"], tables["therapy_mapping"].union(extra))


def test_source_names_are_renamed_and_collisions_rejected(tables):
    upper = tables["patients"].withColumnRenamed("patient_id", "MEMBER")
    assert "patient_id" in rename_columns(upper, {"MEMBER": "patient_id"}, "patients").columns
    with pytest.raises(ContractError, match="duplicate"):
        canonicalize({**tables, "patients": upper}, {"patients": {"MEMBER": "gender"}})


def test_table_paths():
    assert table_path("/d", "plans", None, "csv") == "/d/plans.csv"
    assert table_path("/d", "plans", "dim", "parquet") == "/d/dim.parquet"
    assert table_path("/d", "plans", "/x/y.csv", "csv") == "/x/y.csv"


def test_prepared_loader_normalises_and_validates(tables, study):
    cohort = build_cohort(tables, study)
    cohort.snapshots = freeze(cohort.snapshots)
    s = cohort.snapshots.drop("label").withColumn("eligible", F.lit("TRUE"))
    wide = s.select("snapshot_id", F.col("index_date").alias("FEATURE_AS_OF"), F.lit("3").alias("x"))
    events = freeze(build_events(tables, cohort.snapshots))
    lineage = {"x": {"available_at_index": True, "definition": "d"}}
    bundle = load_prepared(
        {"snapshots": s, "wide": wide, "events": events}, study, ("x",), lineage=lineage
    )
    assert {r["label"] for r in bundle.snapshots.collect()} == {0, 1}
    assert bundle.wide.schema["x"].dataType.simpleString() == "double"
    assert bundle.modeling_frame().count() == 3
    with pytest.raises(ContractError, match="lineage"):
        validate_prepared(bundle, study, {})
    late = bundle.events.withColumn("event_date", F.col("index_date"))
    with pytest.raises(LeakageError, match="after_cutoff"):
        validate_prepared(replace(bundle, events=late), study)
    with pytest.raises(LeakageError, match="allowlist"):
        validate_prepared(replace(bundle, features=("y",)), study)


WAVES = (0, 200, 400)
COPIES = 6


def waves(spark):
    """The contract case in three waves, days apart, each with copies of its patients."""
    rows = contract_rows()
    out = {name: list(rows[name]) for name in ("providers", "plans")}
    out["therapy_mapping"] = [(d, c, day("2015-01-01"), day("2030-12-31")) for d, c, _, _ in
                              rows["therapy_mapping"]]
    for name in ("patients", "medical_claims", "pharmacy_claims", "enrollment"):
        id_columns = {
            i for i, c in enumerate(TABLES[name].required.names) if c in ("claim_id", "patient_id")
        }
        out[name] = []
        for days in WAVES:
            later = timedelta(days=days)
            for copy in range(COPIES):
                for row in rows[name]:
                    new = [
                        f"{v}-{days}-{copy}" if i in id_columns
                        else v + later if isinstance(v, date) else v
                        for i, v in enumerate(row)
                    ]
                    if name == "patients":
                        new.append(day("2022-03-01") + later)
                    out[name].append(tuple(new))
    extra = {"patients": ", index_date date"}
    return {name: literal(spark, name, new, extra.get(name, "")) for name, new in out.items()}


def test_end_to_end(spark, study, tmp_path):
    """On the scoring day only the last wave has supply left; its Ines has switched already,
    its Ruth switches nine days later. So Otto and Ruth are scored, six copies each."""
    tables = waves(spark)
    scoring = day("2023-06-10")
    full = replace(
        study,
        timeline=replace(
            study.timeline,
            as_of=scoring,
            strategy="provided",
            snapshots_per_patient=1,
            index_start=day("2022-01-01"),
            index_end=day("2023-04-05"),
        ),
        split=SplitRules(train_end=day("2022-06-30"), validation_end=day("2023-01-31")),
    )
    result, training = delivery.run(
        tables,
        full,
        scoring,
        output=f"{tmp_path}/out",
        restricted=f"{tmp_path}/restricted",
        parameters={"boosted_trees": {"maxIter": 3}, "logistic_regression": {"maxIter": 20}},
    )
    assert result.patients.count() == 12
    assert result.patients.where("selected").count() == 2
    field = spark.read.option("header", True).csv(f"{tmp_path}/out/hcp_targets")
    assert field.count() == 1
    assert not any("patient_id" in c for c in field.columns)
    assert training.comparison.count() == 4
    counts = {r["split"]: r["patients"] for r in training.counts.collect()}
    assert counts == {"train": 18, "validation": 18, "test": 18}
    cover = result.coverage.first()
    assert cover["eligible_patients"] == 12
    loaded = DeliveryModel.load(spark, f"{tmp_path}/restricted/model")
    again = delivery.deliver(result.batch, loaded, full, scoring)
    assert again.targets.collect() == result.targets.collect()
    changed = replace(full, timeline=replace(full.timeline, lag_days=5))
    with pytest.raises(ContractError, match="refit"):
        training.model.predict(result.batch.modeling_frame(), changed, scoring)
    with pytest.raises(ContractError, match="mature"):
        delivery.check_maturity(full, day("2023-06-05"))
