"""Patient lists, metrics, providers, splits and models on literal cases."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, quality, ranking
from tidemark.operators.attribution import attribute_patients, rule_attribution
from tidemark.operators.opportunity import opportunity_metrics, score_opportunities
from tidemark.params import AttributionRules, OpportunityRules, OpportunityScore, SplitRules
from tidemark.plans import models, sequences, splits
from tidemark.plans.history import HistoryEncoder, eligible_events
from tidemark.schema import LeakageError


def d(text):
    return date.fromisoformat(text)


@pytest.fixture
def assessments(spark):
    """Twenty patients in May; m07 also in March, then with the highest score of all."""
    score = {"m02": 0.8, "m13": 0.7, "m07": 0.3}
    rows = [("m07", "march", d("2023-03-05"), 1, 0.99)]
    for i in range(1, 21):
        p = f"m{i:02d}"
        rows.append((p, f"may-{p}", d("2023-05-05"), int(p in ("m02", "m19")), score.get(p, 0.1)))
    return spark.createDataFrame(
        rows, "patient_id string, snapshot_id string, index_date date, label int, s double"
    )


def test_latest_before_rank(assessments):
    ranked = ranking.rank_patients(assessments, "s", fraction=0.15).orderBy("rank").collect()
    assert len(ranked) == 20
    assert [r["patient_id"] for r in ranked if r["selected"]] == ["m02", "m13", "m07"]
    capture = ranking.capture_metrics(assessments, "s", fraction=0.15).first()
    assert (capture["positives"], capture["captured"]) == (2, 1)
    assert capture["recall"] == 0.5 and capture["precision"] == pytest.approx(1 / 3)
    assert capture["lift"] == pytest.approx(10 / 3)


def test_ties_as_of_and_ambiguity(assessments):
    flat = assessments.withColumn("s", F.lit(0.25))
    assert ranking.rank_patients(flat, "s").orderBy("rank").first()["patient_id"] == "m01"
    early = ranking.latest_assessments(assessments, as_of=d("2023-04-01")).collect()
    assert [r["snapshot_id"] for r in early] == ["march"]
    again = assessments.where("patient_id = 'm04'").withColumn("snapshot_id", F.lit("second"))
    with pytest.raises(ValueError, match="repeated_patient_index"):
        ranking.latest_assessments(assessments.union(again))
    with pytest.raises(ValueError, match="cutoff"):
        ranking.latest_assessments(assessments, as_of=d("2022-01-01"))


@pytest.fixture
def separated(spark):
    """Fifty distinct scores; the four highest are the positives."""
    rows = [(f"n{i:02d}", int(i < 4), (50 - i) / 50) for i in range(50)]
    return spark.createDataFrame(rows, "patient_id string, y int, s double")


def test_separated_classes(separated):
    row = metrics.evaluate_predictions(separated, "y", "s").first()
    assert row["roc_auc"] == 1 and row["pr_auc"] == pytest.approx(1)
    assert row["Recall@10%"] == 1 and row["Precision@10%"] == pytest.approx(0.8)
    assert row["Lift@10%"] == pytest.approx(10) and row["Recall@5%"] == 0.75
    assert ranking.top_k_count(41, 0.05) == 3


def frame(spark, y, s):
    rows = [(f"p{i}", a, b) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "patient_id string, y int, s double")


def test_thresholds(spark):
    df = frame(spark, [1, 0, 1, 0, 1, 0], [0.9, 0.6, 0.55, 0.3, 0.2, 0.05])
    best = metrics.tune_threshold(df, "y", "s").first()
    assert (best["threshold"], best["objective_value"]) == (0.2, pytest.approx(0.75))
    assert best["candidate_count"] == 8
    assert metrics.select_threshold(df, "y", "s") == 0.2
    best = metrics.tune_threshold(
        df, "y", "s", objective="target_recall", target_recall=0.6
    ).first()
    assert (best["threshold"], best["objective_value"]) == (0.55, pytest.approx(2 / 3))


def test_single_class_and_bad_predictions(spark):
    df = frame(spark, [0, 0], [0.2, 0.6])
    row = metrics.classification_metrics(df, "y", "s").first()
    assert row["roc_auc"] is None and row["f1"] == 0 and row["recall"] == 0
    assert metrics.ranking_metrics(df, "y", "s").first()["recall"] is None
    assert metrics.class_imbalance(df, "y").first()["positive_class_weight"] is None
    for y, s in (([2], [0.1]), ([None], [0.1]), ([1], [float("nan")]), ([1], [1.5])):
        with pytest.raises(ValueError):
            metrics.validate_predictions(frame(spark, y, s), "y", "s")


def test_random_metrics_against_plain_python(spark):
    rng = random.Random(7)
    y = [int(rng.random() < 0.3) for _ in range(200)]
    s = [rng.randint(0, 20) / 20 for _ in y]
    row = metrics.classification_metrics(frame(spark, y, s), "y", "s", threshold=0.4).first()
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert row["roc_auc"] == pytest.approx(auc)
    ap = 0.0
    for cut in sorted(set(s), reverse=True):
        k = sum(b >= cut for b in s)
        tp = sum(b >= cut for b in pos)
        ap += sum(b == cut for b in pos) / len(pos) * tp / k
    assert row["pr_auc"] == pytest.approx(ap)


@pytest.fixture
def provider_events(spark):
    rows = [
        ("q1", "X", d("2023-04-01"), "Cardiology", True),
        ("q1", "X", d("2023-04-20"), "Cardiology", True),
        ("q1", "Y", d("2023-05-02"), "General Practice", True),
        ("q2", "V", d("2023-06-01"), "Cardiology", True),
        ("q2", "V", d("2023-06-02"), "Cardiology", True),
        ("q2", "W", d("2023-06-03"), "Cardiology", True),
        ("q2", "R", d("2023-06-30"), "Cardiology", False),
        ("q3", "U", d("2023-06-01"), "Cardiology", True),
        ("q3", "T", d("2023-06-09"), "Cardiology", True),
    ]
    return spark.createDataFrame(
        rows,
        "patient_id string, provider_id string, claim_date date, specialty string, "
        "is_relevant boolean",
    )


def winners(df):
    return {r["patient_id"]: r["hcp_id"] for r in df.collect()}


def test_attribution_rules(spark, provider_events):
    rules = lambda m, **k: AttributionRules(method=m, relevant_col="is_relevant", **k)
    recent = winners(rule_attribution(provider_events, rules("recent_prescriber")))
    assert recent == {"q1": "Y", "q2": "W", "q3": "T"}
    assert winners(rule_attribution(provider_events, rules("plurality"))) == {
        "q1": "X", "q2": "V", "q3": "T",
    }
    special = rules("frequent_specialist", specialists=("cardiology",))
    assert winners(rule_attribution(provider_events, special))["q1"] == "X"
    existing = spark.createDataFrame(
        [("q2", "K")], "patient_id string, attributed_provider_id string"
    )
    mapped = attribute_patients(provider_events, rules("recent_prescriber"), existing)
    assert winners(mapped) == {"q1": "Y", "q2": "K", "q3": "T"}
    own = attribute_patients(
        provider_events, rules("recent_prescriber", prefer_existing=False), existing
    )
    assert winners(own)["q2"] == "W"
    with pytest.raises(ValueError, match="multiple"):
        twice = existing.union(existing.withColumn("attributed_provider_id", F.lit("L")))
        attribute_patients(provider_events, rules("existing"), twice)
    with pytest.raises(ValueError):
        AttributionRules(method="guess")


def test_opportunity_and_scores(spark):
    people = [("u1", "g1", 0.95), ("u2", "g1", 0.6), ("u3", "g2", 0.7), ("u4", "g2", 0.4),
              ("u5", "g2", 0.05)]
    both = spark.createDataFrame(
        people, "patient_id string, hcp_id string, advanced_therapy_propensity_score double"
    )
    scores, mapping = both.drop("hcp_id"), both.select("patient_id", "hcp_id")
    rows = score_opportunities(
        opportunity_metrics(scores, mapping, OpportunityRules(threshold=0.65)), OpportunityScore()
    ).collect()
    g1, g2 = sorted(rows, key=lambda r: r["hcp_id"])
    assert [g["eligible_patient_count"] for g in (g1, g2)] == [2, 3]
    assert [g["high_propensity_patient_count"] for g in (g1, g2)] == [1, 1]
    assert [g["patients_top_5pct"] for g in (g1, g2)] == [1, 0]
    assert [g["patients_top_10pct"] for g in (g1, g2)] == [1, 0]
    assert [g["expected_switchers"] for g in (g1, g2)] == pytest.approx([1.55, 1.15])
    assert [g["hcp_rank"] for g in (g1, g2)] == [1, 2]
    assert g1["opportunity_score_formula"] == "1*none(expected_switchers)"
    # The 60th percentile is 0.64: u1 and u3 are above it.
    share = opportunity_metrics(scores, mapping, OpportunityRules(threshold=None, threshold_percentile=60))
    high = {r["hcp_id"]: r["high_propensity_patient_count"] for r in share.collect()}
    assert high == {"g1": 1, "g2": 1}
    with pytest.raises(ValueError):
        opportunity_metrics(scores.union(scores), mapping, OpportunityRules())
    flat = spark.createDataFrame([("a", 1.0, 3), ("b", 1.0, 1)], "hcp_id string, x double, k int")
    score = OpportunityScore({"x": 1.0, "k": 3.0}, "minmax")
    got = {r["hcp_id"]: r["hcp_opportunity_score"] for r in score_opportunities(flat, score).collect()}
    assert got == {"a": 0.75, "b": 0.0}
    with pytest.raises(ValueError):
        OpportunityScore({"x": 0.0})


def snapshots(spark):
    rows = []
    for i in range(60):
        first = date(2020, 1, 1) + timedelta(days=i * 10)
        for k in range(2):
            t = first + timedelta(days=40 * k)
            rows.append((f"p{i:02d}", f"p{i:02d}_{k}", t, t + timedelta(days=20), int(i % 3 == 0)))
    return spark.createDataFrame(
        rows,
        "patient_id string, snapshot_id string, index_date date, label_available_date date, "
        "label int",
    )


def test_temporal_split_is_disjoint_and_mature(spark):
    data = snapshots(spark)
    out = splits.temporal_split(data, SplitRules())
    splits.check_split(out)
    assert out.count() == data.count()
    manifest = splits.split_manifest(out)
    assert manifest.where("split = 'purged'").count() > 0
    a, b = splits.temporal_cuts(data, SplitRules())
    firsts = sorted(date(2020, 1, 1) + timedelta(days=i * 10) for i in range(60))
    assert a == firsts[int(59 * (1 - 0.2 - 0.2))] and b == firsts[int(59 * 0.8)]
    with pytest.raises(ValueError):
        splits.temporal_cuts(data, SplitRules(train_end=b, validation_end=a))
    with pytest.raises(ValueError, match="empty"):
        splits.check_split(out.where("split <> 'test'"))


def test_stratified_split(spark):
    out = splits.stratified_split(snapshots(spark), SplitRules())
    splits.check_split(out, temporal=False)
    sizes = {
        (r["label"], r["split"]): r["n"]
        for r in out.groupBy("label", "split")
        .agg(F.count_distinct("patient_id").alias("n"))
        .collect()
    }
    assert sizes == {
        (0, "train"): 24, (0, "validation"): 8, (0, "test"): 8,
        (1, "train"): 12, (1, "validation"): 4, (1, "test"): 4,
    }


def test_model_fit_imputes_from_train_and_rejects_overlap(spark):
    rows = [(f"t{i}", f"t{i}", d("2023-02-01"), float(i % 3), int(i % 3 == 2)) for i in range(30)]
    shape = "patient_id string, snapshot_id string, index_date date, x double, label int"
    train = spark.createDataFrame(rows, shape)
    others = [(f"w{i}", f"w{i}", t, 50 + x, y) for i, (_, _, t, x, y) in enumerate(rows[:9])]
    validation = spark.createDataFrame(others, shape)
    assert models.Imputation.fit(train, ["x"]).medians == {"x": 1.0}
    fitted = models.fit_baselines(
        train, validation, ["x"], parameters={"boosted_trees": {"maxIter": 2}}
    )
    assert set(fitted.candidates) == {"boosted_trees", "logistic_regression"}
    scored = fitted.score(validation.withColumn("x", F.lit(None).cast("double")))
    assert all(0 <= r["risk_score"] <= 1 for r in scored.collect())
    with pytest.raises(ValueError, match="in the training and in the validation"):
        models.fit_baselines(train, train, ["x"])
    with pytest.raises(LeakageError):
        models.fit_baselines(train, validation, ["label"])


def test_history_and_sequences(spark):
    s = spark.createDataFrame(
        [("s1", "p1", d("2024-03-01"), d("2024-02-28"), d("2023-03-01"), 1),
         ("s2", "p2", d("2024-03-01"), d("2024-02-28"), d("2023-03-01"), 0)],
        "snapshot_id string, patient_id string, index_date date, feature_cutoff date, "
        "lookback_start date, label int",
    )
    rows = [
        ("s1", f"e{i}", d(t), d(t), "diagnosis_final", f"diagnosis::{c}", "none", "x")
        for i, (t, c) in enumerate([("2024-02-01", "A"), ("2024-02-01", "B"), ("2024-02-11", "A")])
    ]
    e = spark.createDataFrame(
        rows,
        "snapshot_id string, event_id string, event_date date, available_date date, "
        "event_type string, code_token string, therapy_class string, provider_specialty string",
    )
    encoder = HistoryEncoder().fit(e, s)
    assert encoder.vocabulary == (
        "diagnosis_final::diagnosis::A", "diagnosis_final::diagnosis::B"
    )
    out = {r["snapshot_id"]: r for r in encoder.transform(e, s).collect()}
    assert out["s1"]["history_code_0_recency"] == 19 and out["s2"]["history_code_0_recency"] == 366
    assert out["s1"]["history_visit_gap_mean"] == 10 and out["s1"]["history_visit_gap_std"] == 0
    late = e.withColumn("event_date", F.lit(d("2024-02-29")))
    with pytest.raises(LeakageError):
        eligible_events(late, s)
    ready = e.withColumn("days_before_index", F.datediff(F.lit(d("2024-03-01")), "event_date"))
    from tidemark.params import SequenceRules

    voc = sequences.fit_vocabularies(ready)
    assert not sequences.vocabulary_problems(voc).collect()
    coded = sequences.encode_sequences(ready, s, voc, SequenceRules(max_length=2))
    got = {r["snapshot_id"]: r for r in coded.collect()}
    assert got["s1"]["code_ids"] == [3, 2] and got["s1"]["time_delta_days"] == [0, 10]
    assert got["s2"]["attention_mask"] == [False, False] and got["s2"]["length"] == 0
    sizes = {"event_type": 3, "code": 4, "therapy_class": 3, "specialty": 3}
    sequences.require_clean_sequences(sequences.sequence_violations(coded, sizes, 2))
    with pytest.raises(LeakageError):
        small = {**sizes, "code": 3}
        sequences.require_clean_sequences(sequences.sequence_violations(coded, small, 2))
    values = sequences.sequence_split(coded).where("snapshot_id = 's1'").first()["values"]
    assert values[1] == [2.0, 2.0, 2.0, 2.0, 19.0]


def test_feature_and_event_date_rules(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", float("inf"))], "snapshot_id string, label double")
    found = {r["rule"]: r["violations"] for r in quality.feature_violations(df).collect()}
    assert found == {"label_forbidden": 1, "label_infinite": 1, "snapshot_id_repeated": 1}
    with pytest.raises(LeakageError):
        quality.require_no_leakage(df)
    cohort = spark.createDataFrame([("p", d("2024-01-01"))], "patient_id string, index_date date")
    events = spark.createDataFrame([("p", d("2024-01-02"))], "patient_id string, at date")
    with pytest.raises(LeakageError):
        quality.require_no_late_events(events, cohort, "at", key="patient_id")
    assert quality.late_events(events, cohort, "at", key="patient_id").count() == 1
