"""How the plans spread their work, where the rows alone do not show it."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidemark.operators.ordered import exact_quantiles
from tidemark.params import SequenceRules
from tidemark.plans import models
from tidemark.plans.cohort import by_patient
from tidemark.plans.events import event_claims, raw_events
from tidemark.plans.features import pharmacy_pass
from tidemark.plans.sequences import encode_claims, encode_sequences, fit_vocabularies
from workload.registry import eligible, encoded
from workload.tables import STUDY


def test_candidates_are_dealt_by_their_number(spark):
    """Few bytes a candidate must not let one task take many of them."""
    pairs = spark.range(2100).select(
        (F.col("id") % 300).cast("string").alias("patient_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 300).cast("int")).alias("index_date"),
    )
    dealt = by_patient(pairs, per_task=100).withColumn("task", F.spark_partition_id())
    assert dealt.rdd.getNumPartitions() == 21
    assert dealt.select(*pairs.columns).exceptAll(pairs).count() == 0 and dealt.count() == 2100
    homes = dealt.groupBy("patient_id").agg(F.count_distinct("task").alias("n"))
    assert homes.where("n <> 1").count() == 0


def test_fills_are_derived_once(spark):
    """Plans behind the eligible snapshots read the written fills, not their four source tables."""
    tables, _ = eligible(spark, "/root/testdata/sf0.001")
    files = tables["pharmacy_claims"].inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_empty_buckets_are_left_out_of_the_fit(spark):
    """A fit sees the buckets that hold training rows, and scores categories it never saw."""
    rows = [(f"p{i}", float(i % 7), "a" if i % 3 else "b", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "patient_id string, x double, kind string, label int")
    held = models.used_buckets(df, ["kind"])
    assert len(held["kind"]) == 2
    frame = models.with_buckets(df, ["kind"]).withColumn("label", F.col("label").cast("double"))
    estimator = models.estimators(60, 1)["logistic_regression"]
    fitted = Pipeline(stages=models._stages(["x"], ["kind"], estimator, scale=True, used=held)).fit(frame)
    assert fitted.stages[-1].numFeatures == 3
    new = models.with_buckets(df.withColumn("kind", F.lit("never seen")), ["kind"])
    assert fitted.transform(new).where("probability is not null").count() == 60


def test_events_are_not_shuffled_after_they_meet_their_snapshots(spark):
    """Ranks and arrays of a sequence keep the patients' partitioning of the join."""
    out, _ = encoded(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(patient_id" in plan and "hashpartitioning(snapshot_id" not in plan


def test_sequences_of_claims_equal_those_of_events(spark):
    """Repeated claims, reversals between two index dates, late ones and snapshots without any."""
    day = lambda c: F.col(c).cast("date")
    medical = spark.createDataFrame(
        [
            ("m1", "a", "2020-01-01", "2020-01-03", "final", "L4", "P1", "d1", "office"),
            ("m1", "a", "2020-01-01", "2020-01-03", "final", "L4", "P1", "d1", "office"),
            ("m2", "a", "2020-01-01", "2020-03-20", "rejected", "L4", None, "d9", "office"),
            ("m3", "b", "2019-01-01", "2019-01-02", None, None, None, None, "office"),
        ],
        "claim_id string, patient_id string, claim_date string, available_date string, status string, "
        "diagnosis_code string, procedure_code string, provider_id string, place_of_service string",
    )
    pharmacy = spark.createDataFrame(
        [
            ("f1", "a", "2020-02-01", "2020-02-02", "paid", "2020-03-15", "7", "conventional", "d2"),
            ("f2", "a", "2020-02-01", "2020-02-02", None, None, "8", None, "d1"),
            ("f3", "a", "2020-02-10", "2020-02-10", "paid", None, None, "other", "d1"),
            ("f4", "c", "2020-02-01", None, "paid", None, "7", "conventional", "d2"),
        ],
        "claim_id string, patient_id string, fill_date string, available_date string, status string, "
        "reversal_date string, drug_id string, therapy_class string, prescriber_id string",
    )
    tables = {
        "medical_claims": medical.withColumns({c: day(c) for c in ("claim_date", "available_date")}),
        "pharmacy_claims": pharmacy.withColumns(
            {c: day(c) for c in ("fill_date", "available_date", "reversal_date")}
        ),
        "providers": spark.createDataFrame([("d1", "x"), ("d2", None)], "provider_id string, specialty string"),
    }
    marks = [(p, f"2020-0{m}-01") for p in "abc" for m in (2, 3, 4)]
    snapshots = spark.createDataFrame(marks, "patient_id string, index_date string").select(
        F.concat_ws("_", "patient_id", "index_date").alias("snapshot_id"),
        "patient_id",
        day("index_date").alias("index_date"),
        F.date_sub(day("index_date"), 7).alias("feature_cutoff"),
        F.date_sub(day("index_date"), 80).alias("lookback_start"),
        F.lit(1).alias("label"),
    )
    claims, events = event_claims(tables, snapshots), raw_events(tables, snapshots)
    assert claims.agg(F.sum("views")).first()[0] == events.count() > 10
    for least in (1, 3):
        words = fit_vocabularies(events, least)
        same = fit_vocabularies(claims, least)
        assert sorted(words.collect()) == sorted(same.collect())
        for size in (2, 12):
            rules = SequenceRules(max_length=size, min_frequency=least)
            a = encode_sequences(events, snapshots, words, rules)
            b = encode_claims(claims, snapshots, words, rules).select(*a.columns)
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 9


def test_fills_are_summed_by_hash(spark):
    """Sums over the fills of a snapshot do not sort its rows a second time."""
    tables, snapshots = eligible(spark, "/root/testdata/sf0.001")
    plan = pharmacy_pass(tables, snapshots, STUDY)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_quantiles_read_their_cells_once(spark):
    """Column sizes come from the running totals, so the values are not exploded again for them."""
    df = spark.createDataFrame([(1, 2.0, None), (3, None, None), (8, 5.0, None)], "a int, b double, c double")
    found = exact_quantiles(df, ["a", "b", "c"], 0.5)
    assert {r["name"]: r["value"] for r in found.collect()} == {"a": 3.0, "b": 3.5}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
