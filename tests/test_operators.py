"""Ordered scans, intervals, skew handling and the cohort rules against brute force."""

import random
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import literal
from tidemark.functions.leakage import forbidden_names
from tidemark.functions.output import csv_safe
from tidemark.operators import asof, intervals, skew
from tidemark.operators.ordered import exact_quantiles, scan_in_order
from tidemark.operators.stage import freeze
from tidemark.params import CohortRules, Study, TherapyArms, Timeline
from tidemark.plans.cohort import assess, first_month_start
from tidemark.plans.events import build_events
from tidemark.plans.features import build_features
from workload import tables as generated
from workload.registry import canonical

SMALL = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_spread_scan_equals_plain_windows(spark):
    rng = random.Random(5)
    rows = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", rng.randint(0, 9), i,
         rng.randint(1, 9) if rng.random() < 0.9 else None)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    options = dict(
        keys=("k",), position="p", totals={"t": "v"}, previous={"before": "v"}
    )
    order = [("o", False), ("i", True)]
    spread = scan_in_order(df, order, **options, chunks=7)
    assert same(spread, scan_in_order(df, order, **options, spread=False))
    everything = scan_in_order(df, order, position="p", totals={"t": "v"}, chunks=7)
    got = [(r["p"], r["t"]) for r in everything.orderBy("p").collect()]
    total, expected = None, []
    for n, (_, _, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), start=1):
        total = total if v is None else (total or 0) + v
        expected.append((n, total))
    assert got == expected


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1.0, 2.0, 3.5]), rng.random()) for _ in range(101)] + [(None, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double")
    for q in (0.5, 0.9, 0.0, 1.0):
        got = {r["name"]: r["value"] for r in exact_quantiles(df, ["a", "b"], q).collect()}
        assert got["a"] == pytest.approx(np.quantile([r[0] for r in rows if r[0]], q))
        assert got["b"] == pytest.approx(np.quantile([r[1] for r in rows], q))


def test_salted_join_equals_plain_join(spark):
    rng = random.Random(2)
    big = spark.createDataFrame(
        [("h" if i % 2 else f"k{i % 7}", i) for i in range(400)], "k string, v int"
    )
    small = spark.createDataFrame(
        [(k, rng.randint(0, 400)) for k in ["h", "k0", "k2", "k4"] for _ in range(3)],
        "k string, w int",
    )
    on = F.col("v") < F.col("w")
    hot = skew.hot_keys(big, ["k"], hot_rows=100)
    assert hot == [("h", 200)]
    for how in ("inner", "left"):
        plain = skew.salted_join(big, small, ["k"], on, [], how=how)
        spread = skew.salted_join(big, small, ["k"], on, hot, how=how, rows_per_salt=20)
        assert same(plain, spread) and plain.count()
    assert skew.hot_keys(big, ["k"]) == []


def test_lookup_paths_agree(spark):
    big = spark.createDataFrame([(f"k{i % 5}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    dim = spark.createDataFrame([(f"k{i}", i * 10) for i in range(4)], "k string, d int")
    assert same(skew.lookup(big, dim, "k"), skew.lookup(big, dim, "k", rows=0))


def days_of(spans, low, high):
    return [any(s <= d < e for s, e in spans) for d in range(low, high)]


def longest_gap(cover):
    best = run = 0
    for c in cover:
        run = 0 if c else run + 1
        best = max(best, run)
    return best


def test_coverage_against_single_days(spark):
    rng, base = random.Random(3), date(2020, 1, 1)
    at = lambda n: base + timedelta(days=n)
    rows, expected = [], {}
    for g in range(120):
        spans = [
            (s := rng.randint(-20, 60), s + rng.choice([0, 1, 5, 20, 70]))
            for _ in range(rng.randint(0, 6))
        ]
        rows += [(g, at(s), at(e), at(0), at(40)) for s, e in [*spans, (0, 0)]]
        cover = days_of(spans, 0, 40)
        expected[g] = (sum(cover), longest_gap(cover), cover[-1])
    df = spark.createDataFrame(rows, "g int, s date, e date, low date, high date")
    got = {
        r["g"]: (r["covered_days"], r["maximum_gap_days"], r["covered_last_day"])
        for r in intervals.coverage(df, ["g"], "s", "e", "low", "high").collect()
    }
    assert got == expected


def test_islands_against_walk(spark):
    rng, base = random.Random(4), date(2020, 1, 1)
    at = lambda n: base + timedelta(days=n)
    rows, expected = [], set()
    for g in range(80):
        spans = [(s := rng.randint(0, 60), s + rng.randint(0, 15)) for _ in range(rng.randint(1, 6))]
        rows += [(g, at(s), at(e)) for s, e in spans]
        cover = {d for s, e in spans for d in range(s, e + 1)}
        for d in sorted(cover):
            if d - 1 not in cover:
                end = d
                while end + 1 in cover:
                    end += 1
                expected.add((g, at(d), at(end)))
    df = spark.createDataFrame(rows, "g int, s date, e date")
    got = {tuple(r) for r in intervals.islands(df, "g", "s", "e").collect()}
    assert got == expected


def test_known_claims_status(spark):
    d = lambda n: date(2024, 1, n)
    claims = spark.createDataFrame(
        [("a", "p", d(1), d(2), "paid", None), ("b", "p", d(1), d(2), "paid", d(10)),
         ("c", "p", d(9), d(9), "paid", None), ("e", "p", d(1), d(20), "paid", None)],
        "claim_id string, patient_id string, fill_date date, available_date date, "
        "status string, reversal_date date",
    )
    at = spark.createDataFrame([("p", d(10)), ("p", d(9))], "patient_id string, index_date date")
    known = asof.known_claims(claims, "fill_date", at, 1)
    got = {(r["claim_id"], r["index_date"].day): r["status"] for r in known.collect()}
    assert got == {
        ("a", 9): "paid", ("a", 10): "paid", ("b", 9): "paid", ("b", 10): "reversed",
        ("c", 10): "paid",
    }


# --- cohort rules against a plain restatement ----------------------------------------------

ARMS = TherapyArms(
    conventional_drugs=("c1", "both"), conventional_classes=("conv",), advanced_classes=("adv",)
)
START = date(2020, 1, 1)


def random_case(seed):
    rng = random.Random(seed)
    at = lambda n: START + timedelta(days=n)
    patients, med, rx, enrol = [], [], [], []
    for p in range(90):
        pid = f"p{p}"
        patients.append((pid, 1980, "F", "g", at(0), at(rng.choice([330, 420, 700]))))
        cut = rng.choice([None, 200, 300])
        if cut is None:
            enrol.append((pid, at(0), at(700), "a"))
        else:
            enrol += [(pid, at(0), at(cut), "a"), (pid, at(cut + rng.choice([1, 2])), at(700), "a")]
        for i in range(rng.randint(4, 9)):
            s = rng.randint(0, 420)
            a = s + rng.choice([0, 2, 40])
            gone = None if rng.random() < 0.6 else at(a + rng.randint(0, 90))
            med.append((f"m{p}_{i}", pid, at(s), at(a), rng.choice(["final", "final", "rejected"]),
                        rng.choice(["D", "E", "E", "E", "X", None]), None, None, "office", gone))
        for i in range(rng.randint(4, 16)):
            s = rng.randint(0, 430)
            a = s + rng.choice([0, 1, 35])
            gone = None if rng.random() < 0.6 else at(a + rng.randint(0, 120))
            drug, cls = rng.choice(
                [("c1", "x"), ("c3", "conv"), ("a1", "adv"), ("a1", "adv"), ("a1", "adv"), ("both", "adv"),
                 ("z", "other")] + [("c2", "conv")] * 20
            )
            n = rng.choice([0, 10, 30, 60, 60])
            rx.append((f"r{p}_{i}", pid, at(s), at(a), rng.choice(["paid", "final", "rejected"]),
                       drug, cls, 1.0, n, None, None, 1.0, gone))
    return patients, med, rx, enrol


def restated(case, study, labelled, pid, t):
    """One candidate by the rules in prose."""
    patients, med, rx, enrol = case
    tl, co = study.timeline, study.cohort
    dd = timedelta
    person = next(p for p in patients if p[0] == pid)

    def status(row, on):
        return "reversed" if row[-1] is not None and row[-1] <= on else row[4]

    def known(rows, on, lag):
        return [r for r in rows if r[1] == pid and r[2] <= on - dd(days=lag) and r[3] <= on
                and status(r, on) in ("paid", "final")]

    conv = lambda r: r[5] in ("c1", "both") or r[6] == "conv"
    adv = lambda r: r[6] == "adv"
    mature = t + dd(days=tl.horizon_days + tl.runout_days)
    need0 = t - dd(days=max(tl.observation_days, tl.history_days, co.coverage_window_days))
    need1 = t + dd(days=tl.followup_days) if labelled else t
    cover = {e[1] + dd(days=i) for e in enrol if e[0] == pid for i in range((e[2] - e[1]).days + 1)}
    enrolled = all(need0 + dd(days=i) in cover for i in range((need1 - need0).days + 1))
    fills = [r for r in known(rx, t, tl.lag_days) if conv(r)]
    dx = known(med, t, tl.lag_days)
    first = min((r[2] for r in dx if r[5] in co.diagnosis_codes), default=None)
    confirmed = first is not None and any(
        r[2] > first + dd(days=co.separation_days) for r in dx if r[5] in co.confirmation_codes
    )
    days = [any(r[2] <= (d := t - dd(days=i)) < r[2] + dd(days=r[8]) for r in fills)
            for i in reversed(range(co.coverage_window_days))]
    prior = any(adv(r) for r in known(rx, t, tl.lag_days if labelled else 0))
    reason = None
    if t > tl.as_of:
        reason = "future_index"
    elif labelled and mature > tl.as_of:
        reason = "immature_label"
    elif person[4] > need0 or person[5] < need1 or not enrolled:
        reason = "insufficient_observation_or_enrollment"
    elif not confirmed:
        reason = "diagnosis_not_confirmed"
    elif not fills:
        reason = "no_conventional_exposure"
    elif sum(days) < co.minimum_covered_days:
        reason = "insufficient_conventional_coverage"
    elif co.require_on_index and not days[-1]:
        reason = "no_conventional_coverage_on_index"
    elif co.maximum_gap_days is not None and longest_gap(days) > co.maximum_gap_days:
        reason = "conventional_gap"
    elif prior:
        reason = "known_prior_advanced"
    outcome = None
    if labelled:
        seen = [r[2] for r in known(rx, mature, 0)
                if adv(r) and t < r[2] <= t + dd(days=tl.horizon_days)]
        outcome = min(seen, default=None)
    start = min((r[2] for r in fills), default=None)
    return reason, sum(days), longest_gap(days), start, outcome


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("hot", [False, True])
def test_cohort_against_restatement(spark, labelled, hot):
    case = random_case(11)
    patients, med, rx, enrol = case
    study = Study(
        timeline=Timeline(
            as_of=START + timedelta(days=440), observation_days=120, horizon_days=60,
            minimum_followup_days=20, lag_days=5, runout_days=15,
            index_start=START + timedelta(days=100), index_end=START + timedelta(days=460),
        ),
        cohort=CohortRules(
            "c", ("D", "E"), ("E",), separation_days=10, coverage_window_days=90,
            minimum_covered_days=5, maximum_gap_days=60, require_on_index=hot,
        ),
        arms=ARMS,
    )
    tables = {
        "patients": literal(spark, "patients", patients),
        "medical_claims": literal(spark, "medical_claims", med, ", reversal_date date"),
        "pharmacy_claims": literal(spark, "pharmacy_claims", rx, ", reversal_date date"),
        "enrollment": literal(spark, "enrollment", enrol),
    }
    heavy = [("p0", 9), ("p3", 9)] if hot else []
    rows = assess(tables, study, labelled=labelled, hot=heavy).collect()
    months = []
    t = first_month_start(study.timeline.index_start)
    while t <= study.timeline.index_end:
        months.append(t)
        t = first_month_start(t + timedelta(days=1))
    assert len(rows) == len(months) * len(patients)
    seen = set()
    for r in rows:
        outcome = r["outcome_date"] if labelled else None
        got = (r["reason"], r["covered_days"], r["maximum_gap_days"], r["start_dt"], outcome)
        expected = restated(case, study, labelled, r["patient_id"], r["index_date"])
        assert got == expected, (r["patient_id"], r["index_date"])
        seen.add(r["reason"])
    assert len(seen) >= 6 and {None, "known_prior_advanced"} <= seen


def test_hot_patient_paths_give_the_same_rows(spark):
    tables, study = canonical(spark, SMALL), generated.STUDY
    few = [("1", 50), ("7", 60), ("12", 70)]
    plain = freeze(assess(tables, study, hot=[]))
    assert same(plain, freeze(assess(tables, study, hot=few)))
    snapshots = freeze(plain.where("reason is null").drop("reason"))
    events = lambda hot: freeze(build_events(tables, snapshots, hot=hot))
    assert same(events([]), events(few))
    wide = lambda hot: freeze(build_features(tables, snapshots, study, hot=hot))
    a, b = wide([]), wide(few)
    cents = {c: F.round(c, 2) for c in a.columns if c.startswith("patient_cost")}
    assert same(a.withColumns(cents), b.withColumns(cents))


def test_csv_safe_and_names(spark):
    df = spark.createDataFrame([(" =1",), ("a=1",), (None,), ("-x",)], "t string")
    assert [r[0] for r in csv_safe(df).collect()] == ["' =1", "a=1", None, "'-x"]
    bad = ["label", "my_target_x", "patient_id", "age", "split_a", "futures", "index_date"]
    assert forbidden_names(bad) == ["label", "my_target_x", "patient_id", "split_a", "index_date"]


def test_parameters_reject_bad_values():
    with pytest.raises(ValueError, match="overlap"):
        TherapyArms(conventional_drugs=("a",), advanced_drugs=("a",))
    with pytest.raises(ValueError):
        Timeline(as_of=START, observation_days=0)
    with pytest.raises(ValueError):
        replace(generated.STUDY.cohort, minimum_covered_days=1000)
