from datetime import date

import pytest
from pyspark.sql import SparkSession

from tidemark.params import (
    CohortRules,
    FeatureRules,
    SplitRules,
    Study,
    TargetRules,
    TherapyArms,
    Timeline,
)
from tidemark.schema import TABLES


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def day(text):
    return None if text is None else date.fromisoformat(text)


@pytest.fixture
def study():
    return Study(
        timeline=Timeline(
            as_of=day("2022-12-31"),
            observation_days=400,
            horizon_days=60,
            minimum_history_days=120,
            minimum_followup_days=60,
            lag_days=3,
            runout_days=2,
            index_start=day("2022-02-15"),
            index_end=day("2022-03-20"),
        ),
        cohort=CohortRules(
            cohort_id="spring",
            diagnosis_codes=("L40", "L41"),
            confirmation_codes=("L40",),
            separation_days=14,
            coverage_window_days=40,
            minimum_covered_days=15,
        ),
        arms=TherapyArms(conventional_drugs=("00417",), advanced_drugs=("90088",)),
        features=FeatureRules(specialists=("dermatology",)),
        split=SplitRules(),
        targets=TargetRules(relevant_specialties=("dermatology", "rheumatology")),
    )


def literal(spark, name, rows, extra=""):
    return spark.createDataFrame(rows, TABLES[name].fields + extra)


def contract_rows():
    """Three patients at the index date 2022-03-01, whose outcome window ends on 2022-04-30.

    Ines gets the advanced drug inside it, Otto never, Ruth only in the middle of May.
    """
    return {
        "patients": [
            ("ines", 1955, "F", "coast", day("2021-01-01"), day("2022-12-31")),
            ("otto", 1990, "M", "inland", day("2021-01-01"), day("2022-12-31")),
            ("ruth", 1968, "F", "coast", day("2021-01-20"), day("2022-12-31")),
        ],
        "medical_claims": [
            ("v1", "ines", day("2021-11-03"), day("2021-11-20"), "final", "L41", None, "d1", "office"),
            ("v2", "ines", day("2022-01-10"), day("2022-01-30"), "final", "L40", "T5", "d2", "clinic"),
            ("v3", "otto", day("2021-10-05"), day("2021-10-09"), "final", "L40", None, "d1", "office"),
            ("v4", "otto", day("2021-12-20"), day("2021-12-28"), "final", "L40", None, "d1", "office"),
            ("v5", "ruth", day("2021-12-01"), day("2021-12-04"), "final", "L40", None, "d2", "clinic"),
            ("v6", "ruth", day("2022-01-20"), day("2022-01-25"), "final", "L40", None, "d2", "clinic"),
        ],
        "pharmacy_claims": [
            ("w1", "ines", day("2022-01-25"), day("2022-01-29"), "paid", "00417", "conventional",
             60.0, 60, "d1", "basic", 12.5),
            ("w2", "ines", day("2022-03-20"), day("2022-03-25"), "paid", "90088", "advanced",
             4.0, 28, "d2", "senior", 80.0),
            ("w3", "otto", day("2022-02-01"), day("2022-02-04"), "paid", "00417", "conventional",
             180.0, 180, "d1", "basic", 30.0),
            ("w4", "ruth", day("2022-02-10"), day("2022-02-12"), "paid", "00417", "conventional",
             120.0, 120, "d2", "basic", 20.0),
            ("w5", "ruth", day("2022-05-15"), day("2022-05-18"), "paid", "90088", "advanced",
             4.0, 28, "d2", "basic", 75.0),
        ],
        "providers": [
            ("d1", "dermatology", "coast", "north clinic"),
            ("d2", "rheumatology", "inland", "south clinic"),
        ],
        "plans": [("basic", "commercial"), ("senior", "medicare")],
        "enrollment": [
            ("ines", day("2021-01-01"), day("2021-12-31"), "basic"),
            ("ines", day("2022-01-01"), day("2022-12-31"), "senior"),
            ("otto", day("2021-01-01"), day("2022-12-31"), "basic"),
            ("ruth", day("2021-01-20"), day("2022-12-31"), "basic"),
        ],
        "therapy_mapping": [
            ("00417", "conventional", day("2019-01-01"), day("2024-12-31")),
            ("90088", "advanced", day("2021-06-01"), day("2024-12-31")),
        ],
    }


@pytest.fixture
def tables(spark):
    return {n: literal(spark, n, r) for n, r in contract_rows().items()}
