"""Registered queries against their independent SQL on the smallest generated tables.

By default a cross-section runs; TIDEMARK_FULL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as driver
from tests.compare import compare, connect

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
SOME = (
    "mapping_overlap", "coverage_union", "enrollment_islands", "cohort_labels", "scoring_cohort",
    "features_peers", "rank_patients",
)
NAMES = [n for n in driver.queries() if n in driver.oracle_sql()]
if os.environ.get("TIDEMARK_FULL") != "1":
    NAMES = [n for n in NAMES if n in SOME]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert compare(driver.queries()[name](spark, SF), duck, driver.oracle_sql()[name]) is None


def test_comparison_notices_differences(spark, duck):
    df = driver.queries()["medical_grain"](spark, SF)
    sql = driver.oracle_sql()["medical_grain"]
    assert compare(df, duck, sql.replace("count(*) AS rows", "count(*) + 1 AS rows"))


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
