"""The generated star schema read as the seven canonical claims tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import (
    CohortRules,
    FeatureRules,
    SequenceRules,
    SplitRules,
    Study,
    TargetRules,
    TherapyArms,
    Timeline,
)

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")

STUDY = Study(
    timeline=Timeline(
        as_of=date(2001, 12, 31),
        observation_days=365,
        horizon_days=180,
        minimum_followup_days=180,
        lag_days=7,
        runout_days=30,
        index_start=date(1997, 1, 1),
        index_end=date(2000, 12, 1),
    ),
    cohort=CohortRules(
        cohort_id="generated",
        diagnosis_codes=PRIORITIES,
        confirmation_codes=PRIORITIES,
        separation_days=90,
        coverage_window_days=180,
        minimum_covered_days=40,
        maximum_gap_days=120,
    ),
    arms=TherapyArms(conventional_classes=("conventional",), advanced_classes=("advanced",)),
    features=FeatureRules(
        specialists=("EUROPE", "ASIA"),
        symptom_codes=("1-URGENT", "2-HIGH"),
        comorbidity_codes=("5-LOW",),
    ),
    sequence=SequenceRules(max_length=12, min_frequency=2),
    split=SplitRules(train_end=date(1998, 1, 1), validation_end=date(1999, 6, 1)),
    targets=TargetRules(relevant_specialties=("EUROPE", "ASIA")),
)
SCORING_DATE = date(2001, 6, 1)


# fixed values: column types of the generated tables that are read here
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table; the declared schema saves the job that would infer it."""
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def canonical(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda name: source(spark, sf_dir, name)
    customer, nation, orders = read("customer"), read("nation"), read("orders")
    lineitem, part, supplier, region = (
        read("lineitem"), read("part"), read("supplier"), read("region"),
    )
    day = lambda text: F.lit(text).cast("date")
    key = F.col("c_custkey")
    patients = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.cast("string").alias("patient_id"),
        (F.lit(1930) + key % 60).cast("int").alias("birth_year"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.col("n_name").alias("geography"),
        day("1995-01-01").alias("observation_start"),
        F.when(key % 11 == 0, day("1999-06-30"))
        .otherwise(day("2001-12-31"))
        .alias("observation_end"),
    )
    order = F.col("o_orderkey")
    ordered = F.col("o_orderdate").cast("date")
    medical = orders.select(
        F.concat(F.lit("m"), order).alias("claim_id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        ordered.alias("claim_date"),
        F.date_add(ordered, (order % 5).cast("int")).alias("available_date"),
        F.when(order % 17 == 0, "rejected").otherwise("final").alias("status"),
        F.col("o_orderpriority").alias("diagnosis_code"),
        F.when(order % 3 == 0, F.concat(F.lit("PX"), order % 10)).alias("procedure_code"),
        (order % 10).cast("string").alias("provider_id"),
        F.when(F.col("o_orderstatus") == "F", "office")
        .when(F.col("o_orderstatus") == "O", "emergency")
        .otherwise("urgent_care")
        .alias("place_of_service"),
    )
    # What a line item tells by itself is derived first, so that the joins shuffle it narrow.
    shipped, filled = F.col("l_shipdate").cast("date"), F.date_add("shipped", F.col("l_linenumber"))
    lines = lineitem.withColumn("shipped", shipped).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "shipped",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "rejected")
        .when(F.col("l_returnflag") == "A", "final")
        .otherwise("paid")
        .alias("status"),
        F.when(
            (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
            F.date_add(filled, 30),
        ).alias("reversal_date"),
        # Whole cents, cut rather than rounded: halves round differently across engines.
        (F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100) / F.lit(100.0)).alias(
            "patient_cost"
        ),
    )
    # Orders meet their customers first, so the many line items are shuffled once less.
    placed = orders.select("o_orderkey", "o_custkey").join(
        customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == key
    )
    pharmacy = (
        lines.join(placed, F.col("l_orderkey") == order)
        .join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws(
                "-",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.col("l_quantity").cast("int"),
                "shipped",
            ).alias("claim_id"),
            F.col("o_custkey").cast("string").alias("patient_id"),
            F.col("shipped").alias("fill_date"),
            filled.alias("available_date"),
            "status",
            "reversal_date",
            F.col("l_partkey").cast("string").alias("drug_id"),
            therapy_class().alias("therapy_class"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_quantity").cast("int").alias("days_supply"),
            F.col("l_suppkey").cast("string").alias("prescriber_id"),
            F.col("c_mktsegment").alias("plan_id"),
            "patient_cost",
        )
    )
    providers = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("provider_id"),
            F.col("r_name").alias("specialty"),
            F.col("n_name").alias("geography"),
            F.col("s_name").alias("organization"),
        )
    )
    plans = customer.groupBy(F.col("c_mktsegment").alias("plan_id")).agg(
        F.max(
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "commercial")
            .when(F.col("c_mktsegment") == "AUTOMOBILE", "medicare")
            .otherwise("medicaid")
        ).alias("payer_type")
    )
    whole = F.struct(day("1995-01-01").alias("s"), day("2001-12-31").alias("e"))
    head = F.struct(day("1995-01-01").alias("s"), day("1998-03-31").alias("e"))
    tail = F.struct(
        F.when(key % 2 == 0, day("1998-04-01")).otherwise(day("1998-05-01")).alias("s"),
        day("2001-12-31").alias("e"),
    )
    enrollment = customer.select(
        key.cast("string").alias("patient_id"),
        F.explode(F.when(key % 7 == 0, F.array(head, tail)).otherwise(F.array(whole))).alias("i"),
        F.col("c_mktsegment").alias("plan_id"),
    ).select(
        "patient_id",
        F.col("i.s").alias("coverage_start"),
        F.col("i.e").alias("coverage_end"),
        "plan_id",
    )
    long = F.struct(day("1990-01-01").alias("s"), day("2030-01-01").alias("e"))
    early = F.struct(day("1990-01-01").alias("s"), day("1998-06-30").alias("e"))
    late = F.struct(day("1998-07-01").alias("s"), day("2030-01-01").alias("e"))
    mapping = part.select(
        F.col("p_partkey").cast("string").alias("drug_id"),
        therapy_class().alias("therapy_class"),
        F.explode(
            F.when(F.col("p_partkey") % 5 == 0, F.array(early, late)).otherwise(F.array(long))
        ).alias("i"),
    ).select(
        "drug_id",
        "therapy_class",
        F.col("i.s").alias("effective_start"),
        F.col("i.e").alias("effective_end"),
    )
    return {
        "patients": patients,
        "medical_claims": medical,
        "pharmacy_claims": pharmacy,
        "providers": providers,
        "plans": plans,
        "enrollment": enrollment,
        "therapy_mapping": mapping,
    }


def therapy_class():
    return (
        F.when(F.col("p_brand") == "Brand#17", "advanced")
        .when(F.col("p_type") == "ECONOMY", "other")
        .otherwise("conventional")
    )
