"""Warehouse export: manifest, caps, tampering, projections, sinks."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators import quality
from tidemark.schema import TABLES, ContractError, LeakageError
from tidemark.sources import export, projections, sinks
from tidemark.sources.audit import Audit
from tidemark.sources.directory import save_directory


def queries(tables, prefix):
    out = {}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
        out[name] = f"SELECT * FROM {prefix}_{name}"
    return out


def test_export_is_verified_until_a_file_changes(spark, tables, tmp_path):
    as_of = day("2022-12-31")
    export.export_tables(
        spark, queries(tables, "ok"), str(tmp_path), as_of=as_of, kind="real", version="v1",
        max_rows=10,
    )
    export.verify_manifest(spark, str(tmp_path), as_of=as_of, version="v1")
    assert export.file_digests(spark, str(tmp_path / "plans.csv")).count() >= 1
    with pytest.raises(ContractError, match="version"):
        export.verify_manifest(spark, str(tmp_path), as_of=as_of, version="v2")
    other = spark.createDataFrame([("basic", "medicare")], TABLES["plans"].fields)
    other.write.mode("overwrite").option("header", True).csv(f"{tmp_path}/plans.csv")
    with pytest.raises(ContractError, match="plans"):
        export.verify_manifest(spark, str(tmp_path), as_of=as_of, version="v1")


def test_oversize_export_fails_and_says_so(spark, tables, tmp_path):
    with pytest.raises(ContractError, match="exceeds"):
        export.export_tables(
            spark, queries(tables, "big"), str(tmp_path), as_of=day("2022-12-31"), max_rows=1
        )
    states = {r["status"] for r in export.read_manifest(spark, str(tmp_path)).collect()}
    assert states == {"FAILED"}
    with pytest.raises(ContractError, match="incomplete"):
        export.verify_manifest(spark, str(tmp_path), as_of=day("2022-12-31"))


def test_query_columns_are_checked(spark, tables):
    tables["plans"].createOrReplaceTempView("few_plans")
    with pytest.raises(ContractError, match="payer_type"):
        export.read_query(spark, "plans", "SELECT plan_id FROM few_plans")


def test_digest_ignores_order_but_not_content(tables):
    df = tables["pharmacy_claims"]
    a = export.content_digest(df).first()
    assert a == export.content_digest(df.repartition(3).orderBy(F.desc("claim_id"))).first()
    assert a != export.content_digest(df.withColumn("status", F.lit("final"))).first()


def test_projection_and_explode(spark):
    source = spark.createDataFrame(
        [("e1", "p", ["A", "B"], "X"), ("e2", "p", [], "Y"), ("e3", "p", None, "Z")],
        "id string, who string, dx array<string>, proc string",
    )
    lines = projections.explode_diagnoses(
        source, event_id="id", diagnoses="dx", procedure="proc", keep=("who",)
    )
    got = {r["claim_id"]: (r["diagnosis_code"], r["procedure_code"]) for r in lines.collect()}
    assert got == {
        "e1:0": ("A", "X"), "e1:1": ("B", None), "e2:none": (None, "Y"), "e3:none": (None, "Z"),
    }
    plans = projections.project(
        source, "plans", {"plan_id": "id", "payer_type": F.upper("who")}
    )
    assert plans.columns == ["plan_id", "payer_type"]
    with pytest.raises(ValueError):
        projections.project(source, "plans", {"plan_id": "id"})


def test_field_file_rejects_patient_columns(tables, tmp_path):
    with pytest.raises(LeakageError):
        sinks.write_field_csv(tables["enrollment"], str(tmp_path / "x"))


def test_column_inventory(tables):
    inventory = quality.column_inventory(tables)
    assert inventory.where("table = 'plans'").count() == 2
    missing = quality.missing_tables(inventory, ["plans", "absent"]).collect()
    assert [r["table"] for r in missing] == ["absent"]


def test_files_are_held_against_their_manifest(spark, tables, tmp_path):
    folder = str(tmp_path / "claims")
    save_directory(tables, folder, "parquet")
    export.write_file_manifest(spark, folder)
    assert export.load_verified(spark, folder, required=True)["patients"].count() == 3
    assert export.file_differences(spark, folder).count() == 0
    tables["plans"].where("plan_id = 'basic'").coalesce(1).write.mode("append").parquet(f"{folder}/plans.parquet")
    found = export.file_differences(spark, folder).collect()
    assert [(r["table"], r["state"], r["rows_now"]) for r in found] == [("plans", "added", 1)]
    with pytest.raises(ContractError, match="plans: 1 added"):
        export.load_verified(spark, folder)
    other = str(tmp_path / "bare")
    save_directory(tables, other, "parquet")
    assert export.load_verified(spark, other)["plans"].count() == 2
    with pytest.raises(ContractError, match="no file manifest"):
        export.load_verified(spark, other, required=True)


def test_statements_are_judged_by_their_verb_alone():
    for text in (
        "select update, truncate(x) as create from t",
        "with a as (select 1 as x), b as (select ')' as y from a) select * from b",
        "WITH a(x) AS (SELECT 1) SELECT 'delete from t; drop' AS s FROM a -- insert",
    ):
        assert export.select_only(text)
    for text in ("with a as (select 1) delete from t", "insert into t select 1", "select 1; select 2"):
        with pytest.raises(ContractError):
            export.select_only(text)


def test_audit_takes_its_figures_from_the_write(spark, tables, tmp_path):
    audit = Audit(spark, str(tmp_path / "audit"))
    plans = audit.write(tables["plans"], "plans")
    assert plans.count() == 2
    rows = {(r["measure"], r["column"]): r["value"] for r in audit.frame().collect()}
    recorded = export.content_digest(tables["plans"]).first()
    assert rows["rows", ""] == str(recorded[0]) and rows["digest", ""] == recorded[1]
    assert rows["nulls", "payer_type"] == "0"
    empty = audit.write(tables["enrollment"].where("1 = 0"), "enrollment")
    assert empty.count() == 0 and empty.columns == tables["enrollment"].columns
    last = {(r["measure"], r["column"]): r["value"] for r in audit.frame().where("table = 'enrollment'").collect()}
    assert last["rows", ""] == "0" and last["min", "coverage_start"] is None
    assert last["digest", ""] == export.content_digest(empty).first()[1]
