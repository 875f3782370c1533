"""The seven canonical tables: types, keys, intervals, references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks the canonical contract."""


class LeakageError(AssertionError):
    """Information from after the index date would reach a predictor."""


@dataclass(frozen=True)
class Table:
    name: str
    fields: str  # required columns as a DDL string
    optional: str = ""
    key: str | None = None
    intervals: tuple[tuple[str, str], ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()  # (column, table, column)
    service: str | None = None  # service date of a claims table

    @property
    def required(self) -> T.StructType:
        return T.StructType.fromDDL(self.fields)

    @property
    def types(self) -> dict[str, T.DataType]:
        ddl = self.fields + (", " + self.optional if self.optional else "")
        return {f.name: f.dataType for f in T.StructType.fromDDL(ddl)}

    @property
    def dates(self) -> list[str]:
        return [f.name for f in self.required if f.dataType == T.DateType()]


# fixed values: column names and types of the canonical contract
TABLES = {
    t.name: t
    for t in (
        Table(
            "patients",
            "patient_id string, birth_year int, gender string, geography string, "
            "observation_start date, observation_end date",
            optional="index_date date",
            key="patient_id",
            intervals=(("observation_start", "observation_end"),),
        ),
        Table(
            "medical_claims",
            "claim_id string, patient_id string, claim_date date, available_date date, "
            "status string, diagnosis_code string, procedure_code string, provider_id string, "
            "place_of_service string",
            optional="reversal_date date",
            key="claim_id",
            references=(
                ("patient_id", "patients", "patient_id"),
                ("provider_id", "providers", "provider_id"),
            ),
            service="claim_date",
        ),
        Table(
            "pharmacy_claims",
            "claim_id string, patient_id string, fill_date date, available_date date, "
            "status string, drug_id string, therapy_class string, quantity double, "
            "days_supply int, prescriber_id string, plan_id string, patient_cost double",
            optional="reversal_date date",
            key="claim_id",
            references=(
                ("patient_id", "patients", "patient_id"),
                ("prescriber_id", "providers", "provider_id"),
                ("plan_id", "plans", "plan_id"),
            ),
            service="fill_date",
        ),
        Table(
            "providers",
            "provider_id string, specialty string, geography string, organization string",
            key="provider_id",
        ),
        Table("plans", "plan_id string, payer_type string", key="plan_id"),
        Table(
            "enrollment",
            "patient_id string, coverage_start date, coverage_end date, plan_id string",
            intervals=(("coverage_start", "coverage_end"),),
            references=(
                ("patient_id", "patients", "patient_id"),
                ("plan_id", "plans", "plan_id"),
            ),
        ),
        Table(
            "therapy_mapping",
            "drug_id string, therapy_class string, effective_start date, effective_end date",
            intervals=(("effective_start", "effective_end"),),
        ),
    )
}

# fixed values: claim states
STATUSES = ("paid", "final", "rejected", "reversed")
VALID_STATUSES = ("paid", "final")
