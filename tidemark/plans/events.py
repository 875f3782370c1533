"""The long event table: one row per (snapshot, claim code) in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import reversal
from ..operators.asof import status_at
from ..operators.ordered import scan_in_order
from ..operators.skew import lookup, salted_join
from ..operators.stage import stored
from .cohort import hot_patients

LANDMARKS = ("patient_id", "snapshot_id", "index_date", "feature_cutoff", "lookback_start")
EVENT_COLUMNS = (
    "snapshot_id", "patient_id", "index_date", "event_id", "event_date", "available_date",
    "event_type", "code_system", "code", "hcp_id", "product_id", "therapy_class",
    "provider_specialty", "status", "place_of_service",
)


def _in_view(claims: DataFrame, snapshots: DataFrame, service: str, hot) -> DataFrame:
    """Claims inside the snapshot's history window and available by its index date."""
    inside = (
        (F.col(service) <= F.col("feature_cutoff"))
        & (F.col(service) >= F.col("lookback_start"))
        & (F.col("available_date") <= F.col("index_date"))
    )
    return salted_join(claims, snapshots.select(*LANDMARKS), ["patient_id"], inside, hot)


def _with_specialty(tables: dict[str, DataFrame], claims: DataFrame, provider: str) -> DataFrame:
    specialties = tables["providers"].select(F.col("provider_id").alias("hcp_id"), "specialty")
    named = lookup(claims.withColumnRenamed(provider, "hcp_id"), specialties, "hcp_id")
    return named.withColumn(
        "provider_specialty", F.coalesce("specialty", F.lit("unknown"))
    ).drop("specialty")


def _by_code(medical: DataFrame) -> DataFrame:
    """A row for each code of a medical claim, as ``c.kind`` and ``c.code``."""
    codes = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("code"))
            for kind, c in (("diagnosis", "diagnosis_code"), ("procedure", "procedure_code"))
        ]
    )
    return medical.select("*", F.explode(codes).alias("c")).where(F.col("c.code").isNotNull())


def event_claims(tables: dict[str, DataFrame], snapshots: DataFrame) -> DataFrame:
    """The claim codes that at least one snapshot sees, one row each, before the fan-out.

    ``views`` snapshots see the event, ``late_views`` of them as reversed, with ``late_type`` in
    place of ``event_type``; ``event_id`` is its place in the patient's order of dates and event
    ids. Each claim meets the dates of its patient's snapshots as one array, so nothing fans out,
    and only claims in view are looked up, written and shuffled further. For patients whose
    claims fit a task; hot ones go through ``raw_events``.
    """
    med, rx = tables["medical_claims"], tables["pharmacy_claims"]

    def narrow(claims: DataFrame, kind: Column, code: Column, day: str, provider: str, therapy):
        return claims.select(
            "patient_id",
            "claim_id",
            F.col(day).alias("event_date"),
            "available_date",
            reversal(claims).alias("gone"),
            F.concat(kind, F.lit("_"), "status").alias("event_type"),
            F.concat_ws("::", kind, code).alias("code_token"),
            therapy.alias("therapy_class"),
            F.col(provider).alias("hcp_id"),
        )

    medical = narrow(
        _by_code(med), F.col("c.kind"), F.col("c.code"), "claim_date", "provider_id", F.lit("none")
    )
    pharmacy = narrow(
        rx.where(F.col("drug_id").isNotNull()), F.lit("pharmacy"), F.col("drug_id").cast("string"),
        "fill_date", "prescriber_id", F.col("therapy_class"),
    )
    bounds = snapshots.agg(
        F.min("lookback_start").alias("low"),
        F.max("feature_cutoff").alias("high"),
        F.max("index_date").alias("last"),
    )
    edge = lambda c: bounds.select(c).scalar()
    claims = medical.unionByName(pharmacy).where(
        (F.col("event_date") >= edge("low"))
        & (F.col("event_date") <= edge("high"))
        & (F.col("available_date") <= edge("last"))
    )
    marks = snapshots.groupBy("patient_id").agg(
        F.collect_list(F.struct("index_date", "feature_cutoff", "lookback_start")).alias("marks")
    )
    seen = F.filter(
        "marks",
        lambda m: (F.col("event_date") <= m["feature_cutoff"])
        & (F.col("event_date") >= m["lookback_start"])
        & (F.col("available_date") <= m["index_date"]),
    )
    late = F.filter("marks", lambda m: F.col("gone") <= m["index_date"])
    kind = F.substring_index("code_token", "::", 1)
    order = Window.partitionBy("patient_id").orderBy(
        "event_date", F.concat("claim_id", F.lit("__"), kind)
    )
    met = (
        claims.join(marks, "patient_id")
        .withColumn("marks", seen)
        .withColumns(
            {
                "views": F.size("marks"),
                "late_views": F.when(F.col("gone").isNull(), 0).otherwise(F.size(late)),
            }
        )
        .where("views > 0")
        .withColumns(
            {
                "event_id": F.row_number().over(order),
                "late_type": F.concat(kind, F.lit("_reversed")),
            }
        )
        .drop("marks", "claim_id")
    )
    return stored(_with_specialty(tables, stored(met), "hcp_id").drop("hcp_id"))


def raw_events(
    tables: dict[str, DataFrame], snapshots: DataFrame, *, hot: list[tuple] | None = None
) -> DataFrame:
    """Events without order columns; provider specialties are looked up before the fan-out."""
    hot = hot_patients(tables) if hot is None else hot
    med = tables["medical_claims"]
    med = _with_specialty(tables, med.withColumn("gone", reversal(med)), "provider_id").select(
        "patient_id", "claim_id", "claim_date", "available_date", "status", "gone",
        "diagnosis_code", "procedure_code", "hcp_id", "provider_specialty", "place_of_service",
    )
    med = _in_view(med, snapshots, "claim_date", hot).withColumn(
        "status", status_at("status", F.col("gone"), "index_date")
    )
    medical = (
        _by_code(med)
        .select(
            "snapshot_id",
            "patient_id",
            "index_date",
            F.concat("claim_id", F.lit("__"), F.col("c.kind")).alias("event_id"),
            F.col("claim_date").alias("event_date"),
            "available_date",
            F.concat(F.col("c.kind"), F.lit("_"), F.col("status")).alias("event_type"),
            F.col("c.kind").alias("code_system"),
            F.col("c.code").alias("code"),
            "hcp_id",
            F.lit("").alias("product_id"),
            F.lit("none").alias("therapy_class"),
            "provider_specialty",
            "status",
            "place_of_service",
        )
    )
    rx = tables["pharmacy_claims"]
    rx = (
        _with_specialty(tables, rx.withColumn("gone", reversal(rx)), "prescriber_id")
        .where(F.col("drug_id").isNotNull())
        .select(
            "patient_id", "claim_id", "fill_date", "available_date", "status", "gone",
            "drug_id", "therapy_class", "hcp_id", "provider_specialty",
        )
    )
    rx = _in_view(rx, snapshots, "fill_date", hot).withColumn(
        "status", status_at("status", F.col("gone"), "index_date")
    )
    pharmacy = rx.select(
        "snapshot_id",
        "patient_id",
        "index_date",
        F.concat("claim_id", F.lit("__pharmacy")).alias("event_id"),
        F.col("fill_date").alias("event_date"),
        "available_date",
        F.concat(F.lit("pharmacy_"), F.col("status")).alias("event_type"),
        F.lit("pharmacy").alias("code_system"),
        F.col("drug_id").cast("string").alias("code"),
        "hcp_id",
        F.col("drug_id").alias("product_id"),
        "therapy_class",
        "provider_specialty",
        "status",
        F.lit("pharmacy").alias("place_of_service"),
    )
    events = medical.unionByName(pharmacy)
    return events.withColumns(
        {
            "code_token": F.concat_ws("::", "code_system", "code"),
            "days_before_index": F.datediff("index_date", "event_date"),
        }
    )


def in_order(events: DataFrame, *, spread: bool) -> DataFrame:
    """Add the time since the previous event and the 0-based order inside a snapshot."""
    scanned = scan_in_order(
        events,
        [("event_date", True), ("event_id", True)],
        keys=("snapshot_id",),
        position="event_order",
        previous={"previous_date": "event_date"},
        spread=spread,
    )
    since = F.coalesce(F.datediff("event_date", "previous_date"), F.lit(0))
    return scanned.withColumns(
        {
            "time_since_previous_event": since,
            "event_order": (F.col("event_order") - 1).cast("int"),
        }
    ).drop("previous_date")


def build_events(
    tables: dict[str, DataFrame], snapshots: DataFrame, *, hot: list[tuple] | None = None
) -> DataFrame:
    """The 19-column event table of the given snapshots.

    Supplied prepared events are only restricted to the snapshots. A patient whose claims
    exceed one task switches the ordering to the spread scan.
    """
    if "prepared_events" in tables:
        keys = snapshots.select("snapshot_id").distinct()
        return tables["prepared_events"].join(keys, "snapshot_id", "left_semi")
    hot = hot_patients(tables) if hot is None else hot
    return in_order(raw_events(tables, snapshots, hot=hot), spread=bool(hot))


def normalize_events(events: DataFrame, *, spread: bool = True) -> DataFrame:
    """Order columns for events that already carry the index date of their snapshot."""
    ready = events.withColumns(
        {
            "code_token": F.concat_ws("::", "code_system", "code"),
            "days_before_index": F.datediff("index_date", "event_date"),
        }
    )
    return in_order(ready, spread=spread)
