"""Claims-history predictors over a token vocabulary fitted on training events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LeakageError

REQUIRED = ("snapshot_id", "event_id", "event_date", "available_date", "event_type", "code_token")
# fixed value: gap and recency of a snapshot without such an event
NO_EVENT_DAYS = 366


def eligible_events(events: DataFrame, snapshots: DataFrame, *, check: bool = True) -> DataFrame:
    """Events of the given snapshots with their dates, days before index and history token."""
    missing = set(REQUIRED) - set(events.columns)
    if missing:
        raise ValueError(f"Missing history columns: {sorted(missing)}")
    dates = snapshots.select("snapshot_id", "index_date", "feature_cutoff", "lookback_start")
    own = [c for c in ("index_date", "feature_cutoff", "lookback_start") if c in events.columns]
    matched = events.drop(*own).join(dates, "snapshot_id")
    if check:
        timing = ("event_date", "available_date", "index_date", "feature_cutoff", "lookback_start")
        missing_time = reduce(Column.__or__, [F.col(c).isNull() for c in timing])
        outside = (
            (F.col("event_date") > F.col("feature_cutoff"))
            | (F.col("available_date") > F.col("index_date"))
            | (F.col("event_date") < F.col("lookback_start"))
        )
        found = matched.agg(
            F.count_if(missing_time).alias("missing"), F.count_if(outside).alias("outside")
        ).first()
        if dates.groupBy("snapshot_id").count().where("count > 1").limit(1).count():
            raise ValueError("Duplicate snapshot keys")
        if found["missing"]:
            raise LeakageError("Missing history timing")
        if found["outside"]:
            raise LeakageError("History contains an unavailable or out-of-window event")
    return matched.withColumns(
        {
            "days_before_index": F.datediff("index_date", "event_date"),
            "history_token": F.concat_ws("::", "event_type", "code_token"),
        }
    )


def token_counts(eligible: DataFrame) -> DataFrame:
    return eligible.groupBy("history_token").agg(F.count("*").alias("events"))


@dataclass
class HistoryEncoder:
    """Fixed vocabulary of the most frequent tokens; never reads outcomes."""

    max_codes: int = 24
    windows: tuple[int, ...] = (14, 30, 90, 365)
    vocabulary: tuple[str, ...] | None = None

    def fit(self, events: DataFrame, snapshots: DataFrame, *, check: bool = True):
        top = (
            token_counts(eligible_events(events, snapshots, check=check))
            .orderBy(F.desc("events"), F.asc("history_token"))
            .limit(self.max_codes)
        )
        self.vocabulary = tuple(r["history_token"] for r in top.collect())
        return self

    def names(self) -> list[str]:
        out = []
        for i in range(len(self.vocabulary)):
            out += [f"history_code_{i}_count_{w}d" for w in self.windows]
            out.append(f"history_code_{i}_recency")
        for w in self.windows:
            out += [f"history_visit_dates_{w}d", f"history_code_diversity_{w}d"]
        return out + [f"history_visit_gap_{k}" for k in ("mean", "std", "last")]

    def transform(
        self, events: DataFrame, snapshots: DataFrame, *, check: bool = True
    ) -> DataFrame:
        """One row of doubles per snapshot.

        Three small grains carry everything: (snapshot, token, age band) for counts,
        (snapshot, token) for diversity and (snapshot, day) for visits and gaps. A snapshot
        has at most one row per day of its window in the only ordered step.
        """
        data = eligible_events(events, snapshots, check=check)
        edges = sorted(self.windows)
        band = reduce(
            lambda rest, e: F.when(F.col("days_before_index") <= e, e).otherwise(rest),
            reversed(edges),
            F.lit(edges[-1] + 1),
        )
        banded = data.groupBy("snapshot_id", "history_token", band.alias("band")).agg(
            F.count("*").alias("n"), F.min("days_before_index").alias("nearest")
        )

        def upto(w: int, token: str) -> Column:
            hit = (F.col("history_token") == token) & (F.col("band") <= w)
            return F.log1p(F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("double"))

        coded: dict[str, Column] = {}
        for i, token in enumerate(self.vocabulary):
            for w in self.windows:
                coded[f"history_code_{i}_count_{w}d"] = upto(w, token)
            nearest = F.min(F.when(F.col("history_token") == token, F.col("nearest")))
            coded[f"history_code_{i}_recency"] = F.coalesce(
                nearest, F.lit(NO_EVENT_DAYS)
            ).cast("double")
        frames = []
        if coded:
            kept = banded.where(F.col("history_token").isin(list(self.vocabulary)))
            frames.append(kept.groupBy("snapshot_id").agg(*[e.alias(n) for n, e in coded.items()]))
        tokens = banded.groupBy("snapshot_id", "history_token").agg(
            F.min("nearest").alias("nearest")
        )
        frames.append(
            tokens.groupBy("snapshot_id").agg(
                *[
                    F.count_if(F.col("nearest") <= w)
                    .cast("double")
                    .alias(f"history_code_diversity_{w}d")
                    for w in self.windows
                ]
            )
        )
        days = data.groupBy("snapshot_id", "event_date").agg(
            F.min("days_before_index").alias("days")
        )
        order = Window.partitionBy("snapshot_id").orderBy("event_date")
        gaps = days.withColumn(
            "gap", F.datediff("event_date", F.lag("event_date").over(order))
        )
        frames.append(
            gaps.groupBy("snapshot_id").agg(
                *[
                    F.log1p(F.count_if(F.col("days") <= w).cast("double")).alias(
                        f"history_visit_dates_{w}d"
                    )
                    for w in self.windows
                ],
                F.coalesce(F.avg("gap"), F.lit(float(NO_EVENT_DAYS))).alias(
                    "history_visit_gap_mean"
                ),
                F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("history_visit_gap_std"),
                F.coalesce(F.max_by("gap", "event_date"), F.lit(NO_EVENT_DAYS))
                .cast("double")
                .alias("history_visit_gap_last"),
            )
        )
        out = snapshots.select("snapshot_id")
        for frame in frames:
            out = out.join(frame, "snapshot_id", "left")
        empty = {
            n: float(NO_EVENT_DAYS)
            if n.endswith(("_recency", "_gap_mean", "_gap_last"))
            else 0.0
            for n in self.names()
        }
        return out.select(
            "snapshot_id", *[F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in empty.items()]
        )
