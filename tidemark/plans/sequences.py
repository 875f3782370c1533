"""Token vocabularies and right-padded event sequences as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import scan_in_order
from ..operators.skew import lookup
from ..params import SequenceRules
from ..schema import LeakageError
from .cohort import by_patient
from .events import LANDMARKS

# fixed values: reserved tokens and ids, vocabulary keys and their event columns
PAD, UNKNOWN = "<PAD>", "<UNK>"
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
VOCABULARIES = {
    "event_type": "event_type",
    "code": "code_token",
    "therapy_class": "therapy_class",
    "specialty": "provider_specialty",
}
# fixed value: column of the event type that a reversed claim takes
LATE = "late_type"


def _token(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("unknown"))


def fit_vocabularies(events: DataFrame, min_frequency: int = 1) -> DataFrame:
    """Rows ``(vocab_key, token, id)``: tokens in string order from 2, plus the reserved two.

    ``events`` are event rows, or the rows of ``event_claims``, which count once a snapshot.
    """
    cells = [(k, c, F.lit(1)) for k, c in VOCABULARIES.items()]
    if "late_views" in events.columns:
        late, views = F.col("late_views"), F.col("views")
        seen = {c: views - late if k == "event_type" else views for k, c in VOCABULARIES.items()}
        cells = [(k, c, seen[c]) for k, c in VOCABULARIES.items()] + [("event_type", LATE, late)]
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("vocab_key"), _token(c).alias("token"), n.alias("n"))
            for k, c, n in cells
        ]
    )
    counted = (
        events.select(F.explode(pairs).alias("p"))
        .where("p.n > 0")
        .groupBy("p.vocab_key", "p.token")
        .agg(F.sum("p.n").alias("n"))
        .where((F.col("n") >= min_frequency) & ~F.col("token").isin(PAD, UNKNOWN))
        .select("vocab_key", "token")
    )
    numbered = scan_in_order(counted, [("token", True)], keys=("vocab_key",), position="id")
    fitted = numbered.select(
        "vocab_key", "token", (F.col("id") + (FIRST_ID - 1)).cast("int").alias("id")
    )
    reserved = events.sparkSession.createDataFrame(
        [(k, t, i) for k in VOCABULARIES for t, i in ((PAD, PAD_ID), (UNKNOWN, UNKNOWN_ID))],
        "vocab_key string, token string, id int",
    )
    return reserved.unionByName(fitted)


def vocabulary_problems(vocabularies: DataFrame) -> DataFrame:
    """Vocabularies whose ids are not contiguous from PAD=0, UNK=1."""
    return (
        vocabularies.groupBy("vocab_key")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("id").alias("ids"),
            F.min("id").alias("low"),
            F.max("id").alias("high"),
            F.count_if((F.col("token") == PAD) & (F.col("id") == PAD_ID)).alias("pads"),
            F.count_if((F.col("token") == UNKNOWN) & (F.col("id") == UNKNOWN_ID)).alias("unks"),
        )
        .where("low <> 0 or high <> n - 1 or ids <> n or pads <> 1 or unks <> 1")
    )


def sequence_tail(
    events: DataFrame, max_length: int, keys: tuple[str, ...] = ("snapshot_id",)
) -> DataFrame:
    """The last events of each snapshot with deltas counted inside the tail.

    The rank bound lets Spark keep at most ``max_length`` rows per snapshot in every map
    task before the shuffle, so a hot snapshot never reaches one task whole. Events that lie
    by patient already stay where they are if ``keys`` name the patient too.
    """
    latest = Window.partitionBy(*keys).orderBy(
        F.col("event_date").desc(), F.col("event_id").desc()
    )
    order = Window.partitionBy(*keys).orderBy("event_date", "event_id")
    tail = events.withColumn("_back", F.row_number().over(latest)).where(
        F.col("_back") <= max_length
    )
    return tail.withColumns(
        {
            "time_since_previous_event": F.coalesce(
                F.datediff("event_date", F.lag("event_date").over(order)), F.lit(0)
            ),
            "position": (F.row_number().over(order) - 1).cast("int"),
        }
    ).drop("_back")


def _with_id(rows: DataFrame, vocabularies: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """The id of a column's token, ``UNKNOWN_ID`` outside the vocabulary."""
    ids = vocabularies.where(F.col("vocab_key") == key).select(
        F.col("token").alias("_token"), F.col("id").alias(name)
    )
    found = lookup(rows.withColumn("_token", _token(column)), ids, "_token").drop("_token")
    return found.withColumn(name, F.coalesce(name, F.lit(UNKNOWN_ID)))


def _step() -> Column:
    return F.struct(
        "position",
        *[f"{k}_id" for k in VOCABULARIES],
        F.col("time_since_previous_event").cast("float").alias("delta"),
        F.col("days_before_index").cast("float").alias("recency"),
        "event_date",
        "available_date",
    )


def _labels(snapshots: DataFrame) -> list[str]:
    return [c for c in ("label",) if c in snapshots.columns]


def _padded(rows: DataFrame, size: int, labels: list[str]) -> DataFrame:
    """Padded array columns from the ordered ``steps`` of each snapshot."""
    rows = rows.withColumn("length", F.size("steps"))

    def padded(name: str, fill: Column) -> Column:
        kept = F.transform("steps", lambda s: s[name])
        return F.concat(kept, F.array_repeat(fill, F.lit(size) - F.col("length")))

    no_day = F.lit(None).cast("date")
    return rows.select(
        "snapshot_id",
        "patient_id",
        "index_date",
        *labels,
        *[padded(f"{k}_id", F.lit(PAD_ID)).alias(f"{k}_ids") for k in VOCABULARIES],
        padded("delta", F.lit(0.0).cast("float")).alias("time_delta_days"),
        padded("recency", F.lit(0.0).cast("float")).alias("days_before_index"),
        padded("event_date", no_day).alias("event_dates"),
        padded("available_date", no_day).alias("available_dates"),
        F.concat(
            F.array_repeat(F.lit(True), F.col("length")),
            F.array_repeat(F.lit(False), F.lit(size) - F.col("length")),
        ).alias("attention_mask"),
        "length",
    )


def encode_sequences(
    events: DataFrame, snapshots: DataFrame, vocabularies: DataFrame, rules: SequenceRules
) -> DataFrame:
    """One row per snapshot: token ids, times, dates and mask padded to ``max_length``."""
    tail = sequence_tail(events, rules.max_length)
    for key, column in VOCABULARIES.items():
        tail = _with_id(tail, vocabularies, key, column, f"{key}_id")
    gathered = tail.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(_step())).alias("steps"))
    labels = _labels(snapshots)
    rows = snapshots.select("snapshot_id", "patient_id", "index_date", *labels).join(
        gathered, "snapshot_id", "left"
    )
    steps = F.coalesce("steps", F.array().cast(gathered.schema["steps"].dataType))
    return _padded(rows.withColumn("steps", steps), rules.max_length, labels)


#: Snapshots whose events one task puts in order.
SNAPSHOTS_PER_TASK = 50_000


def encode_claims(
    claims: DataFrame, snapshots: DataFrame, vocabularies: DataFrame, rules: SequenceRules
) -> DataFrame:
    """``encode_sequences`` from the rows of ``event_claims``, for patients whose claims fit a task.

    Tokens become ids before the fan-out. The claims meet the snapshots once, by patient; ranks and
    arrays keep that partitioning, so no event is shuffled.
    """
    index, gone = F.col("index_date"), F.col("gone")
    coded = claims
    for key, column in VOCABULARIES.items():
        coded = _with_id(coded, vocabularies, key, column, f"{key}_id").drop(column)
    coded = _with_id(coded, vocabularies, "event_type", LATE, "late_id").select(
        F.col("patient_id").alias("owner"), "event_id", "event_date", "available_date", "gone",
        "late_id", *[f"{k}_id" for k in VOCABULARIES],
    )
    inside = (
        (F.col("event_date") <= F.col("feature_cutoff"))
        & (F.col("event_date") >= F.col("lookback_start"))
        & (F.col("available_date") <= index)
    )
    labels = _labels(snapshots)
    marks = by_patient(snapshots.select(*LANDMARKS, *labels), SNAPSHOTS_PER_TASK)
    # Every snapshot stays, also without an event.
    events = marks.join(coded, (F.col("patient_id") == F.col("owner")) & inside, "left").withColumns(
        {
            "event_type_id": F.when(gone <= index, F.col("late_id")).otherwise(F.col("event_type_id")),
            "days_before_index": F.datediff("index_date", "event_date"),
        }
    )
    tail = sequence_tail(events, rules.max_length, ("patient_id", "snapshot_id"))
    step = F.when(F.col("event_id").isNotNull(), _step())
    rows = tail.groupBy("patient_id", "snapshot_id", "index_date", *labels).agg(
        F.array_sort(F.collect_list(step)).alias("steps")
    )
    return _padded(rows, rules.max_length, labels)


CHANNELS = tuple(f"{k}_ids" for k in VOCABULARIES) + ("days_before_index",)


def sequence_split(encoded: DataFrame) -> DataFrame:
    """The five model channels zipped per event: ``values[event][channel]`` as floats."""
    floats = [F.transform(c, lambda x: x.cast("float")).alias(c) for c in CHANNELS]
    return encoded.withColumn(
        "values",
        F.transform(
            F.arrays_zip(*floats), lambda s: F.array(*[s[c] for c in CHANNELS])
        ),
    )


def sequence_violations(
    encoded: DataFrame, vocabulary_sizes: dict[str, int], max_length: int
) -> DataFrame:
    """Counts per rule over padded sequences, as rows ``(rule, violations)``."""
    mask, index = F.col("attention_mask"), F.col("index_date")
    real = lambda c: F.slice(F.col(c), 1, F.col("length"))
    width = [F.size(c) != max_length for c in (*CHANNELS, "time_delta_days", "event_dates")]
    wrong_size = width[0]
    for other in width[1:]:
        wrong_size = wrong_size | other
    holes = F.exists(
        F.zip_with(
            F.slice(mask, 1, max_length - 1) if max_length > 1 else F.array(F.lit(True)),
            F.slice(mask, 2, max_length - 1) if max_length > 1 else F.array(F.lit(True)),
            lambda a, b: ~a & b,
        ),
        lambda x: x,
    )

    def outside(key: str, size: int) -> Column:
        return F.exists(real(f"{key}_ids"), lambda i: (i < 0) | (i >= size))

    bad_token = F.lit(False)
    for key, size in vocabulary_sizes.items():
        bad_token = bad_token | outside(key, size)
    dates = real("event_dates")
    unordered = F.exists(
        F.zip_with(
            F.slice(dates, 1, F.greatest(F.lit(0), F.col("length") - 1)),
            F.slice(dates, 2, F.greatest(F.lit(0), F.col("length") - 1)),
            lambda a, b: b < a,
        ),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    rules = {
        "wrong_size": wrong_size,
        "not_right_padded": holes,
        "token_out_of_range": bad_token,
        "negative_time": F.exists(real("time_delta_days"), lambda x: x < 0),
        "missing_index_date": index.isNull(),
        "missing_event_date": F.exists(dates, lambda d: d.isNull()),
        "post_index_event": F.exists(dates, lambda d: F.coalesce(d > index, F.lit(False))),
        "unavailable_event": F.exists(
            real("available_dates"), lambda d: d.isNull() | (d > index)
        ),
        "not_chronological": unordered,
    }
    counted = encoded.agg(
        *[F.count_if(F.coalesce(e, F.lit(False))).alias(n) for n, e in rules.items()]
    )
    return counted.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations"))
                    for n in rules
                ]
            )
        ).alias("v")
    ).select("v.*")


def require_clean_sequences(violations: DataFrame) -> None:
    bad = {r["rule"]: r["violations"] for r in violations.where("violations > 0").collect()}
    if bad:
        raise LeakageError(f"Invalid sequences: {bad}")
