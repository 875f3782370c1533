"""Patient-disjoint partitions: temporal with label-maturity purging, and stratified."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.leakage import forbidden_names
from ..operators.ordered import scan_in_order
from ..operators.quality import union_all, unpivot
from ..operators.stage import freeze
from ..params import SplitRules

SPLITS = ("train", "validation", "test")


def cut_date(first_dates: DataFrame, fraction: float) -> date:
    """The first index date at position ``int((n - 1) * fraction)`` of the sorted patients.

    Works on counts per date, so the ordered step sees one row per calendar day.
    """
    per_day = first_dates.groupBy("first_index").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("first_index")
    running = per_day.withColumn(
        "upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    total = first_dates.count()
    if not total:
        raise ValueError("No patient to split")
    position = int((total - 1) * fraction)
    return running.where(F.col("upto") > position).agg(F.min("first_index")).first()[0]


def _first_index(data: DataFrame) -> DataFrame:
    return data.groupBy("patient_id").agg(F.min("index_date").alias("first_index"))


def temporal_cuts(data: DataFrame, rules: SplitRules) -> tuple[date, date]:
    train_end, validation_end = rules.train_end, rules.validation_end
    if train_end is None or validation_end is None:
        firsts = _first_index(data)
        train_end = train_end or cut_date(firsts, rules.train_fraction)
        validation_end = validation_end or cut_date(
            firsts, rules.train_fraction + rules.validation_fraction
        )
    if validation_end <= train_end:
        raise ValueError("The training period must end before the validation period does")
    return train_end, validation_end


def temporal_split(
    data: DataFrame, rules: SplitRules, cuts: tuple[date, date] | None = None
) -> DataFrame:
    """Data with a ``split`` column; rows that fail maturity or gap are null ("purged").

    A patient belongs to the partition of the first index date. Training rows must be
    mature at the training cut, validation rows start after it and are mature at the
    validation cut, test rows start after that.
    """
    unkeyed = F.col("patient_id").isNull() | F.col("index_date").isNull()
    found = data.agg(F.count("*").alias("rows"), F.count_if(unkeyed).alias("unkeyed")).first()
    if not found["rows"] or found["unkeyed"]:
        raise ValueError("A temporal split needs rows, each with a patient and an index date")
    train_end, validation_end = cuts or temporal_cuts(data, rules)
    first, index, ready = (
        F.col("first_index"), F.col("index_date"), F.col("label_available_date"),
    )
    train, validation = F.lit(train_end), F.lit(validation_end)
    after: Column = F.date_add(train, rules.gap_days)
    later: Column = F.date_add(validation, rules.gap_days)
    split = (
        F.when(first <= train, F.when(ready <= train, "train"))
        .when(
            first <= validation,
            F.when((index > after) & (ready <= validation), "validation"),
        )
        .otherwise(F.when(index > later, "test"))
    )
    return data.join(_first_index(data), "patient_id").withColumn("split", split).drop(
        "first_index"
    )


def _require_parts(sizes: DataFrame, rules: SplitRules) -> None:
    """Every partition gets a patient of some stratum (one row per stratum is read)."""
    ends = [rules.train_fraction, rules.train_fraction + rules.validation_fraction]
    shares = [0, 0, 0]
    for row in sizes.collect():
        a, b = (int(row["size"] * e) for e in ends)
        shares = [x + y for x, y in zip(shares, (a, b - a, row["size"] - b), strict=True)]
    if min(shares) <= 0:
        raise ValueError("Too few patients: a partition of the stratified split is empty")


def stratified_split(data: DataFrame, rules: SplitRules) -> DataFrame:
    """Patients shuffled by a seeded digest inside each outcome stratum, then cut by share.

    A patient's stratum is its largest label. The two strata are ordered with the spread
    scan since each may hold most patients.
    """
    patients = data.groupBy("patient_id").agg(F.max("label").alias("stratum"))
    digest = F.md5(F.concat_ws("|", F.lit(str(rules.seed)), "patient_id"))
    placed = scan_in_order(
        patients.withColumn("digest", digest),
        [("digest", True), ("patient_id", True)],
        keys=("stratum",),
        position="place",
    )
    sizes = freeze(patients.groupBy("stratum").agg(F.count("*").alias("size")))
    _require_parts(sizes, rules)
    a = F.floor(F.col("size") * F.lit(rules.train_fraction))
    b = F.floor(F.col("size") * F.lit(rules.train_fraction + rules.validation_fraction))
    split = (
        F.when(F.col("place") <= a, "train")
        .when(F.col("place") <= b, "validation")
        .otherwise("test")
    )
    assigned = placed.join(F.broadcast(sizes), "stratum").select(
        "patient_id", split.alias("split")
    )
    return data.join(assigned, "patient_id")


def split_manifest(split: DataFrame) -> DataFrame:
    """Every snapshot with its partition, or why it was purged."""
    kept = F.col("split").isNotNull()
    return split.select(
        "snapshot_id",
        "patient_id",
        "index_date",
        "label_available_date",
        "label",
        F.coalesce("split", F.lit("purged")).alias("split"),
        F.when(kept, "retained")
        .otherwise("patient assignment, temporal gap or label maturity")
        .alias("reason"),
    )


def split_counts(split: DataFrame) -> DataFrame:
    return (
        split.where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(
            F.count_distinct("patient_id").alias("patients"),
            F.count("*").alias("snapshots"),
            F.sum("label").alias("positive_snapshots"),
        )
    )


def shared_patients(split: DataFrame) -> DataFrame:
    """Patients that appear in more than one partition."""
    return (
        split.where(F.col("split").isNotNull())
        .groupBy("patient_id")
        .agg(F.count_distinct("split").alias("splits"))
        .where("splits > 1")
    )


def check_split(split: DataFrame, *, temporal: bool = True) -> None:
    """Disjoint patients, no empty partition, labels mature before the next partition starts."""
    if shared_patients(split).limit(1).count():
        raise AssertionError("A patient is in more than one part")
    found = {
        r["split"]: r
        for r in split.where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(
            F.max("label_available_date").alias("ready"),
            F.min("index_date").alias("start"),
        )
        .collect()
    }
    if set(found) != set(SPLITS):
        raise ValueError("A part is empty once immature snapshots are left out")
    if temporal:
        for earlier, later in (("train", "validation"), ("validation", "test")):
            if found[earlier]["ready"] >= found[later]["start"]:
                raise AssertionError(f"Labels of {earlier} come after the first index date of {later}")


def _shape(df: DataFrame, features: tuple[str, ...]) -> list[tuple[str, str]]:
    types = dict(df.dtypes)
    return [(f, types.get(f, "absent")) for f in features]


def tabular_split_violations(
    parts: dict[str, tuple[DataFrame, tuple[str, ...]]], label: str = "label"
) -> DataFrame:
    """Rules on tabular parts, as rows ``(table, rule, violations)``, one aggregate per part.

    Each part comes with its list of predictors. The names, their order and types are those of
    the first part, no predictor is named after an outcome, no part is empty, and every row
    has a binary label.
    """
    spark = next(iter(parts.values()))[0].sparkSession
    expected = _shape(*next(iter(parts.values())))
    out = []
    for name, (df, listed) in parts.items():
        found = _shape(df, listed)
        fixed = [
            ("feature_names_or_order", int([f for f, _ in found] != [f for f, _ in expected])),
            ("feature_types", len({x for x in found if x[0] in dict(expected)} - set(expected))),
            ("forbidden_features", len(forbidden_names(list(listed)))),
        ]
        rows = [(name, rule, n) for rule, n in fixed]
        out.append(spark.createDataFrame(rows, "table string, rule string, violations bigint"))
        y = F.col(label)
        row = df.agg(
            F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"),
            F.count_if(y.isNull() | ~y.isin(0, 1)).alias("label_not_binary"),
        )
        out.append(unpivot(row, name, ["empty", "label_not_binary"]))
    return union_all(out)


def sequence_shapes(parts: dict[str, DataFrame], targets: dict[str, DataFrame]) -> DataFrame:
    """(part, rows, least and most events and channels, rows without target, targets without row).

    One aggregate per part over its ``values``; targets meet it by snapshot.
    """
    out = []
    for name, df in parts.items():
        known = targets[name].select("snapshot_id", F.lit(True).alias("_target"))
        events = F.size("values")
        channels = F.transform("values", F.size)
        shapes = df.select("snapshot_id", events.alias("events"), F.array_min(channels).alias("low"),
                           F.array_max(channels).alias("high"), F.lit(True).alias("_row"))
        out.append(
            shapes.join(known, "snapshot_id", "full").agg(
                F.lit(name).alias("part"),
                F.count("_row").alias("rows"),
                F.min("events").alias("least_events"),
                F.max("events").alias("most_events"),
                F.min("low").alias("least_channels"),
                F.max("high").alias("most_channels"),
                F.count_if(F.col("_target").isNull()).alias("rows_without_target"),
                F.count_if(F.col("_row").isNull()).alias("targets_without_row"),
            )
        )
    return union_all(out)


def sequence_split_violations(shapes: DataFrame) -> DataFrame:
    """Rules on sequence parts: none is empty, all have one length and one number of channels,
    and rows and targets are the same snapshots. ``shapes`` has one row per part."""
    one = F.first(F.struct("most_events", "most_channels")).over(Window.orderBy("part"))
    first = shapes.withColumn("_first", one)
    differs = lambda low, high: ~(
        F.col(low).eqNullSafe(F.col(f"_first.{high}")) & F.col(high).eqNullSafe(F.col(f"_first.{high}"))
    )
    rules = {
        "empty": (F.col("rows") == 0).cast("int"),
        "length_differs": differs("least_events", "most_events").cast("int"),
        "channels_differ": differs("least_channels", "most_channels").cast("int"),
        "rows_without_target": F.col("rows_without_target"),
        "targets_without_row": F.col("targets_without_row"),
    }
    cells = [F.struct(F.lit(n).alias("rule"), c.cast("bigint").alias("violations")) for n, c in rules.items()]
    return first.select(F.col("part").alias("table"), F.explode(F.array(*cells)).alias("v")).select("table", "v.*")
