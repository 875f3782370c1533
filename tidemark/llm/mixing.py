"""Poisson replication: mixing sources to target weights with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup
from tidemark.operators.stage import freeze

from .blocks import id_text
from .sharding import stratum

#: Target weight of a source: its share of rows to this power, scaled to one.
TEMPERATURE = 0.7


ADDED = ["rate", "n_copies", "copy", "shuffle_key"]


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of a Poisson count, up to where doubles end (rate + 12 sigma).

    Terms are summed through logarithms, so large rates do not underflow. Bounded by the rate,
    and computed once per source.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.lit(0.0).alias("sum"), F.expr("cast(array() as array<double>)").alias("steps"))

    def add(state: Column, k: Column) -> Column:
        log = F.when(k == 0, -rate).otherwise(state["log"] + F.ln(rate / k))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["steps"], F.array(total)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(0), last), start, add, lambda state: state["steps"])


def uniform(seed: str, doc_id: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a seeded digest of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text(f"`{doc_id}`"))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame, source: str, weights: DataFrame | None, rows: int | None, temperature: float
) -> DataFrame:
    """(stratum, rate): the mean number of copies of a document of the source.

    ``weights`` may name ``source`` and ``weight`` (relative; a source it leaves out gets none);
    otherwise weights are row shares to the power ``temperature``. ``rows`` is the expected size
    of the result, by default that of the input.
    """
    counts = freeze(docs.groupBy(stratum(source).alias("stratum")).agg(F.count("*").alias("n")))
    if weights is None:
        named = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(stratum("source").alias("stratum"), F.col("weight").cast("double"))
        named = counts.join(given, "stratum", "left").fillna(0.0, ["weight"])
    total = named.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"))
    size = total.select(F.lit(rows).cast("double") if rows is not None else F.col("rows").cast("double"))
    scaled = F.col("weight") / total.select("weights").scalar() * size.scalar() / F.col("n")
    return named.select("stratum", scaled.alias("rate"))


def replicated(
    docs: DataFrame,
    *,
    weights: DataFrame | None = None,
    rows: int | None = None,
    temperature: float = TEMPERATURE,
    seed: str = "mixture",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``docs`` repeated to the target mixture and shuffled, with rate, n_copies and copy.

    A document's count inverts the Poisson distribution with its source's mean rate at a
    seeded digest of its id, so it may be zero, and equal ids of a source have equal counts.
    Each copy is a row; rows are hash-partitioned and sorted by a digest of id and copy, which
    is the global shuffle (column ``shuffle_key``). Null sources are one source, null ids read
    as empty, an empty table gives an empty result; columns that bear one of the four names are
    replaced. Only the table of sources is joined: broadcast where its count allows, so the
    texts are shuffled once, for the order.
    """
    added = ADDED
    kept = [c for c in docs.columns if c not in added]
    steps = freeze(
        source_rates(docs, source, weights, rows, temperature)
        .withColumn("steps", poisson_steps(F.col("rate")))
        .withColumnRenamed("stratum", "_stratum")
    )
    known = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("_stratum", stratum(source))
    counted = (
        lookup(known, steps, "_stratum")
        .withColumn("_u", uniform(seed, doc_id))
        .withColumn("n_copies", F.size(F.filter("steps", lambda p: p <= F.col("_u"))))
        .where("n_copies > 0 and rate > 0")
    )
    copies = counted.withColumn("copy", F.explode(F.expr("sequence(1, n_copies)")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_text(f"`{doc_id}`"), F.lit(":"), F.col("copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        copies.withColumn("shuffle_key", key)
        .select(*kept, *added)
        .repartition(parts, "shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )
