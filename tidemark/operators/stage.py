"""Freezing an intermediate result in reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names.

    Where none is named, a local session gets a private folder; on a cluster that is an error,
    since executors could not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and is never computed twice.

    Needed wherever a later step must see *the same* partition numbers again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet below the shared folder, and read from there.

    For a table that several plans read by different columns: each reads only its own, and
    the joins behind it run once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
