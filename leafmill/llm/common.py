"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from leafmill.batches import bounded_batches

#: The six characters that part words in `[^\x20\x09-\x0D]+`; bytes.split() parts at just these.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so a lost executor loses nothing of it.

    The folder is the session's spark.checkpoint.dir. Only a local master may go without: a folder of this machine is
    made for it. Files are removed with their tables where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafmill-checkpoint-"))
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds: texts can be long, so batches have few rows, and few bytes."""
    bounded_batches(spark)
