"""How much a Python worker is handed at once, the same for all operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch: texts and files can be large, so batches have few of them.
ROWS, BYTES = "500", "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bounds. They are the same wherever they are set, so the order of calls does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
