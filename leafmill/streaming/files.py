"""Structured Streaming over a folder of files: the same extraction, file by file as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.model import Options
from leafmill.plans.extract import Registry, extract

FILES = "path string, modificationTime timestamp, length long, content binary"


def extract_stream(spark: SparkSession, path: str, options: Options = Options(), registry: Registry | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming table of documents. No state is kept between files; too large ones are left out before they are read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)
    small = files.where(F.col("length") <= options.input_bytes)
    return extract(small.withColumn("name", F.element_at(F.split("path", "/"), -1)), "path", "content", "name", options, registry)
