"""Ingest of document folders as a stream that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_at_once: int = 100, fmt: str = "parquet") -> StreamingQuery:
    """Take what is new in ``folder`` through ``transform`` (row by row, no aggregate) to Parquet, and stop.

    The checkpoint remembers the files that are done, so a later run takes only new ones, and a
    failed batch is written once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(fmt).load(folder)
    made = transform(rows) if transform else rows
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
