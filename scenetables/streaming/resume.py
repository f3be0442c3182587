"""Folders that grow: each run takes the files that have come since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, format: str = "parquet") -> None:
    """Runs transform over the new files of source and appends its rows to target, once. The checkpoint knows which files
    are done; it lies in a folder that all executors share, like the target."""
    stream = spark.readStream.schema(schema).format(format).load(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
    query.awaitTermination()
