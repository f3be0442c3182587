"""Tables and folders that jobs need for a while, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. On a local master that has not set it, a local folder; elsewhere that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    top = top or spark.sparkContext.getCheckpointDir() or _LOCAL.get(spark.sparkContext.applicationId)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="scenetables-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: what its tasks have numbered stays as it is, whatever is computed again later."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
