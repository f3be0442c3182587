"""Helpers shared by the corpus operators: table access, scratch tables and text keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the word pattern that the contracts use.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch: very long texts do not meet in one, and Python workers stay small.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
#: Shuffle files go when a write to the scratch folder ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made for sessions without the setting, by application.
_LOCAL: dict[str, str] = {}
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. In a text of single bytes lower() does just that, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def words(c: Column) -> Column:
    """Array of the words of a text, lower-cased in A-Z; empty for null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(c), F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (spark.checkpoint.dir). Without the setting a local folder is made on a local master,
    as in tests; elsewhere that is an error, since executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir() or _LOCAL.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="scenetables-")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: a lost executor then costs a read, not the plan. The
    shuffle files of the write go when it ends, as the table stands for them."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df as it is, for Python to read: bounds the bytes of the session's Arrow batches, unless the session has a bound of its own."""
    key, value = _BATCH_BYTES
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, value)
    return df


def give_back() -> None:
    """Return memory that Python has freed to the system, where the C library can: after training, the process is small again."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_key(text: Column) -> Column:
    """64-bit key of a text, null apart from the empty text. Used with the row's id, never alone, so that a
    collision of two texts cannot mix up documents."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
