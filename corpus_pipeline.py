"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns
of documents; the last adds what the mixture takes. run() writes each stage's result and reads it back.

In every stage a null text counts as an empty one, a null id is an id of its own, repeated rows are rows of their own (near_dedup keeps one of them), an empty table gives an empty
result, and very long texts are read whole. Names that begin with two underscores are reserved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm import decontamination, mixing, secret_scan, shingle_dedup, simhash_dedup, toxicity
from scenetables.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The network learns from the labelled rows of the whole table; without labels of both kinds it rejects nothing, or all
    that the one kind says. A column `__toxicity` of docs is an error."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, net, out="__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarities of 0.8 or more, that of the smallest id; texts without words are one group. Candidates come from the
    SimHash range join of op1; its radius misses most pairs near 0.8, for which an exact prefix filter follows."""
    return simhash_dedup.keep_one(docs, find=shingle_dedup.near_duplicates)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; all of them where the benchmark is empty."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with size, source_size, target and taken."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
