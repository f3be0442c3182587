"""Row numbers without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetables.sources import scratch

#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), out: str = "n", partitions: int | None = None) -> DataFrame:
    """Adds `out`: 0, 1, ... by `order` within each group, or over all rows.

    Rows are dealt to partitions by ranges of group and order and sorted there; a partition numbers what it holds, and a group's number starts after the rows that earlier
    partitions hold of it. Those counts, one row for each partition and group in it, are summed by a window; so a group of any size is spread over
    all tasks. Rows that are equal in `order` get numbers in any order; where nearly all are, name more columns. The rows are written to the scratch folder with their places."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order]
    sorted_rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    mark = F.monotonically_increasing_id()
    placed = sorted_rows.withColumns({"__part": F.spark_partition_id(), "__row": mark.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    placed = scratch.stored(placed, "numbered")
    names = [f"__g{i}" for i in range(len(group))]
    counts = placed.groupBy(*(F.col(g).alias(x) for g, x in zip(group, names)), F.col("__part").alias("__p")).agg(F.count("*").alias("__count"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    same = F.col("__part") == F.col("__p")
    for g, x in zip(group, names):
        same = same & F.col(g).eqNullSafe(F.col(x))  # rows of a null group are a group of their own
    return placed.join(counts, same).select(*rows.columns, (F.col("__row") - F.col("__first") + F.col("__before")).cast("long").alias(out))
