"""Running values along tracks of any length.

A track is cut into blocks of frames. Windows run inside a block; what a block hands on (its last row, its last label, its parity) is a row of a
summary, a scan over the summaries of a track gives what each block starts from, and that is joined to the block's rows. A track of 10^8 frames so is some
1,500 window groups and one group of as many summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block() -> Column:
    return F.floor(F.col("frame") / BLOCK)


def _carried(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what their block starts from. A null key names a track like any other."""
    on = [*keys, "__block"]
    c = carry.withColumnsRenamed({k: f"__of_{k}" for k in on})
    return rows.join(c, [rows[k].eqNullSafe(c[f"__of_{k}"]) for k in on], "left").drop(*(f"__of_{k}" for k in on))


def with_neighbour(rows: DataFrame, keys: Sequence[str], values: Sequence[str], out: str, ahead: bool = True) -> DataFrame:
    """Adds `out`: a struct of the values of the track's next row by frame (of the one before, if not ahead), null where there is none."""
    b = rows.withColumn("__block", _block())
    here = F.struct(*values)
    w = Window.partitionBy(*keys, "__block").orderBy("frame")
    local = b.withColumn(out, (F.lead if ahead else F.lag)(here).over(w))
    ends = b.groupBy(*keys, "__block").agg((F.min_by if ahead else F.max_by)(here, "frame").alias("__end"))
    over = Window.partitionBy(*keys).orderBy("__block")
    carry = ends.select(*keys, "__block", (F.lead if ahead else F.lag)("__end").over(over).alias("__carry")).filter("__carry IS NOT NULL")
    return _carried(local, carry, keys).select(*rows.columns, F.coalesce(out, "__carry").alias(out))


def with_labels_around(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Adds prev and next: the nearest labels (null where a row has none) at or before and at or after each row of a track. Of rows at one frame, labels
    come first in either direction."""
    b = rows.withColumn("__block", _block())
    at = F.when(F.col(label).isNotNull(), F.col("frame"))
    ends = b.groupBy(*keys, "__block").agg(F.max_by(label, at).alias("hi"), F.min_by(label, at).alias("lo"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "__block", F.last("hi", True).over(before).alias("__before"), F.last("lo", True).over(after).alias("__after"))
    # what a block starts from is a row at its first or last frame, so that rows are shuffled once, before they have what is around them
    kind = rows.schema["frame"].dataType
    seed = lambda c, n, shift: carry.filter(F.col(c).isNotNull()).select(*keys, "__block", (F.col("__block") * BLOCK + shift).cast(kind).alias("frame"), F.col(c).alias(label), F.lit(n).alias("__kind"))
    b = b.withColumn("__kind", F.when(F.col(label).isNotNull(), 2).otherwise(3))
    b = b.unionByName(seed("__before", 0, 0), allowMissingColumns=True).unionByName(seed("__after", 1, BLOCK - 1), allowMissingColumns=True)

    def last(order: Column, other: int) -> Column:
        w = Window.partitionBy(*keys, "__block").orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
        return F.last(F.when(F.col("__kind") != other, F.col(label)), True).over(w)

    out = b.select("*", last(F.col("frame").asc(), 1).alias("prev"), last(F.col("frame").desc(), 0).alias("next"))
    return out.filter("__kind > 1").select(*rows.columns, "prev", "next")


def with_parity(rows: DataFrame, keys: Sequence[str], turn: Column, reset: Column, out: str) -> DataFrame:
    """Adds `out`: whether the number of turns up to each row of a track, since the last reset, is odd."""
    b = rows.withColumn("__block", _block()).withColumn("__turn", F.when(turn, 1).otherwise(0)).withColumn("__reset", F.when(reset, 1).otherwise(0))
    w = Window.partitionBy(*keys, "__block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("__run", F.sum("__reset").over(w))
    r = Window.partitionBy(*keys, "__block", "__run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("__turns", F.sum("__turn").over(r))
    ends = b.groupBy(*keys, "__block").agg(F.max("__run").alias("resets"), F.max_by("__turns", F.struct("frame", "__run")).alias("tail"))
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("since", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(over))
    total = F.sum("tail").over(Window.partitionBy(*keys, "since").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("total", total)
    carry = ends.select(*keys, "__block", F.lag("total").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carry")).filter("__carry IS NOT NULL")
    joined = _carried(b, carry, keys)
    turns = F.col("__turns") + F.when(F.col("__run") == 0, F.coalesce("__carry", F.lit(0))).otherwise(0)
    return joined.select(*rows.columns, (turns % 2 == 1).alias(out))
