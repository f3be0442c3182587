"""Numbers of rows of any group, by all tasks."""

import pytest
from pyspark.sql import functions as F

from scenetables.operators import ranks
from scenetables.plans import manifest


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_in_groups(spark, partitions):
    """A hot group, a null group, ties, and names of the function's own columns without its marks."""
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("g"), (F.col("id") * 7919 % 5000).alias("n"), F.col("id").alias("part"))
    got = ranks.numbered(rows.repartition(9), ["n", "part"], ["g"], "k", partitions)
    assert got.columns == ["g", "n", "part", "k"]
    by = {}
    for r in got.collect():
        by.setdefault(r.g, []).append((r.n, r.part, r.k))
    assert set(by) == {"hot", "b", None}
    for v in by.values():
        assert [k for _, _, k in sorted(v)] == list(range(len(v)))
    same = ranks.numbered(spark.range(100).select(F.lit(1).alias("x")), ["x"], partitions=partitions)
    assert sorted(r.n for r in same.collect()) == list(range(100))
    assert ranks.numbered(rows.limit(0), ["n"], ["g"]).collect() == []


def test_a_large_group_is_spread(spark):
    """The rows of one group come from all partitions, in ranges of their order."""
    rows = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 20_000).alias("n"))
    got = ranks.numbered(rows, ["n"], ["g"], "k", 8)
    parts = got.filter("k = n").groupBy(F.floor(F.col("k") / 2500)).count().collect()
    assert len(parts) == 8 and sum(r["count"] for r in parts) == 20_000
    windows = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in x and "__row" in x]
    assert not windows  # no window over the rows themselves


def test_batches_are_dense(spark):
    b = manifest.batch_ids(spark.range(1003).select(F.lit("s").alias("source"), "id"), "id", 25, ["source"])
    assert sorted((r.batch, r["count"]) for r in b.groupBy("batch").count().collect()) == [(k, 25 if k < 40 else 3) for k in range(41)]
