"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.llm.common import discard, materialize, small_batches

#: Links that a task contracts at a time; its memory does not depend on the table.
CHUNK = 200_000


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer edges: CHUNK links at a time become a star around the smallest node of each part."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        pairs = [(r, x) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        n = 0
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = parent.setdefault(a, a), parent.setdefault(b, b)
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                parent[max(x, y)] = min(x, y)
            n += batch.num_rows
            if n >= CHUNK:
                yield stars(parent)
                parent, n = {}, 0
        yield stars(parent)

    return small_batches(edges).mapInArrow(run, "a long, b long")


def _lowest(edges: DataFrame, key: str, value: Column) -> DataFrame:
    """The smallest value of each key, as a table of its own: joined back, a star's centre is then a key whose rows Spark can split."""
    return materialize(edges.groupBy(key).agg(value.alias("m")), "lowest")


def _star_round(edges: DataFrame) -> DataFrame:
    """A large-star step, in which larger neighbours are hung onto the smallest one, then a small-star step on what that gives."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both, "a", F.least(F.min("b"), F.col("a")))
    large = materialize(both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), "large")
    # here b is the larger end of every edge, and m its smallest neighbour
    least = _lowest(large, "b", F.min("a"))
    ends = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    out = ends.unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).filter("x <> y")
    new = materialize(out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    for table in (low, large, least):
        discard(table)
    return new


def _gathered(edges: DataFrame) -> DataFrame:
    """A table of links, read by one task for each CHUNK of them: their number follows the links, not the files that the links lie in."""
    return edges.coalesce(max(1, -(-edges.count() // CHUNK)))


def _is_forest(edges: DataFrame) -> bool:
    """Whether edges (a, b), a < b, are stars apart from each other: each node then has one root."""
    ends = edges.select(F.col("b").alias("node"), "a").unionByName(edges.select(F.col("a").alias("node"), "a"))
    return ends.groupBy("node").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo < hi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b), any order and direction -> (node, root): root is the smallest node reachable. Nodes without a
    link to another node are not returned; nulls are left out, and an empty table gives an empty result. Edges stay in tables from first to last; each step is written to the
    shared scratch folder, so the lineage is one step long. Tasks first contract the links they hold, then once more as gathered by CHUNK, which settles all that one
    task can hold; star rounds follow only while a node of what is left has more than one root, and their number grows with the logarithm of the longest chain."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    contracted = materialize(_contracted(edges), "contracted")
    rounds = 0
    while not _is_forest(held := _gathered(contracted)):
        edges = _star_round(contracted) if rounds else held
        spent, contracted = contracted, materialize(_contracted(edges), "contracted")
        for t in (spent, edges):
            discard(t)
        rounds += 1
    roots = contracted.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return roots.unionByName(contracted.select(F.col("b").alias("node"), F.col("a").alias("root")))
