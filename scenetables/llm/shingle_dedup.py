"""Near-duplicates by SimHash candidates and the exact Jaccard similarity of word shingles.

Copies of a shingle set are one node. Nodes whose SimHashes are equal, or meet in the range join of segment popcounts (simhash_dedup), are
compared first. A radius of three bits cannot find all that is similar, so what is then still apart goes through an exact way for the rest. Two sets of a similarity of 4/5 or more share one of the first fifth of their
shingles under any order that holds for all sets (prefix filter), so candidates lose no link. The order puts shingles
that a sample finds common last, the rest by hash; it decides about the work, never about the result. Sizes, positions
and parity sketches bound the similarity from above and prune without loss; the shingles themselves then decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scenetables.llm.common import discard, materialize, small_batches, text_key
from scenetables.llm.components import connected_components
from scenetables.llm.simhash_dedup import set_fingerprint, similar_fingerprints

SEED = 42
SHINGLE = 5
#: The similarity that links, P / Q.
P, Q = 4, 5
#: One text in SAMPLE tells which shingles are common: those in COMMON or more of its texts, MOST_COMMON at most.
SAMPLE, COMMON, MOST_COMMON = 16, 6, 100_000
#: Slots of the sketch that the last join compares.
SHORT = 1024
#: Rounds of comparing with pivots, and pivots of a shingle in each.
ROUNDS, PIVOTS = 2, 4
#: Up to so many texts of candidates are picked by a broadcast of their ids, more by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one, a text without words has none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < n else map(b" ".join, zip(*(w[i:] for i in range(n))))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def node_of(h: np.ndarray) -> int:
    """Signed 64-bit key of a shingle set."""
    return int(np.uint64(xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))


def sketch(h: np.ndarray) -> bytes:
    """Parities of the set's counts in 2 to 4 slots a shingle, a power of two."""
    bits = 1 << max(6, (2 * len(h) - 1).bit_length())
    slots = ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def short_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the set's counts in SHORT slots, as longs that a join condition can compare."""
    slots = ((h >> np.uint64(32)) % np.uint64(SHORT)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=SHORT) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the number of shingles that only one of two sets has. The longer sketch is folded to the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of P / Q or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return (P + Q) * shared >= P * (len(a) + len(b))


def found(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array known, in a time that hardly depends on its length."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def common_shingles(d: DataFrame, n: int) -> np.ndarray:
    """Shingles that many texts of the sample have, sorted. d: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t.as_py(), n) for t in b.column("text")]).view(np.int64))], ["h"])

    some = small_batches(d.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")).mapInArrow(run, "h long")
    found = some.groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def prints(d: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, node, n, prefix, sketch, short, fp): one row per row of d (doc_id, text_key, text). fp is the SimHash of the set."""
    common = common_shingles(d, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, prefix, sk, short, fp = [], [], [], [], [], []
            for t in b.column("text"):
                h = shingle_set(t.as_py(), n)
                late = found(h, common)
                p = len(h) - -(-P * len(h) // Q) + 1 if len(h) else 0
                node.append(node_of(h))
                size.append(len(h))
                prefix.append(np.concatenate([h[~late], h[late]])[:p].view(np.int64))
                sk.append(sketch(h))
                short.append(short_sketch(h))
                fp.append(set_fingerprint(h))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sk, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(fp, pa.int64())],
                ["doc_id", "text_key", "node", "n", "prefix", "sketch", "short", "fp"],
            )

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_key long, node long, n int, prefix array<long>, sketch binary, short array<long>, fp long")


def _sizes_fit(a: Column, b: Column) -> Column:
    return Q * F.least(a, b) >= P * F.greatest(a, b)


def _sets(d: DataFrame, marks: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(node, h) for the nodes of pairs, each from one of its texts."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = marks.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("of"))
    ids = materialize(ids.select(F.col("of.doc_id").alias("__id"), F.col("of.text_key").alias("__key"), "node"), "ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = d.join(some, d["doc_id"].eqNullSafe(some["__id"]) & (d["text_key"] == some["__key"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [(k.as_py(), shingle_set(t.as_py(), n).view(np.int64)) for k, t in zip(b.column("node"), b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int64()), pa.array([h for _, h in seen], pa.list_(pa.int64()))], ["node", "h"])

    return materialize(small_batches(texts).mapInArrow(run, "node long, h array<long>").dropDuplicates(["node"]), "sets")


def verified(d: DataFrame, marks: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is P / Q or more: by sketches, then by the shingles. What has no pair is not joined."""

    def both(pairs: DataFrame, of: DataFrame, *cols: str) -> DataFrame:
        end = lambda x: of.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
        return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", *(f"{c}_{x}" for c in cols for x in "ab"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, m, k = (b.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b"))
            ok = [(P + Q) * sketch_distance(*s) <= (Q - P) * (i + j) for *s, i, j in zip(x, y, m, k)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(b.column("h_a"), b.column("h_b"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a table of its own, so that a pivot of many pairs is a join key that Spark can split
    sketches = materialize(marks.select("node", "n", "sketch").join(ends, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    left = materialize(small_batches(both(pairs, sketches, "n", "sketch")).mapInArrow(near, "a long, b long"), "near")
    if left.isEmpty():
        return left
    return materialize(small_batches(both(left, _sets(d, marks, left, n), "h")).mapInArrow(exact, "a long, b long"), "links")


def _room(a: str, b: str) -> Column:
    """Whether two sets that share a shingle at these places of their prefixes can be similar: beyond it they share only what
    follows or what shares an earlier one."""
    n, pos = (lambda x: F.col(f"{x}.n")), (lambda x: F.col(f"{x}.pos"))
    shared = F.least(pos(a), pos(b))
    return _sizes_fit(n(a), n(b)) & ((P + Q) * F.least(n(a) - pos(a) + shared, n(b) - pos(b) + shared) >= P * (n(a) + n(b)))


def simhash_pairs(marks: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates by SimHash. Of the nodes of one fingerprint the smallest stands for it: it is compared with each of the others, and with those that
    stand for the fingerprints that the range join of segment popcounts finds within its radius."""
    prints = materialize(marks.select("fp", "node").distinct(), "fingerprints")
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("c")), "fingerprint_nodes")
    same = prints.join(first.filter("c > 1"), "fp").filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    of = lambda x: first.select(F.col("fp").alias(x), F.col("low").alias(f"node_{x}"))
    near = similar_fingerprints(first).join(of("a"), "a").join(of("b"), "b")
    near = near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    pairs = materialize(same.unionByName(near), "simhash_pairs")
    for t in (prints, first):
        discard(t)
    return pairs


def _still_apart(at: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of at whose shingle is in different components, with their components as parts. roots: connected_components()."""
    named = at.join(roots, at["x.node"] == roots["node"], "left").select("key", F.col("x").withField("part", F.coalesce("root", "x.node")).alias("x"), "weight")
    named = materialize(named, "named")
    apart = materialize(named.groupBy("key").agg(F.min("x.part").alias("lo"), F.max("x.part").alias("hi")).filter("lo < hi").select("key"), "apart")
    left = materialize(named.join(apart, "key"), "parts")
    for t in (named, apart, at):
        discard(t)
    return left


def near_duplicate_nodes(d: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """(node, root) of every node that has a link.

    Nodes are first compared with those that SimHash finds, then with some pivots among those that share a shingle of their prefixes: the one that shares the most with others, which in a
    group of copies is the text they come from, and random ones. What is then still in
    different components is compared pair by pair. A group of near copies so costs some comparisons each."""
    # what a shingle's rows have in common is summed before the shuffle and joined back, so that a shingle of any number of texts is a key that Spark can split
    nodes = materialize(marks.select("node", "n", "prefix").dropDuplicates(["node"]), "nodes")
    keys = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    shared = materialize(keys.join(counts, "key"), "shared")
    discard(nodes)
    discard(counts)
    weight = materialize(shared.groupBy("node").agg(F.sum("c").alias("weight")), "weights")
    at = shared.join(weight, "node").select("key", F.struct("node", "n", "pos", F.col("node").alias("part")).alias("x"), "weight")
    at = materialize(at, "parts")
    discard(shared)
    discard(weight)
    candidates = simhash_pairs(marks)
    roots = connected_components(verified(d, marks, candidates, n))
    discard(candidates)
    at = _still_apart(at, roots)
    for k in range(ROUNDS):
        if at.isEmpty():  # no two components share a shingle
            return roots
        order = [F.xxhash64("x.node", F.lit(PIVOTS * k + j)) for j in range(PIVOTS)]
        order = [-F.col("weight"), *order[1:]] if k == 0 else order
        pivots = at.groupBy("key").agg(*(F.min(F.struct(o.alias("o"), "x")).alias(f"p{j}") for j, o in enumerate(order)))
        pivots = materialize(pivots.select("key", F.array_distinct(F.array(*(F.col(f"p{j}.x") for j in range(PIVOTS)))).alias("ys")), "pivots")
        met = at.select("key", "x").join(pivots, "key").select("x", F.explode("ys").alias("y")).filter((F.col("x.part") != F.col("y.part")) & _room("x", "y"))
        pairs = materialize(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "stars")
        more = verified(d, marks, pairs, n)
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))
            at = _still_apart(at, roots)
        for t in (pivots, pairs):
            discard(t)
    if at.isEmpty():
        return roots
    longs = [F.col("short")[i].alias(f"s{i}") for i in range(SHORT // 64)]
    sketches = marks.select("node", *longs).join(at.select(F.col("x.node").alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"])
    last = materialize(at.select("key", "x", F.col("x.node").alias("node")).join(sketches, "node"), "last")
    x, y = (last.select("key", F.col("x").alias(e), *(F.col(f"s{i}").alias(f"{e}{i}") for i in range(SHORT // 64))) for e in "xy")
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(SHORT // 64)), F.lit(0))
    # inside the join, so that texts that share common shingles with a large group and are not similar leave no rows
    close = (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & _room("x", "y") & ((P + Q) * apart <= (Q - P) * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, (x["key"] == y["key"]) & close)
    pairs = materialize(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    more = verified(d, marks, pairs, n)
    return roots if more.isEmpty() else connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, root), one row per row of docs; rows of a root are linked by similarities of P / Q or more.

    A null text counts as empty; texts without words are copies of each other; repeated rows each get a row; an empty table gives an empty result. A very long
    text is held with all its shingles in a task. Only the id and the text are read, so other columns may have any names."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    marks = materialize(prints(d, n), "prints")
    roots = near_duplicate_nodes(d, marks, n)
    return marks.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
