"""Near-duplicates by SimHash with a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments (0, 1 or 2) are a point
of a 32-dimensional grid. The Manhattan distance of two points is at most the Hamming distance of the
fingerprints, so it may prune but never lose a link. Pairs are found by a grid range-join: the coordinates lie in 8 parts of
4, and of two points at a Manhattan distance of 3 or less at least 5 parts are at distance 0. So each point is sent to the
56 cells that 5 of its 8 parts name, and points meet in equal cells. The full lower bound and
then the exact Hamming distance are tested inside the join, so only true links leave it. Unrelated fingerprints meet with a
probability of 2 in 10 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from scenetables.llm.common import materialize, small_batches, table, text_key
from scenetables.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Parts of the grid's coordinates, of which at most RADIUS differ in a link.
PARTS = 8
_EVEN = 0x5555555555555555


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word n-grams, repeats included; 0 without words."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < n else map(b" ".join, zip(*(w[i:] for i in range(n))))
    return set_fingerprint(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def set_fingerprint(h: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes: a bit is 1 if set in over half of them; 0 of none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text takes 4 MB at a time
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): one row per row of docs."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), fp], ["doc_id", "text_key", "fp"])

    id_type = d.schema["doc_id"].dataType.simpleString()
    return small_batches(d).mapInArrow(run, f"doc_id {id_type}, text_key long, fp long")


def popcounts(fp: Column) -> Column:
    """The grid point: 32 counts of two bits each, packed into a long."""
    x, y = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return x.bitwiseXOR(y).bitwiseOR(F.shiftleft(x.bitwiseAND(y), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed grid points."""
    at = lambda v, i: F.expr(f"shiftrightunsigned({v}, 2 * {i}) & 3")
    return sum((F.abs(at(a, i) - at(b, i)) for i in range(32)), F.lit(0))


def cells(v: Column) -> Column:
    """The cells of a packed grid point: each choice of PARTS - RADIUS parts, with the number of the choice above them."""
    bits = 64 // PARTS
    part = [F.shiftrightunsigned(v, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(PARTS)]
    made = []
    for number, choice in enumerate(combinations(range(PARTS), PARTS - RADIUS)):
        key = F.lit(number << bits * len(choice)).cast("long")
        for i, k in enumerate(choice):
            key = key.bitwiseOR(F.shiftleft(part[k], bits * i))
        made.append(key)
    return F.array(*made)


def similar_fingerprints(classes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp) at 3 or fewer differing bits.

    Every fingerprint is sent to 56 cells, whatever the size of the corpus; both sides of the join are the same table,
    shuffled once. A cell of many fingerprints is an ordinary sort-merge join key, which adaptive execution splits."""
    spread = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = classes.select("fp", popcounts(F.col("fp")).alias("v")).repartition(spread)  # few bytes become many rows: all cores share them
    p = p.select("fp", "v", F.explode(cells(F.col("v"))).alias("cell"))
    left, right = (p.select(F.col("fp").alias(x), F.col("v").alias(f"v{x}"), "cell") for x in "ab")
    # ordered so that the cheap parts come first
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS) & (manhattan("va", "vb") <= RADIUS)
    return left.join(right.hint("merge"), (left["cell"] == right["cell"]) & close).select("a", "b").distinct()


def near_duplicate_classes(prints: DataFrame) -> DataFrame:
    """(fp, root): the class of every fingerprint that has a link. Copies count once, so a group of copies costs no
    more than one document."""
    return connected_components(similar_fingerprints(prints.select("fp").distinct())).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id), one row per row of docs; component_id is the smallest id of its class.

    Nulls: a null text counts as empty (fingerprint 0, linked like any other); a null id is ignored by the minimum, so
    component_id is null only for a class without any id. Repeated rows each get a row. An empty table gives
    an empty result. Only the id and the text are read, so other columns may have any names."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = near_duplicate_classes(prints)
    whole = ids.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_root = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = whole.select("fp", "root").join(of_root, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """docs without near-duplicates, whose classes (doc_id, text_key, root) find(docs, id_col, text_col) gives: of each class the row with the smallest id stays (nulls last, then the smaller text
    key; of fully equal ids and texts, the first row by its columns). Columns stay as they are; names that begin with `__keep` are reserved. What stays is
    settled on ids and keys, and the texts are shuffled once; only rows of an equal id and text are ranked. An empty table gives an empty result; find() reads texts whole, whose hashes are
    in memory one text at a time."""
    marks = find(docs, id_col, text_col)
    best = marks.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("best"))
    times = marks.groupBy(F.col("doc_id").alias("__keep_id"), F.col("text_key").alias("__keep_key")).agg(F.count("*").alias("__keep_times"))
    best = best.select(F.col("best.doc_id").alias("i"), F.col("best.text_key").alias("k"))
    best = materialize(times.join(best, times["__keep_id"].eqNullSafe(best["i"]) & (times["__keep_key"] == best["k"]), "left_semi"), "best")
    d = docs.join(best, docs[id_col].eqNullSafe(best["__keep_id"]) & (text_key(docs[text_col]) == best["__keep_key"]))
    order = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    w = Window.partitionBy("__keep_key", "__keep_id").orderBy(*(F.col(f"`{c}`") for c in order))
    names = [F.col(f"`{c}`") for c in docs.columns]
    some = d.filter("__keep_times > 1").withColumn("__keep_rank", F.row_number().over(w)).filter("__keep_rank = 1").select(*names)
    return d.filter("__keep_times = 1").select(*names).unionByName(some)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row of documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
