"""Benchmark decontamination with DataFrame functions only.

An item of n words is compared with the windows of n words of each document. Windows that can reach the similarity at
all have most of their shingles in the benchmark; this lossless bound leaves a few windows around each passage.
Their SimHashes of 256 bits meet those of the items of the same length by multi-index Hamming blocks: 16 blocks of 16 bits, of which the items,
the small side, probe every value within FLIPS bits. Fingerprints within RADIUS bits always meet, 3 % of unrelated ones
do. A document shorter than an item is one window, for which bits say too little: it meets the items that have one of the
first fifth of its shingles, which a similarity of 0.8 implies. The weighted similarity of the shingles, repeats counted, then decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import materialize, table, text_key, words

SHINGLE = 5
SIMILARITY = 0.8
#: A fingerprint: so many hashes of 64 bits for each shingle, in blocks of so many bits.
HASHES, BLOCK = 4, 16
BLOCKS = HASHES * 64 // BLOCK
#: Bits that may differ in the block by which two fingerprints meet. At a similarity of 0.8 a bit differs with a probability of
#: 0.15, so that a pair misses all blocks with one of 0.000003; no fingerprints within RADIUS miss each other.
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
PROBES = [sum(1 << i for i in c) for k in range(FLIPS + 1) for c in combinations(range(BLOCK), k)]
#: Beyond so many distinct benchmark shingles (about 16 bytes each) the first join is shuffled, not broadcast.
BROADCAST_SHINGLES = 1_000_000


def shingles(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, in order; empty for fewer words."""
    n = F.size(w) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(k), *(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<long>"))


def fingerprint(h: Column) -> Column:
    """BLOCKS numbers of BLOCK bits: the bits set in more than half of the shingles, by HASHES hashes of each. Two counts of 32 bits
    share a long, so a shingle takes 32 additions a hash."""
    names = [f"s{j}" for j in range(32)]
    both = F.lit(1 << 32 | 1)

    def of(q: int) -> Column:
        add = lambda acc, x: F.struct(*((acc[c] + F.shiftrightunsigned(x, j).bitwiseAND(both)).alias(c) for j, c in enumerate(names)))
        count = lambda acc, bit: F.shiftrightunsigned(acc[names[bit % 32]], bit // 32 * 32).bitwiseAND(F.lit(0xFFFFFFFF))
        number = lambda acc, k: sum((F.when(2 * count(acc, BLOCK * k + i) > F.size(h), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(BLOCK)), F.lit(0))
        zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in names))
        return F.aggregate(F.transform(h, lambda x: F.xxhash64(F.lit(q), x)), zero, add, lambda acc: F.array(*(number(acc, k) for k in range(64 // BLOCK))))

    return F.concat(*(of(q) for q in range(HASHES)))


def block_key(block: Column, value: Column) -> Column:
    return F.shiftleft(block, BLOCK).bitwiseOR(value)


def probes(items: DataFrame, *cols: str) -> DataFrame:
    """cols and key: every block value within FLIPS bits of an item's (column fp)."""
    each = items.select(*cols, F.posexplode("fp").alias("block", "value")).withColumn("flip", F.explode(F.array(*map(F.lit, PROBES))))
    return each.select(*cols, block_key(F.col("block"), F.col("value").bitwiseXOR(F.col("flip"))).alias("key"))


def item_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n (words), k (words of a shingle: SHINGLE, or all of a shorter item), h (shingle hashes), fp. Items without
    words are left out."""
    i = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    i = i.withColumn("k", F.least("n", F.lit(SHINGLE)))
    h = shingles(F.col("w"), SHINGLE)
    for k in range(1, SHINGLE):
        h = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(h)
    return i.select("item_id", "n", "k", h.alias("h")).withColumn("fp", fingerprint(F.col("h")))


def _overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays, repeats counted."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda h, x: F.size(F.filter(h, lambda y: y == x))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x))))


def candidate_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, starts): the windows of n words of which enough shingles occur in items of n words.

    A window and an item of m shingles each have a similarity of 0.8 only if they share 8 m / 9 shingles; a document of
    fewer than n words, one window as a whole, only if it has 0.8 m of them. docs: doc_id, text_key, w."""
    marks = materialize(items.select(F.explode("h").alias("h"), "n", "k").distinct(), "marks")
    sizes = sorted(r.k for r in marks.select("k").distinct().collect())  # at most SHINGLE numbers
    known = F.broadcast(marks) if marks.count() <= BROADCAST_SHINGLES else marks
    if not sizes:
        return docs.select("doc_id", "text_key", F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts")).filter("false")
    # a row for each place, whose words are hashed as they lie in the array; both run in generated code
    each = docs.withColumn("size", F.size("w")).filter(F.col("size") >= sizes[0])
    each = each.select("doc_id", "text_key", "size", "w", F.explode(F.sequence(F.lit(0), F.col("size") - sizes[0])).alias("pos"))
    at_k = lambda k: F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *(F.get("w", F.col("pos") + j) for j in range(k))).alias("h"))
    if len(sizes) == 1:
        each = each.select("doc_id", "text_key", "size", "pos", at_k(sizes[0]).alias("x")).select("doc_id", "text_key", "size", "pos", "x.k", "x.h")
    else:
        here = F.filter(F.array(*(at_k(k) for k in sizes)), lambda x: F.col("pos") + x["k"] <= F.col("size"))
        each = each.select("doc_id", "text_key", "size", "pos", F.inline(here))
    found = each.join(known, ["h", "k"]).select("doc_id", "text_key", "size", "n", "pos")
    at = found.groupBy("doc_id", "text_key", "n").agg(F.sort_array(F.collect_set("pos")).alias("pos"), F.first("size").alias("size"))
    m = F.col("n") - F.least("n", F.lit(SHINGLE)) + 1
    at = at.withColumn("m", m).withColumn("need", F.when(F.col("size") < F.col("n"), F.ceil(8 * m / 10)).otherwise(F.ceil(8 * m / 9)).cast("int")).filter("size(pos) >= need")
    # with hit i as a window's first, hit i + need - 1 must lie in it too
    first = lambda i: F.greatest(F.lit(0), F.coalesce(F.get("pos", i - 1) + 1, F.lit(0)), F.get("pos", i + F.col("need") - 1) - F.col("m") + 1)
    last = lambda i: F.least(F.get("pos", i), F.col("size") - F.col("n"))
    runs = F.transform(F.sequence(F.lit(0), F.size("pos") - F.col("need")), lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.array().cast("array<int>")))
    starts = F.when(F.col("size") < F.col("n"), F.array(F.lit(0))).otherwise(F.flatten(runs))
    return at.select("doc_id", "text_key", "n", starts.alias("starts")).filter("size(starts) > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, start_word, n_words, similarity): for each document and benchmark item the most similar
    window, the first in ties, if its similarity is 0.8 or more.

    Nulls: a null text has no words and a null id is an id of its own. Repeated rows give one result, and so do items of the same
    id and length. An empty table on either side gives an empty result. Other columns are not read. The words of a text are one array in a task, so a very long text takes memory
    in proportion."""
    items = materialize(item_table(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    d = d.filter(F.col("text").isNotNull())
    wins = materialize(candidate_windows(d.select("doc_id", "text_key", words(F.col("text")).alias("w")), items), "windows")
    wins = wins.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n", "starts")
    there = d.join(wins, d["doc_id"].eqNullSafe(wins["__id"]) & (d["text_key"] == wins["__key"]))
    there = there.select("doc_id", "text_key", "n", "starts", words(F.col("text")).alias("w"))
    there = there.select("doc_id", "text_key", "n", F.explode("starts").alias("s"), "w").select("doc_id", "text_key", "n", "s", F.slice("w", F.col("s") + 1, F.col("n")).alias("w"))
    h = shingles(F.col("w"), SHINGLE)
    for k in range(1, SHINGLE):
        h = F.when(F.col("n") == k, shingles(F.col("w"), k)).otherwise(h)
    there = there.select("doc_id", "text_key", "n", "s", (F.size("w") < F.col("n")).alias("short"), h.alias("wh"))
    there = there.withColumn("fp", F.when(~F.col("short"), fingerprint(F.col("wh")))).withColumn("window", F.monotonically_increasing_id())
    there = materialize(there, "fingerprints")
    # narrow rows meet, and shingles follow the pairs that did; the probes are many more than Spark expects, so they are not broadcast
    left = there.filter("NOT short").select("window", "n", F.posexplode("fp").alias("block", "value")).select("window", "n", block_key(F.col("block"), F.col("value")).alias("key"))
    right = probes(items, "item", "n").hint("merge")
    few = there.filter("short").select("window", "n", F.explode(F.slice(F.sort_array("wh"), F.lit(1), F.floor(F.size("wh") / 5).cast("int") + 1)).alias("x"))
    of = items.select("item", "n", F.explode(F.array_distinct("h")).alias("x"))
    pairs = left.join(right, ["n", "key"]).select("window", "item").unionByName(few.join(of, ["n", "x"]).select("window", "item")).distinct()
    pairs = pairs.join(there, "window").join(items.select("item", "item_id", F.col("h").alias("ih")), "item")
    both = _overlap(F.col("ih"), F.col("wh"))
    pairs = pairs.select("doc_id", "text_key", "item_id", "n", "s", (both / (F.size("ih") + F.size("wh") - both)).alias("similarity")).filter(F.col("similarity") >= SIMILARITY)
    best = pairs.groupBy("doc_id", "text_key", "item_id", F.col("n").cast("long").alias("n_words")).agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"))).alias("best"))
    return best.select("doc_id", "text_key", "item_id", (-F.col("best.s")).cast("long").alias("start_word"), "n_words", F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; rows and columns else stay as they are. Columns `__bad_id` and `__bad_key` are reserved."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]) & (text_key(docs[text_col]) == bad["__bad_key"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity of every benchmark item found in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


#: Without fingerprints: every window that shares a shingle with an item is compared.
OP8_SQL = r"""
WITH doc AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT *, row_number() OVER () AS row, len(w) AS size FROM doc),
i AS (
  SELECT *, len(w) AS n, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m FROM (
    SELECT item_id, row_number() OVER () AS item,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM i),
ds AS (SELECT d.row, k, p, array_to_string(w[p + 1 : p + k], ' ') AS sh FROM d, ks, unnest(range(greatest(size - k + 1, 0))) AS t(p)),
ish AS (
  SELECT item, k, n, m, sh, count(*) AS times FROM (
    SELECT item, k, n, m, array_to_string(w[p + 1 : p + k], ' ') AS sh FROM i, unnest(range(m)) AS t(p)) GROUP BY ALL),
hits AS (SELECT ds.row, ish.item, ish.n, ish.m, ds.p, ds.sh, ish.times, d.size FROM ds JOIN ish USING (k, sh) JOIN d ON d.row = ds.row),
cand AS (
  SELECT DISTINCT row, item, n, m, size, s FROM hits, unnest(range(greatest(p - m + 1, 0), p + 1)) AS t(s)
  WHERE s = 0 OR s + n <= size),
shared AS (
  SELECT row, item, n, m, size, s, sum(least(c, times)) AS i FROM (
    SELECT c.row, c.item, c.n, c.m, c.size, c.s, h.sh, h.times, count(*) AS c
    FROM cand c JOIN hits h ON h.row = c.row AND h.item = c.item AND h.p BETWEEN c.s AND c.s + c.m - 1 GROUP BY ALL) GROUP BY ALL),
scored AS (
  SELECT *, i::DOUBLE / (m + least(m, size - least(n, 5) + 1) - i)::DOUBLE AS similarity FROM shared WHERE s + n <= size OR s = 0)
SELECT d.doc_id, i.item_id, arg_max(s, (similarity, -s))::BIGINT AS start_word, scored.n::BIGINT AS n_words, max(similarity) AS similarity
FROM scored JOIN d USING (row) JOIN i ON i.item = scored.item WHERE similarity >= 0.8 GROUP BY scored.row, d.doc_id, i.item_id, scored.n
"""
