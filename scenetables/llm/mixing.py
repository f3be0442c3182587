"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets are filled like water: every source gets its weight's share, a source stops at `max_repeats` times its own
words, and what it cannot take is shared again by weight. Blocks go to the sources by highest
quotients, target / (2 k + 1), and the blocks of a source go to its shards in the same way, so every shard knows an
integer quota; a source at its limit takes all its shards whole. A block has BLOCK words, or fewer where the smallest target asks for it, so that each target has
BLOCKS_OF_LEAST blocks or single words. In a shard the documents lie in seeded order on a ring of words, and its quota of blocks is
taken from a seeded block onwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenetables.llm.common import WORD, materialize, table

BLOCK = 64
BLOCKS_OF_LEAST = 16
SHARD_WORDS = 200_000  # a shard is one task of the last window
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 7


def _seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts))


def _number(hex_digest: Column) -> Column:
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """id, source, size (words; null text: 0) and a seeded key for each row, and `row`, a struct of the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []
    return docs.select(
        *kept, F.col("doc_id").alias("id"), F.col("source").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        _seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("key"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, src (number in code point order, null last), source_size, target.

    The single-partition windows run over one row per source, after the partial sums."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    below, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = lambda c, of: F.sum(c).over(every) - F.coalesce(F.sum(of).over(below), F.lit(0))
    level = left("source_size", "cap") / left("w", "w")
    s = s.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("w"))
    # the first level that its own source can take is the water line
    s = s.withColumn("line", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(Window.partitionBy()))
    capped = F.struct(F.col("cap") / F.col("w"), F.col("src")) < F.struct(F.col("line.col1"), F.col("line.src"))
    return s.select("source", "src", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("line.level") * F.col("w")).alias("target"))


def apportion(rows: DataFrame, group: Sequence[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each row by highest quotients votes / (2 k + 1) in its group, the smaller key first in ties.

    Rounding at the common divisor leaves at most about half a seat a row to give or to take back; only the
    quotients next to that divisor are ranked, a number of rows in proportion to the group, however many seats there are."""
    g = Window.partitionBy(*group)
    v = F.col(votes).cast("double")
    r = rows.withColumn("__all", F.sum(v).over(g)).withColumn("__n", F.count("*").over(g))
    r = r.withColumn("__base", F.when((F.col("__all") > 0) & (F.col(seats) > 0), F.floor(v * F.col(seats) / F.col("__all") + 0.5)).otherwise(F.lit(0)).cast("long"))
    r = r.withColumn("__open", F.when(F.col("__all") > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum("__base").over(g))
    near = F.ceil(F.try_divide(v, F.col("__all")) * (F.abs("__open") + F.col("__n"))).cast("long")
    steps = F.when(F.col("__open") > 0, near).when(F.col("__open") < 0, F.least(near, F.col("__base") - 1)).otherwise(F.lit(-1))
    q = r.filter("__open <> 0").withColumn("__k", F.explode(F.when(steps >= 0, F.sequence(F.lit(0).cast("long"), steps))))
    quotient = F.col(votes).cast("double") / F.when(F.col("__open") > 0, 2 * (F.col("__base") + F.col("__k")) + 1).otherwise(2 * (F.col("__base") - F.col("__k")) - 1)
    q = q.withColumn("__q", quotient)
    up, down = Window.partitionBy(*group).orderBy(F.desc("__q"), key), Window.partitionBy(*group).orderBy("__q", F.desc(key))
    q = q.withColumn("__rank", F.when(F.col("__open") > 0, F.row_number().over(up)).otherwise(F.row_number().over(down)))
    moved = q.filter("__rank <= abs(__open)").groupBy(*group, key).agg(F.sum(F.signum("__open")).cast("long").alias("__moved"))
    out_col = (F.col("__base") + F.coalesce("__moved", F.lit(0))).alias(out)
    return r.join(moved, [*group, key], "left").select(*rows.columns, out_col)


def mixture(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (from sized()) with source_size, target and taken. sizes: the same rows without other columns."""
    sources = source_targets(sizes)
    every = Window.partitionBy()
    least = F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / BLOCKS_OF_LEAST)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.coalesce(least, F.lit(1)))).cast("long"))
    sources = sources.withColumn("one", F.lit(1)).withColumn("blocks", F.round(F.sum("source_size").over(every) / F.col("block")).cast("long"))
    sources = apportion(sources, ["one"], "src", "target", "blocks", "won")
    sources = sources.withColumn("full", F.col("target") >= F.col("source_size") * MAX_REPEATS)
    sources = sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    sources = materialize(sources.select("source", "src", "source_size", "target", "block", "won", "full", "n_shards"), "sources")

    def placed(d: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("source", "s")
        return d.join(s, d["source"].eqNullSafe(s["s"])).drop("s").withColumn("shard", F.pmod(_number(F.col("key")), F.col("n_shards")))

    shards = placed(sizes).groupBy("src", "shard").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("won", "full", "block")))
    shards = apportion(shards, ["src"], "shard", "words", "won", "quota")
    limit = F.col("words") * MAX_REPEATS
    want = F.when(F.col("full"), limit).otherwise(F.least(F.col("quota") * F.col("block"), limit))
    first = F.pmod(_number(_seeded(F.col("src").cast("string"), F.col("shard").cast("string"))), F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block")).cast("long"))) * F.col("block")
    shards = shards.select("src", "shard", "words", want.alias("want"), first.alias("first"))
    line = Window.partitionBy("src", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = placed(rows).withColumn("hi", F.sum("size").over(line)).withColumn("lo", F.col("hi") - F.col("size")).join(shards, ["src", "shard"])
    passes = F.when(F.col("words") > 0, F.floor(F.col("want") / F.greatest("words", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    end = F.col("first") + F.col("want") - passes * F.col("words")
    arc = lambda a, b: F.greatest(F.lit(0), F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a))
    taken = passes * F.col("size") + arc(F.col("first"), F.least(end, F.col("words"))) + arc(F.lit(0), end - F.col("words"))
    return d.select(*rows.columns, "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """Rows of docs that the mixture takes, with their columns and size, source_size, target and taken (replacing columns
    of those names; any other names may occur). A null text has no words and is never taken; a null source is a source of its own, the last;
    equal ids and texts share a shard and split its quota by position; an empty table gives an empty result. A document is taken word by word, however long it is."""
    named = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in named]
    sizes = materialize(sized(docs), "sizes")
    out = mixture(sizes, sized(docs, keep)).filter("taken > 0")
    return out.select("row.*", *named)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents."""
    sizes = materialize(sized(table(spark, sf_dir, "documents")), "sizes")
    return mixture(sizes, sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The same by brute force: all quotients are listed and the highest taken.
OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * {MAX_REPEATS} AS cap, CASE (src - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w FROM sums),
levels AS (
  SELECT *, row_number() OVER o AS ord,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, src)),
line AS (SELECT min(ord) AS ord, arg_min(level, ord) AS level FROM levels WHERE level <= cap::DOUBLE / w),
targets AS (
  SELECT l.source, l.src, l.source_size, CASE WHEN l.ord < line.ord THEN l.cap::DOUBLE ELSE line.level * l.w END AS target FROM levels l, line),
size AS (SELECT greatest(1, least({BLOCK}, coalesce(floor(min(target) FILTER (target > 0) / {BLOCKS_OF_LEAST}), 1)))::BIGINT AS block FROM targets),
seats AS (SELECT round(sum(source_size)::DOUBLE / any_value(block))::BIGINT AS n FROM targets, size),
won AS (
  SELECT src, count(*) AS n FROM (
    SELECT src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src) AS r FROM targets, size, unnest(range((target / block)::BIGINT + 200)) AS t(k)), seats
  WHERE r <= seats.n GROUP BY src),
quota AS (
  SELECT t.*, coalesce(w.n, 0) AS won, block, target >= source_size * {MAX_REPEATS} AS whole,
         greatest(1, ceil(t.source_size / {SHARD_WORDS}::DOUBLE))::BIGINT AS n_shards
  FROM targets t CROSS JOIN size LEFT JOIN won w USING (src)),
placed AS (
  SELECT d.doc_id, d.size, d.key, q.*, ('0x' || key[1:8])::BIGINT % q.n_shards AS shard FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT src, shard, sum(size)::BIGINT AS words, any_value(won) AS won, any_value(block) AS block, any_value(whole) AS whole FROM placed GROUP BY src, shard),
shard_won AS (
  SELECT src, shard, count(*) AS n FROM (
    SELECT src, shard, won, row_number() OVER (PARTITION BY src ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT *, sum(words) OVER (PARTITION BY src) AS every FROM shards) s, unnest(range((won * words::DOUBLE / greatest(every, 1))::BIGINT + 200)) AS t(k))
  WHERE r <= won GROUP BY src, shard),
shard_want AS (
  SELECT s.src, s.shard, s.words, CASE WHEN whole THEN s.words * {MAX_REPEATS} ELSE least(coalesce(w.n, 0) * block, s.words * {MAX_REPEATS}) END AS want,
         ('0x' || md5('{SEED}:' || s.src || ':' || s.shard)[1:8])::BIGINT % greatest(1, ceil(s.words / block::DOUBLE)::BIGINT) * block AS first
  FROM shards s LEFT JOIN shard_won w USING (src, shard)),
lined AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, w.words, w.want, w.first,
         (sum(p.size) OVER (PARTITION BY p.src, p.shard ORDER BY p.key, p.doc_id, p.size ROWS UNBOUNDED PRECEDING))::BIGINT AS hi
  FROM placed p JOIN shard_want w USING (src, shard))
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(hi, least(stop, words)) - greatest(lo, first)) + greatest(0, least(hi, stop - words) - greatest(lo, 0)))::BIGINT AS taken
FROM (SELECT *, hi - size AS lo, CASE WHEN words > 0 THEN want // words ELSE 0 END AS passes,
             first + want - CASE WHEN words > 0 THEN want // words ELSE 0 END * words AS stop FROM lined)
"""
