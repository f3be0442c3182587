"""URL filters by host-suffix and path-prefix expressions, hash prefixes and full digests.

Each distinct host and path is expanded into its host suffixes (at label borders) times the path prefixes whose length
some rule has. An expression meets the rules by an equi-join on the first 32 bits of its SHA-256; the full
digest confirms, and the longest confirmed rule wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import ascii_lower, table

PREFIX_HEX = 8
DEFAULT = "allow"
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def split_url(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds __host and __path; both are empty for null and for a url without ://."""
    url, head = F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://[^/?#]*"
    rest = F.regexp_substr(F.regexp_replace(url, head, ""), F.lit(r"^[^?#]+"))
    path = F.when(F.regexp_like(url, F.lit(head)), F.coalesce(rest, F.lit(""))).otherwise(F.lit(""))
    return pages.withColumns({"__host": ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), "__path": path})


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with __host, __path, __rule and __verdict added.

    rules(host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's; the longest
    (host and path together, then the longer host, then the greater text) wins; DEFAULT without one. Nulls in rules are
    ignored. Every row of pages gets one row, repeated rows too; an empty rule table leaves the default. A very long url is expanded by its
    host's labels and the rules' path lengths only. All columns of pages stay; names that begin with two underscores are reserved."""
    r = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"), "verdict")
    r = r.withColumn("rule", F.concat("rh", "rp")).withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    # at most as many numbers as the longest rule path has characters
    lengths = sorted(x[0] for x in r.select(F.length("rp")).distinct().collect())
    p = split_url(pages, url_col).withColumn("__cut", F.substring("__path", 1, max(lengths, default=0)))
    places = p.select("__host", "__cut").distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length("__cut") >= n, F.substring("__cut", 1, n)) for n in lengths) or [F.lit(None).cast("string")]))
    said = places.select("__host", "__cut", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).withColumn("prefix", F.explode("prefixes"))
    said = said.withColumn("full", F.sha2(F.concat("suffix", "prefix"), 256))
    hits = said.join(r, F.substring("full", 1, PREFIX_HEX) == r["short"]).filter("full = digest")
    best = hits.groupBy("__host", "__cut").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rh").alias("nh"), "rule", "verdict")).alias("__best"))
    best = best.select("__host", "__cut", F.col("__best.rule").alias("__rule"), F.col("__best.verdict").alias("__said"))
    out = p.join(best, ["__host", "__cut"], "left")
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), "__host", "__path", "__rule", F.coalesce("__said", F.lit(DEFAULT)).alias("__verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES))
    return out.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rh, rp, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + r"""),
fits AS (
  SELECT s.page_id, s.host, s.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT * FROM split) s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id IS NOT DISTINCT FROM f.page_id AND s.host = f.host AND s.path = f.path
"""
