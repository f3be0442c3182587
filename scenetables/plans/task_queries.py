"""Queries on captions, files and task lists: documents are captions, pages and events stand for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenetables.plans import manifest
from scenetables.sources import scene, sinks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variations(spark, sf_dir):
    """Every document in seven kinds, cleaned, with its output's name."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), manifest.cleaned_caption(F.col("text")).alias("text"))
    t = manifest.variation_tasks(d)
    return t.select("clip_id", "variation", F.concat_ws("_", F.col("clip_id").cast("string"), "variation").alias("output"), F.md5("text").alias("digest"))


def resume(spark, sf_dir):
    """Documents that have no label yet."""
    return sinks.remaining(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels"), ["doc_id"])


def success_report(spark, sf_dir):
    """Clips (documents) whose quality label is 1 count as successes."""
    r = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("ok"))
    return sinks.success_report(r)


def failures(spark, sf_dir):
    return sinks.failures(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("ok")))


def variation_maps(spark, sf_dir):
    """The turns of each conversation as one JSON object."""
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip_id"), F.format_string("%s %05d", "role", "turn").alias("variation"), F.length("text").cast("string").alias("text"))
    c = c.groupBy("clip_id", "variation").agg(F.max("text").alias("text"))
    return sinks.variation_maps(c)


def event_views(events: DataFrame) -> DataFrame:
    """ord, view: the types of events in the order of their names, a row for each."""
    kinds = events.select(F.col("event_type").alias("view")).distinct()
    return kinds.select((F.row_number().over(Window.orderBy("view")) - 1).alias("ord"), "view")


def complete_views(spark, sf_dir):
    """User days on which every type of event was seen, with the first event of each in a fixed order."""
    e = _table(spark, sf_dir, "events")
    views = event_views(e)
    listing = e.select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("clip_id"), F.lit("hdmap").alias("kind"), F.col("event_type").alias("view"), F.format_string("%09d", "event_id").alias("path"))
    out = manifest.complete_views(listing, views, ["hdmap"])
    return out.select("clip_id", F.array_join(F.col("paths")["hdmap"], ",").alias("paths"))


def batches(spark, sf_dir):
    """Documents of each source in batches of 25."""
    d = _table(spark, sf_dir, "documents").select("source", "doc_id")
    return manifest.batch_ids(d, "doc_id", 25, ["source"])


def caption_match(spark, sf_dir):
    """Documents with the first page whose path ends in their number."""
    p = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"/(\d+)[^/0-9]*", 1).alias("stem"), F.format_string("%012d", "page_id").alias("path")).filter("stem <> ''")
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang")
    return manifest.captions_with_videos(d, p).select("key", "lang", "path", "n_videos")


def generation_tasks(spark, sf_dir):
    """Documents with a toxic label whose quality is not known to be bad, as tasks still to do."""
    labels = _table(spark, sf_dir, "labels")
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("clip_id"), F.col("lang").alias("variation"), F.md5("text").alias("text"))
    listing = labels.select(F.col("doc_id").cast("string").alias("clip_id"), F.when(F.col("toxic") == 0, "hdmap").otherwise("none").alias("folder"))
    done = labels.filter("quality = 0").join(d, labels["doc_id"].cast("string") == d["clip_id"]).select(F.concat_ws("_", "clip_id", "variation").alias("output"))
    return manifest.generation_tasks(d, listing, done).select("clip_id", "variation", "output", "text")


def map_explode(spark, sf_dir):
    """Key and value counts of the events' properties."""
    e = _table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total"))


def unpivot(spark, sf_dir):
    """Measures of order lines, a row for each line and measure."""
    l = _table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return l.select("l_orderkey", "l_linenumber", *names).unpivot(["l_orderkey", "l_linenumber"], names, "key", "value")


def folder_filter(spark, sf_dir):
    """Pages by the first part of their path: those of the common folder and of the folders of one type."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)).alias("folder"))
    return scene.in_folders(p, ["en"], {"west": ["fr", "de"], "south": ["es"]}, ["west"])


def names(spark, sf_dir):
    """Key and chunk of names built from the parts table."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("segment-"), F.col("p_partkey").cast("string"), F.lit("_"), (F.col("p_partkey") % 3).cast("string")).alias("stem"))
    return p.select("p_partkey", manifest.clip_from_record(F.concat("stem", F.lit("_with_camera_labels"))).alias("clip_id"), manifest.video_key(F.col("stem")).alias("key"), manifest.chunk_suffix(F.col("stem")).alias("chunk"), manifest.snake_case(F.concat(F.lit("partKey"), F.initcap(F.lit("name")))).alias("name"))


def shuffled_clips(spark, sf_dir):
    """The places of customers in a seeded order."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"))
    return manifest.shuffled(c, 7)


QUERIES = {f.__name__: f for f in (variations, resume, success_report, failures, variation_maps, complete_views, batches, caption_match, generation_tasks, map_explode, unpivot, folder_filter, names, shuffled_clips)}

ORACLE_SQL = {
    "variations": f"""SELECT doc_id AS clip_id, k AS variation, doc_id || '_' || k AS output, md5(replace(replace(replace(text, 'Rewritten Caption: ', ''), chr(10), ' '), '  ', ' ')) AS digest
FROM documents, unnest([{', '.join(f"'{k}'" for k in manifest.REWRITES)}]) AS t(k)""",
    "resume": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "success_report": """SELECT count_if(quality = 1)::BIGINT AS n_ok, count_if(quality IS NULL OR quality <> 1)::BIGINT AS n_failed,
  count_if(quality IS NULL OR quality <> 1) = 0 AS all_ok FROM labels""",
    "failures": "SELECT doc_id AS key FROM labels WHERE quality IS NULL OR quality <> 1",
    "variation_maps": """WITH c AS (SELECT conv_id AS clip_id, role || ' ' || printf('%05d', turn) AS k, max(length(text)::VARCHAR) AS v FROM conversations GROUP BY ALL)
SELECT clip_id, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS json FROM c GROUP BY clip_id""",
    "complete_views": """WITH f AS (SELECT user_id || ':' || ts::DATE AS clip_id, event_type, printf('%09d', min(event_id)) AS path FROM events GROUP BY ALL)
SELECT clip_id, string_agg(path, ',' ORDER BY event_type) AS paths FROM f GROUP BY clip_id HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""",
    "batches": "SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25)::BIGINT AS batch FROM documents",
    "caption_match": r"""WITH p AS (SELECT regexp_extract(url, '/(\d+)[^/0-9]*', 1) AS stem, printf('%012d', page_id) AS path FROM pages),
k AS (SELECT regexp_replace(stem, '_0$', '') AS key, min(path) AS path, count(*) AS n_videos FROM p WHERE stem <> '' GROUP BY ALL)
SELECT k.key, d.lang, k.path, k.n_videos FROM documents d JOIN k ON d.doc_id::VARCHAR = k.key""",
    "generation_tasks": """SELECT doc_id::VARCHAR AS clip_id, lang AS variation, doc_id || '_' || lang AS output, md5(text) AS text FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
    "map_explode": """SELECT event_type, k, count(*) AS n, sum(json_extract_string(props, '$.' || k)::BIGINT)::BIGINT AS total
FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""",
    "unpivot": "SELECT l_orderkey, l_linenumber, key, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME key VALUE value)",
    "folder_filter": "SELECT page_id, split_part(split_part(url, '://', 2), '/', 2) AS folder FROM pages WHERE split_part(split_part(url, '://', 2), '/', 2) IN ('en', 'fr', 'de')",
    "names": """SELECT p_partkey, p_partkey || '_' || p_partkey % 3 AS clip_id, regexp_replace('segment-' || p_partkey || '_' || p_partkey % 3, '_0$', '') AS key, '_' || p_partkey % 3 AS chunk, 'part_key_name' AS name FROM part""",
    "shuffled_clips": "SELECT c_custkey AS clip_id, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) - 1 AS ord FROM customer",
}
