"""Captions, prompts and task lists for generation and embedding jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.operators import ranks

#: Kinds of rewriting.
REWRITES = ("Golden hour", "Morning", "Night", "Rainy", "Snowy", "Sunny", "Foggy")
#: View, order in a prompt.
VIEWS = (
    "ftheta_camera_front_wide_120fov",
    "ftheta_camera_cross_left_120fov",
    "ftheta_camera_cross_right_120fov",
    "ftheta_camera_rear_tele_30fov",
    "ftheta_camera_rear_left_70fov",
    "ftheta_camera_rear_right_70fov",
)
#: Prompt prefixes of pinhole views.
PREFIXES = {
    "pinhole_front": "The video is captured from a camera mounted on a car. The camera is facing forward.",
    "pinhole_front_left": "The video is captured from a camera mounted on a car. The camera is facing forward and slightly to the left.",
    "pinhole_front_right": "The video is captured from a camera mounted on a car. The camera is facing forward and slightly to the right.",
    "pinhole_side_left": "The video is captured from a camera mounted on a car. The camera is facing to the left.",
    "pinhole_side_right": "The video is captured from a camera mounted on a car. The camera is facing to the right.",
}
#: What comes before the new caption, and what a model may put before its answer.
MARKER, THINKING = "New caption:", "<think>\n\n</think>\n\n"
RETRIES = 3


def clip_from_record(name: Column) -> Column:
    """Clip id of a record's name, without the leading `segment-` and the trailing `_with_camera_labels`."""
    return F.regexp_replace(F.regexp_replace(name, "^segment-", ""), "_with_camera_labels$", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def cleaned_caption(text: Column) -> Column:
    """Without the rewriter's heading; line ends become spaces, then double spaces become single ones, in one pass."""
    out = F.replace(text, F.lit("Rewritten Caption: "), F.lit(""))
    return F.replace(F.replace(out, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def after_marker(response: Column) -> Column:
    """What follows the last marker; null if there is none, which calls for another try."""
    return F.when(F.contains(response, F.lit(MARKER)), F.substring_index(response, MARKER, -1))


def without_thinking(response: Column) -> Column:
    return F.when(F.startswith(response, F.lit(THINKING)), F.substr(response, F.lit(len(THINKING) + 1))).otherwise(response)


def video_key(stem: Column) -> Column:
    """Key of a video's name: without a trailing _0."""
    return F.regexp_replace(stem, "_0$", "")


def chunk_suffix(stem: Column) -> Column:
    return F.concat(F.lit("_"), F.element_at(F.split(stem, "_"), -1))


def view_table(spark, views: Sequence[str] = VIEWS) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.posexplode(F.array(*map(F.lit, views))).alias("ord", "view"))


def variation_tasks(captions: DataFrame, kinds: Sequence[str] = REWRITES) -> DataFrame:
    """captions (clip_id, text) times the kinds of rewriting: (clip_id, variation, text)."""
    return captions.select("clip_id", F.explode(F.array(*map(F.lit, kinds))).alias("variation"), "text")


def chat_prompts(tasks: DataFrame, system: str, template: str) -> DataFrame:
    """Adds messages: a system and a user turn; the template has one place for the caption and one for the kind."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return tasks.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", F.format_string(template, "text", "variation"))))


#: Follow-up turns of a change of colours, for callers without turns of their own; the second has a place for the caption.
COLOUR_TURNS = ("Which vehicles have colours?", "Use other colours for them.\n%s")


def with_turn(chats: DataFrame, said: Column, ask: Column) -> DataFrame:
    """chats (messages) with the assistant's answer and the user's next turn added; a null answer, which calls for another try, adds only the turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    more = F.filter(F.array(turn("assistant", said), turn("user", ask)), lambda m: m["content"].isNotNull())
    return chats.withColumn("messages", F.concat("messages", more))


def colour_turns(chats: DataFrame, caption: str = "text", answers: tuple[str, str] = ("response", "places"), turns: tuple[str, str] = COLOUR_TURNS) -> DataFrame:
    """chats with two turns that change colours; answers: columns with the model's answers to the rewriting and to the first of these turns."""
    first = with_turn(chats, F.col(answers[0]), F.lit(turns[0]))
    return with_turn(first, F.col(answers[1]), F.format_string(turns[1], caption))


def embedded(responses: DataFrame, out: str = "response") -> DataFrame:
    """responses of an encoder (JSON of embedding and mask in `out`) as embedding, mask and n_tokens, cut to the mask; failed rows are left out."""
    e = responses.withColumn("__e", F.from_json(out, "struct<embedding: array<array<float>>, mask: array<int>>")).filter("__e.mask IS NOT NULL")
    return truncated_embeddings(e.select(*(c for c in responses.columns if c not in (out, "error")), "__e.embedding", "__e.mask"))


def batch_ids(rows: DataFrame, order: str, size: int, group: Sequence[str]) -> DataFrame:
    """Adds batch: numbers of `size` rows each, by order inside each group, the last one smaller. A group is spread over tasks (ranks.numbered)."""
    n = ranks.numbered(rows, [order], group, "__n")
    return n.select(*rows.columns, F.floor(F.col("__n") / size).cast("long").alias("batch"))


def batch_infer(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], accept: Callable[[object], bool] = lambda _: True, out: str = "response", retries: int = RETRIES) -> DataFrame:
    """Adds `out` (string) and `error` by a model of the caller's.

    make() loads the model, once in each task, and gives a function from rows to results. Rows whose result is not
    accepted are tried again, `retries` times in all; those that fail keep a null and an error."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{out}` string, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            b = b.reset_index(drop=True)
            result, error = pd.Series([None] * len(b), dtype=object), pd.Series(["not accepted"] * len(b), dtype=object)
            left = list(range(len(b)))
            for _ in range(retries):
                if not left:
                    break
                try:
                    got = list(model(b.loc[left]))
                except Exception as e:  # the caller's model may fail on a batch; its rows say so
                    error[left] = f"{type(e).__name__}: {e}"
                    continue
                again = []
                for k, value in zip(left, got):
                    if value is not None and accept(value):
                        result[k], error[k] = value, None
                    else:
                        error[k] = "not accepted"
                        again.append(k)
                left = again
            yield b.assign(**{out: result, "error": error})

    return rows.mapInPandas(run, schema)


def truncated_embeddings(encoded: DataFrame) -> DataFrame:
    """embedding (rows of floats), mask and offsets cut to the mask's length; adds n_tokens."""
    n = F.aggregate("mask", F.lit(0), lambda acc, x: acc + x)
    e = encoded.withColumn("n_tokens", n)
    cut = {c: F.slice(c, F.lit(1), F.col("n_tokens")) for c in ("embedding", "mask", "offsets") if c in encoded.columns}
    return e.withColumns(cut)


def with_inputs(tasks: DataFrame, listing: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Tasks whose clip has a file in every folder."""
    for f in folders:
        tasks = tasks.join(listing.filter(F.col("folder") == f).select("clip_id"), "clip_id", "left_semi")
    return tasks


def complete_views(listing: DataFrame, views: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(clip_id, paths): clips that have every view of every kind; paths (kind -> array in view order).

    listing: clip_id, kind, view, path. Division by counting. views is a dimension table, a row
    for each camera of a rig, and is broadcast as such."""
    l = listing.filter(F.col("kind").isin(*kinds)).join(F.broadcast(views), "view")
    one = l.groupBy("clip_id", "kind", "view", "ord").agg(F.min("path").alias("path"))
    g = one.groupBy("clip_id", "kind").agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("p"), F.count("*").alias("n"))
    need = F.broadcast(views.agg(F.count("*").alias("need")))
    g = g.join(need, F.col("n") == F.col("need"))
    done = g.groupBy("clip_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.transform("p", lambda x: x["path"]))))).alias("paths"), F.count("*").alias("n"))
    return done.filter(F.col("n") == len(set(kinds))).select("clip_id", "paths")


def captions_with_videos(captions: DataFrame, videos: DataFrame) -> DataFrame:
    """captions(key, text) with the first video (by path) of the same key; captions without one are left out. n_videos tells ties."""
    v = videos.withColumn("key", video_key(F.col("stem"))).groupBy("key").agg(F.min("path").alias("path"), F.count("*").alias("n_videos"))
    return captions.join(v, "key")


def paired_by_name(rgb: DataFrame, condition: DataFrame) -> DataFrame:
    """(name, rgb_path, condition_path) of files with the same name; one without a partner, or another number of frames, is an
    error. Both: name, path, n_frames."""
    a, b = rgb.select("name", F.col("path").alias("rgb_path"), F.col("n_frames").alias("na")), condition.select("name", F.col("path").alias("condition_path"), F.col("n_frames").alias("nb"))
    j = a.join(b, "name", "full_outer")
    ok = F.when(F.col("na") == F.col("nb"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no equal partner: "), F.col("name"))).cast("string"))
    return j.select(ok.alias("name"), "rgb_path", "condition_path")


def generation_tasks(captions: DataFrame, listing: DataFrame, done: DataFrame, need_lidar: bool = False) -> DataFrame:
    """(clip_id, variation, text, output) still to be generated: captions whose clip has its control videos and whose output is
    not there. done: output."""
    t = with_inputs(captions, listing, ["hdmap", *(["lidar"] if need_lidar else [])])
    t = t.withColumn("output", F.concat_ws("_", "clip_id", "variation"))
    return t.join(done.select("output").distinct(), "output", "left_anti")


def multiview_tasks(captions: DataFrame, listing: DataFrame, views: DataFrame, inputs: DataFrame, done: DataFrame, need_lidar: bool = False) -> DataFrame:
    """The same for all views of a clip at once; inputs: clip_id of the clips whose input view exists."""
    full = complete_views(listing, views, ["hdmap", *(["lidar"] if need_lidar else [])])
    t = captions.join(full, "clip_id").join(inputs.select("clip_id"), "clip_id", "left_semi")
    t = t.withColumn("output", F.concat_ws("_", "clip_id", "variation"))
    return t.join(done.select("output").distinct(), "output", "left_anti")


def caption_tasks(captions: DataFrame, done: DataFrame, kinds: Sequence[str] = REWRITES) -> DataFrame:
    """Rewriting tasks of the clips without output."""
    return variation_tasks(captions.join(done.select("clip_id").distinct(), "clip_id", "left_anti"), kinds)


def rewritten(responses: DataFrame) -> DataFrame:
    """(clip_id, variation, text) from responses: the caption after the marker, cleaned; unusable ones are left out."""
    text = cleaned_caption(after_marker(without_thinking(F.col("response"))))
    return responses.select("clip_id", "variation", text.alias("text")).filter("text IS NOT NULL")


def embedding_tasks(captions: DataFrame, videos: DataFrame, done: DataFrame, views: Sequence[str] = tuple(PREFIXES)) -> DataFrame:
    """(view, key, chunk, prompt, path) still to be embedded. captions: view, key, text; videos: view, stem, path; done: view, key."""
    v = videos.withColumn("key", video_key(F.col("stem"))).groupBy("view", "key").agg(F.min_by("stem", "path").alias("stem"), F.min("path").alias("path"))
    prefix = F
    for name in views:
        prefix = prefix.when(F.col("view") == name, F.lit(PREFIXES[name]))
    t = captions.join(v, ["view", "key"]).join(done.select("view", "key").distinct(), ["view", "key"], "left_anti")
    return t.select("view", "key", chunk_suffix(F.col("stem")).alias("chunk"), F.concat_ws(" ", prefix, "text").alias("prompt"), "path")


def shuffled(clips: DataFrame, seed: int = 0) -> DataFrame:
    """Clips with `ord`, their place (0, 1, ...) in an order that a seed decides. A place is a column, as rows have no order that lasts."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("clip_id").cast("string")))
    return ranks.numbered(clips, [key, F.col("clip_id")], out="ord")
