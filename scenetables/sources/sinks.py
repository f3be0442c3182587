"""Writing scene tables: Parquet by clip bucket, samples as tar files, caption maps, resumable writes and reports."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a bucket of clips, a task and a file hold, in bytes of rows before compression.
BUCKET_BYTES, TASK_BYTES, FILE_BYTES = 4 << 30, 512 << 20, 1 << 30
MOST_BUCKETS = 1 << 16


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: widths of numbers, lengths of texts and of what arrays, maps and structs hold as text."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = F.size(c) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(c))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


class Layout(NamedTuple):
    buckets: int
    tasks: int
    rows_per_file: int


def layout(df: DataFrame, buckets: int | None = None) -> Layout:
    """Buckets, tasks and rows a file for df, from its measured bytes: one pass over the rows. Rows added to a folder later need the buckets of its first rows."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    least = 1 << max(0, (max(1, -(-size // BUCKET_BYTES)) - 1).bit_length())
    return Layout(buckets or min(MOST_BUCKETS, least), max(1, -(-size // TASK_BYTES)), max(1, FILE_BYTES * n // max(1, size)))


def _write(df: DataFrame, path: str, by: Sequence[str], within: Sequence[str], mode: str, buckets: int | None) -> Layout:
    """Parquet partitioned by `by` and bucket. Tasks take ranges of (by, bucket, clip, within) of about equal size, so a bucket has as many writers as it needs, a
    clip's rows lie together in order, and a task meets few buckets; a clip that is larger than a task is cut by `within`."""
    plan = layout(df, buckets)
    b = df.withColumn("bucket", F.pmod(F.xxhash64("clip_id"), F.lit(plan.buckets)).cast("int"))
    order = [*by, "bucket", "clip_id", *within]
    b = b.repartitionByRange(plan.tasks, *order).sortWithinPartitions(*order)
    b.write.mode(mode).option("maxRecordsPerFile", plan.rows_per_file).partitionBy(*by, "bucket").parquet(path)
    return plan


def write_scene(df: DataFrame, path: str, buckets: int | None = None, mode: str = "append") -> Layout:
    """Parquet partitioned by a hash bucket of the clip, so that a clip's rows lie together; buckets, tasks and files go by the measured size."""
    return _write(df, path, [], [c for c in ("camera", "frame", "point_id", "feature_id", "track_id") if c in df.columns], mode, buckets)


def remaining(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of wanted whose key has no output yet: what a resumed run has to do."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def variation_maps(captions: DataFrame) -> DataFrame:
    """(clip_id, json): the variations of a clip as one JSON object."""
    m = captions.groupBy("clip_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variation", "text")))).alias("m"))
    return m.select("clip_id", F.to_json("m").alias("json"))


def success_report(results: DataFrame) -> DataFrame:
    """n_ok, n_failed and all_ok of results(key, ok); a null counts as a failure."""
    bad = ~F.coalesce("ok", F.lit(False))
    return results.agg(F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_failed"), (F.count_if(bad) == 0).alias("all_ok"))


def failures(results: DataFrame) -> DataFrame:
    """The keys that failed, as rows: their number has no bound."""
    return results.filter(~F.coalesce("ok", F.lit(False))).select("key")


def sample_tars(members: DataFrame) -> DataFrame:
    """(clip_id, tar): the members (clip_id, name, bytes) of each clip as one tar file, in the order of their names. For tools
    that read tar files; a clip is bounded by its recording, and must fit in a task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        clip = pdf["clip_id"].iloc[0]
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, content in sorted(zip(pdf["name"], pdf["bytes"])):
                info = tarfile.TarInfo(f"{clip}.{name}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pd.DataFrame([(clip, out.getvalue())], columns=["clip_id", "tar"])

    return members.select("clip_id", "name", "bytes").groupBy("clip_id").applyInPandas(pack, "clip_id string, tar binary")


@F.pandas_udf(T.BinaryType())
def npy_bytes(items: pd.Series, shapes: pd.Series) -> pd.Series:
    """.npy files of arrays of doubles, row by row, in the shapes given."""
    import numpy as np

    def one(x, shape) -> bytes | None:
        if x is None:
            return None
        out = io.BytesIO()
        np.save(out, np.asarray(x, dtype=float).reshape(tuple(shape)))
        return out.getvalue()

    return pd.Series([one(x, s) for x, s in zip(items, shapes)], dtype=object)


def pose_members(poses: DataFrame) -> DataFrame:
    """(clip_id, name, bytes): camera poses (clip_id, camera, frame, m) as members that sources.scene.camera_poses() reads."""
    name = F.concat(F.format_string("%06d.pose.", "frame"), "camera", F.lit(".npy"))
    return poses.select("clip_id", name.alias("name"), npy_bytes("m", F.array(F.lit(4), F.lit(4))).alias("bytes"))


def intrinsic_members(intrinsics: DataFrame, model: str) -> DataFrame:
    """(clip_id, name, bytes): intrinsic vectors (clip_id, camera, values) of a model, pinhole or ftheta."""
    name = F.concat(F.lit(f"{model}_intrinsic."), F.col("camera"), F.lit(".npy"))
    return intrinsics.select("clip_id", name.alias("name"), npy_bytes("values", F.array(F.size("values"))).alias("bytes"))


def object_members(objects: DataFrame) -> DataFrame:
    """(clip_id, name, bytes): objects as one JSON member for each frame, as sources.scene.objects() reads them."""
    o = F.struct(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("m", i * 4 + 1, 4)).alias("object_to_world"), F.col("lwh").alias("object_lwh"), F.col("is_moving").alias("object_is_moving"), "object_type")
    g = objects.groupBy("clip_id", "frame").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track_id", o.alias("o")))))).alias("j"))
    return g.select("clip_id", F.format_string("%06d.all_object_info.json", "frame").alias("name"), F.col("j").cast("binary").alias("bytes"))


def settings(text: str, post_training: bool | None = None) -> dict:
    """Settings of a dataset, with MAX_CHUNK -1 where it is missing. post_training lays the section of that mode over the common ones; a
    dataset without the section is an error."""
    common = json.loads(text)
    if post_training is None:
        return {"MAX_CHUNK": -1} | common
    mode = "POST_TRAINING" if post_training else "NOT_POST_TRAINING"
    return {"MAX_CHUNK": -1} | {k: v for k, v in common.items() if not k.endswith("POST_TRAINING")} | common[mode]


def write_embeddings(rows: DataFrame, path: str, buckets: int | None = None, mode: str = "append") -> Layout:
    """Captions and their embeddings (view, clip_id, chunk, text, embedding, ...) as Parquet by view and clip bucket, with `name`, the clip and the chunk
    that follows it; a clip's chunks lie together, sorted. remaining() on (view, name) tells what a resumed run has to do."""
    return _write(rows.withColumn("name", F.concat("clip_id", "chunk")), path, ["view"], ["chunk"], mode, buckets)
