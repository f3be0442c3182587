"""Scene files as tables.

A dataset is a folder per attribute with a tar file per clip; a member's name is `{clip_id}.{field}.{ext}`. Every reader
gives rows, and Spark opens the files, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OBJECT = "map<string, struct<object_to_world: array<array<double>>, object_lwh: array<double>, object_is_moving: boolean, object_type: string>>"
_VERTEX = "array<array<double>>"
_SHAPES = f"struct<labels: array<struct<labelData: struct<shape3d: struct<polyline3d: struct<vertices: {_VERTEX}>, surface: struct<vertices: {_VERTEX}>, cuboid3d: struct<vertices: array<struct<x:double,y:double,z:double>>, center: struct<x:double,y:double,z:double>, orientation: struct<x:double,y:double,z:double>, dimensions: struct<x:double,y:double,z:double>>>>>>>"
#: Record kinds of map features, their layer and the field that holds their vertices.
RECORD_LAYERS = (
    ("lane", "lanes", "polyline"),
    ("road_line", "lanelines", "polyline"),
    ("road_edge", "road_boundaries", "polyline"),
    ("crosswalk", "crosswalks", "polygon"),
)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, clip_id, ext, bytes, mtime of every file under root; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    return f.select("path", folder.alias("folder"), F.split_part(name, F.lit("."), F.lit(1)).alias("clip_id"), F.element_at(F.split(name, r"\."), -1).alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def in_folders(listing: DataFrame, common: list[str], types: dict[str, list[str]], wanted: list[str]) -> DataFrame:
    """Files of the common folders and of those of the wanted types; an unknown type is an error."""
    unknown = sorted(set(wanted) - set(types))
    if unknown:
        raise ValueError(f"unknown types: {', '.join(unknown)}")
    return listing.filter(F.col("folder").isin(sorted({*common, *(f for t in wanted for f in types[t])})))


def tar_members(tars: DataFrame) -> DataFrame:
    """(clip_id, field, ext, frame, bytes) of the members of the first sample of each tar. tars: rows of binaryFile.

    A sample's key is its members' name up to the first dot; frame is the number that a field begins with, or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(_members(io.BytesIO(content)), columns=["clip_id", "field", "ext", "bytes"])

    m = tars.select("content").mapInPandas(run, "clip_id string, field string, ext string, bytes binary")
    return m.withColumn("frame", F.expr("try_cast(nullif(regexp_extract(field, '^(\\\\d+)', 1), '') as int)"))


def _members(stream) -> Iterator[tuple]:
    first = None
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for member in tar:
            if not member.isfile():
                continue
            key, _, rest = member.name.rsplit("/", 1)[-1].partition(".")
            first = first or key
            if key != first:
                return
            field, _, ext = rest.rpartition(".")
            yield key, field, ext, tar.extractfile(member).read()


def read_tars(spark: SparkSession, root: str, folder: str) -> DataFrame:
    return tar_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(f"{root}/{folder}"))


def _npy(content: bytes) -> list[float]:
    import numpy as np

    return np.load(io.BytesIO(content)).astype(float).ravel().tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def npy_items(contents: pd.Series) -> pd.Series:
    """The items of .npy arrays, row by row."""
    return contents.map(lambda c: None if c is None else _npy(c))


def camera_poses(members: DataFrame, camera: str | None = None) -> DataFrame:
    """(clip_id, camera, frame, m) from the fields `{frame}.pose.{camera}`, or of one camera."""
    name = F.regexp_extract("field", r"^\d+\.pose\.(.+)$", 1)
    p = members.filter("ext = 'npy'").withColumn("camera", name).filter("camera <> ''")
    p = p.filter(F.col("camera") == camera) if camera else p
    return p.select("clip_id", "camera", "frame", npy_items("bytes").alias("m"))


def vehicle_poses(members: DataFrame) -> DataFrame:
    p = members.filter(r"ext = 'npy' AND field RLIKE '^\\d+\\.vehicle_pose$'")
    return p.select("clip_id", "frame", npy_items("bytes").alias("m"))


def objects(members: DataFrame) -> DataFrame:
    """(clip_id, frame, track_id, object_type, is_moving, lwh, m) from `{frame}.all_object_info.json`."""
    j = members.filter("ext = 'json' AND field LIKE '%.all_object_info'").select("clip_id", "frame", F.explode(F.from_json(F.col("bytes").cast("string"), _OBJECT)).alias("track_id", "o"))
    return j.filter("NOT startswith(track_id, '__')").select("clip_id", "frame", "track_id", F.col("o.object_type").alias("object_type"), F.col("o.object_is_moving").alias("is_moving"), F.col("o.object_lwh").alias("lwh"), F.flatten("o.object_to_world").alias("m"))


def timestamps(members: DataFrame) -> DataFrame:
    t = members.filter("ext = 'txt' AND field LIKE '%.timestamp_micros'")
    return t.select("clip_id", "frame", F.timestamp_micros(F.trim(F.col("bytes").cast("string")).cast("long")).alias("ts"))


def pinhole_intrinsics(members: DataFrame) -> DataFrame:
    """(clip_id, camera, model, fx, fy, cx, cy, w, h) from `pinhole_intrinsic.{camera}`."""
    i = members.filter("ext = 'npy' AND startswith(field, 'pinhole_intrinsic.')").select("clip_id", F.split_part("field", F.lit("."), F.lit(2)).alias("camera"), npy_items("bytes").alias("x"))
    return i.select("clip_id", "camera", F.lit("pinhole").alias("model"), *(F.col("x")[k].alias(n) for k, n in enumerate(("fx", "fy", "cx", "cy"))), *(F.col("x")[k].cast("int").alias(n) for k, n in ((4, "w"), (5, "h"))))


def ftheta_intrinsics(members: DataFrame) -> DataFrame:
    """(clip_id, camera, values) from `ftheta_intrinsic.{camera}`: vectors of 11 or 14 floats, for with_default_intrinsics() and camera.ftheta_models()."""
    i = members.filter("ext = 'npy' AND startswith(field, 'ftheta_intrinsic.')")
    return i.select("clip_id", F.substring_index("field", "ftheta_intrinsic.", -1).alias("camera"), npy_items("bytes").alias("values"))


def with_default_intrinsics(cameras: DataFrame, own: DataFrame, rig: DataFrame, names: DataFrame) -> DataFrame:
    """cameras(clip_id, camera) with their own intrinsics, or those of the default rig under the camera's name there.

    own: clip_id, camera, values; rig: camera, values; names: camera, rig_camera. rig and names are dimension tables, a row for each
    camera of a rig, and are broadcast as such. values stay null where neither is known, so that such cameras can be reported."""
    r = names.join(rig.withColumnsRenamed({"camera": "rig_camera", "values": "__default"}), "rig_camera", "left").select("camera", "__default")
    out = cameras.join(own, ["clip_id", "camera"], "left").join(F.broadcast(r), "camera", "left")
    return out.select("clip_id", "camera", F.coalesce("values", "__default").alias("values"), (F.col("values").isNull() & F.col("__default").isNotNull()).alias("is_default"))


def map_features(layers: DataFrame) -> DataFrame:
    """(clip_id, layer, feature_id, geom_type, vertices) from layer JSON (clip_id, layer, json) of the documented shapes, in
    document order; raw cuboids become vertices."""
    from scenetables.operators.geometry import cuboid_vertices

    f = layers.select("clip_id", "layer", F.posexplode(F.from_json("json", _SHAPES)["labels"]).alias("feature_id", "l")).select("clip_id", "layer", "feature_id", F.col("l.labelData.shape3d").alias("s"))
    flat = lambda c: F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z")))
    box = F.col("s.cuboid3d")
    kind = F.when(F.col("s.polyline3d").isNotNull(), "polyline").when(F.col("s.surface").isNotNull(), "polygon").when(box.isNotNull(), "cuboid3d")
    made = F.when(F.col("s.polyline3d").isNotNull(), flat(F.col("s.polyline3d.vertices"))).when(F.col("s.surface").isNotNull(), flat(F.col("s.surface.vertices"))).when(box["vertices"].isNotNull(), box["vertices"]).when(box.isNotNull(), cuboid_vertices(box["center"], box["orientation"], box["dimensions"]))
    return f.select("clip_id", "layer", "feature_id", kind.alias("geom_type"), made.alias("vertices")).filter("vertices IS NOT NULL")


def vertices_anywhere(layers: DataFrame) -> DataFrame:
    """(clip_id, layer, path, vertices) of every value named `vertices` in JSON (clip_id, layer, json) of unknown nesting."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def walk(node, path: str) -> Iterator[tuple[str, list]]:
            if isinstance(node, dict):
                for k, v in node.items():
                    if k == "vertices":
                        yield path, v
                    else:
                        yield from walk(v, f"{path}.{k}")
            elif isinstance(node, list):
                for k, v in enumerate(node):
                    yield from walk(v, f"{path}[{k}]")

        for b in batches:
            rows = [(c, layer, path, [[float(p[a]) for a in "xyz"] if isinstance(p, dict) else list(map(float, p)) for p in v]) for c, layer, text in zip(b["clip_id"], b["layer"], b["json"]) for path, v in walk(json.loads(text), "$")]
            yield pd.DataFrame(rows, columns=["clip_id", "layer", "path", "vertices"])

    return layers.select("clip_id", "layer", "json").mapInPandas(run, f"clip_id string, layer string, path string, vertices {_VERTEX}")


def record_map_features(records: DataFrame) -> DataFrame:
    """map_features from the first frame of vehicle records (clip_id, frame, kind, polyline, polygon): kinds are renamed to
    layers; others, such as speed bumps and driveways, are left out. Array order is document order."""
    first = records.groupBy("clip_id").agg(F.min("frame").alias("frame"))
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(layer).alias("layer"), F.lit(t).alias("geom_type")) for k, layer, t in RECORD_LAYERS))
    dim = records.sparkSession.range(1, numPartitions=1).select(F.inline(names))
    r = records.join(first, ["clip_id", "frame"]).join(F.broadcast(dim), "kind")
    return r.select("clip_id", "layer", "feature_id", "geom_type", F.when(F.col("geom_type") == "polyline", F.col("polyline")).otherwise(F.col("polygon")).alias("vertices"))


def record_intrinsics(calibrations: DataFrame) -> DataFrame:
    """(clip_id, camera, v): [fx, fy, cx, cy, w, h] of the first frame, camera names in lower case."""
    first = calibrations.groupBy("clip_id").agg(F.min("frame").alias("frame"))
    c = calibrations.join(first, ["clip_id", "frame"])
    return c.select("clip_id", F.lower("name").alias("camera"), F.array(*(F.col(n).cast("double") for n in ("fx", "fy", "cx", "cy", "w", "h"))).alias("v"))


def record_timestamps(records: DataFrame) -> DataFrame:
    """(clip_id, frame, ts): microseconds of 10 Hz records on the 30 Hz index, not interpolated."""
    return records.select("clip_id", (F.col("frame") * 3).alias("frame"), F.timestamp_micros("micros").alias("ts"))


def lidar_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lidar_points (clip_id, frame, point_id, x, y, z) and lidar_sweeps (clip_id, frame, m) of what tars.read_lidar() reads."""
    p = raw.select("clip_id", "frame", F.posexplode("points").alias("point_id", "p"))
    return p.select("clip_id", "frame", F.col("point_id").cast("long").alias("point_id"), *(F.col("p")[i].alias(c) for i, c in enumerate("xyz"))), raw.select("clip_id", "frame", "m")


def captions(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(clip_id, text): a file for each clip whose name ends with the suffix (for the first chunks alone: "_0.txt")."""
    t = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return t.filter(F.col("name").endswith(suffix)).select(F.expr(f"substring(name, 1, length(name) - {len('.txt')})").alias("clip_id"), "text")


def variations(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, variation, text) of JSON objects; the clip is the file's name up to its first dot."""
    t = spark.read.text(folder, wholetext=True).select(F.split_part(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit("."), F.lit(1)).alias("clip_id"), "value")
    return t.select("clip_id", F.explode(F.from_json("value", "map<string,string>")).alias("variation", "text"))


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of headerless CSV files, of any widths, with the keys in the first row and the captions in the second. A file is read whole by one task."""
    t = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            for text in b["value"]:
                rows = csv.reader(io.StringIO(text, newline=""))
                yield pd.DataFrame(list(zip(next(rows, []), next(rows, []))), columns=["key", "text"], dtype=object)

    return t.mapInPandas(run, "key string, text string").filter("key <> ''")


def multiview_captions(texts: DataFrame, views: DataFrame) -> DataFrame:
    """(clip_id, view, text) from JSON objects (json) whose keys are `{clip}_{view}`; keys of no known view are left out. A key meets the views by its endings after an
    underscore; a view's name may end with another's, and then the longest one counts."""
    m = texts.select(F.explode(F.from_json("json", "map<string,string>")).alias("k", "text"))
    at = F.explode(F.sequence(F.lit(1), F.size(F.split("k", "_")) - 1)).alias("n")
    ends = m.select("k").distinct().filter(F.contains("k", F.lit("_"))).select("k", at).select("k", F.expr("substring_index(k, '_', -n)").alias("view"))
    best = ends.join(views.select("view").distinct(), "view").groupBy("k").agg(F.max_by("view", F.length("view")).alias("view"))
    return m.join(best, "k").select(F.expr("substring(k, 1, length(k) - length(view) - 1)").alias("clip_id"), "view", "text")


def clip_list(spark: SparkSession, json_path: str | None = None, clip: str | None = None, listing: DataFrame | None = None, folder: str = "pose") -> DataFrame:
    """(clip_id) from a JSON array, a literal id, or the tar files of a folder in a listing. Use it in a left-semi join."""
    if clip is not None:
        return spark.range(1, numPartitions=1).select(F.lit(clip).alias("clip_id"))
    if json_path is not None:
        t = spark.read.text(json_path, wholetext=True)
        return t.select(F.explode(F.from_json("value", "array<string>")).alias("clip_id")).distinct()
    if listing is None:
        raise ValueError("a clip list needs a JSON path, a clip or a listing")
    return listing.filter((F.col("folder") == folder) & (F.col("ext") == "tar")).select("clip_id").distinct()
