"""Tracked objects: classes, cleaning of static tracks, and interpolation between labelled frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.functions import mat
from scenetables.operators.resample import bracket

TRACK = ("clip_id", "track_id")
OUTLIER_COSINE = 0.7
MOVING_SPEED = 0.2
#: Labels that are drawn under another class.
CLASSES = {
    "Car": ("Car", "Vehicle", "Automobile", "Other_vehicle"),
    "Truck": ("Truck", "Bus", "Heavy_truck", "Train_or_tram_car", "Trolley_bus", "Trailer"),
    "Pedestrian": ("Pedestrian", "Person"),
    "Cyclist": ("Cyclist", "Rider"),
}
RECORD_TYPES = {"vehicle": "Car", "pedestrian": "Pedestrian", "cyclist": "Cyclist"}


def drawn_class(object_type: Column) -> Column:
    """Car, Truck, Pedestrian, Cyclist, or Others for any other label and null."""
    out = F
    for cls, names in CLASSES.items():
        out = out.when(object_type.isin(*names), F.lit(cls))
    return out.otherwise(F.lit("Others"))


def record_objects(records: DataFrame) -> DataFrame:
    """objects from labels (clip_id, frame, track_id, type, synced, heading, cx, cy, cz, l, w, h, vx, vy, vz, vehicle_m).

    Other types and labels without a synced box are left out; frames go onto the three times finer index."""
    r = records.filter(F.col("type").isin(*RECORD_TYPES) & F.col("synced"))
    kind = F
    for name, cls in RECORD_TYPES.items():
        kind = kind.when(F.col("type") == name, F.lit(cls))
    moving = mat.norm([F.col("vx"), F.col("vy"), F.col("vz")]) > MOVING_SPEED
    centre = [F.col("cx"), F.col("cy"), F.col("cz")]
    return r.select("clip_id", (F.col("frame") * 3).alias("frame"), "track_id", kind.alias("object_type"), moving.alias("is_moving"), F.array("l", "w", "h").alias("lwh"), mat.heading_pose("vehicle_m", F.col("heading"), centre).alias("m"))


def _with_track(objects: DataFrame, of_track: DataFrame) -> DataFrame:
    """objects with the columns of their track's row, null where it has none. The means are summed before the shuffle, so a long track
    is no task of its own; as a join key Spark can split it."""
    t = of_track.withColumnsRenamed({k: f"__{k}" for k in TRACK})
    on = [objects[k].eqNullSafe(t[f"__{k}"]) for k in TRACK]
    return objects.join(t, on[0] & on[1], "left").drop(*(f"__{k}" for k in TRACK))


def static_sizes(objects: DataFrame) -> DataFrame:
    """The mean size of a track's rows that do not move, in those rows; moving rows keep theirs."""
    still = objects.filter("NOT is_moving").groupBy(*TRACK).agg(F.array(*(F.avg(F.col("lwh")[i]) for i in range(3))).alias("__lwh"))
    o = _with_track(objects, still)
    return o.withColumn("lwh", F.when(~F.col("is_moving"), F.col("__lwh")).otherwise(F.col("lwh"))).drop("__lwh")


def static_poses(objects: DataFrame) -> DataFrame:
    """One robust pose for a track's rows that do not move.

    Rows whose heading is within OUTLIER_COSINE of the mean heading count. Each is made a rotation; translation, front and
    up are averaged, front and up normalised, and left is up x front, normalised (up is not made orthogonal again).
    A track whose rows all are outliers keeps its poses."""
    still = objects.filter("NOT is_moving").select(*TRACK, "m", F.array(*mat.heading("m")).alias("__h"))
    mean = still.groupBy(*TRACK).agg(F.array(*(F.avg(F.col("__h")[i]) for i in range(3))).alias("__mean"))
    near = mat.dot(mat.vec("__h"), mat.unit(mat.vec("__mean"))) > OUTLIER_COSINE
    kept = _with_track(still, mean).filter(near).select(*TRACK, mat.nearest_rotation("m").alias("__r"))
    a = kept.groupBy(*TRACK).agg(F.array(*(F.avg(F.col("__r")[i]) for i in (3, 7, 11, 0, 4, 8, 2, 6, 10))).alias("__a"))
    front, up = mat.unit([F.col("__a")[i] for i in (3, 4, 5)]), mat.unit([F.col("__a")[i] for i in (6, 7, 8)])
    a = a.withColumn("__f", F.array(*front)).withColumn("__u", F.array(*up))
    left = mat.unit(mat.cross(mat.vec("__u"), mat.vec("__f")))
    a = a.select(*TRACK, mat.from_axes(mat.vec("__f"), left, mat.vec("__u"), [F.col("__a")[i] for i in range(3)]).alias("__robust"))
    return _with_track(objects, a).withColumn("m", F.when(~F.col("is_moving"), F.coalesce("__robust", "m")).otherwise(F.col("m"))).drop("__robust")


def clean_static(objects: DataFrame) -> DataFrame:
    """Sizes and poses of tracks' still rows, made one. All joins and sums share the partitioning by clip and track."""
    return static_poses(static_sizes(objects))


def interpolate_objects(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """objects at the render frames (clip_id, frame).

    A labelled frame passes through. Between two labelled frames of a clip, tracks present in both are interpolated (size
    by lerp, pose by lerp and slerp; type and flag from the earlier one) and others vanish. After the last labelled frame
    its objects are copied; labels past the last render frame are not used. A frame before the first label has none."""
    end = frames.groupBy("clip_id").agg(F.max("frame").alias("__end"))
    used = objects.join(end, "clip_id").filter("frame <= __end").drop("__end")
    b = bracket(frames.select("clip_id", "frame").distinct(), used.select("clip_id", "frame"), ["clip_id"]).filter("prev IS NOT NULL")
    before = used.select("clip_id", F.col("frame").alias("prev"), "track_id", "object_type", "is_moving", "lwh", "m")
    after = used.select("clip_id", F.col("frame").alias("next"), "track_id", F.col("lwh").alias("__lwh"), F.col("m").alias("__m"))
    alone = F.col("next").isNull() | (F.col("prev") == F.col("next"))
    copied = b.filter(alone).join(before, ["clip_id", "prev"])
    mixed = b.filter(~alone).join(before, ["clip_id", "prev"]).join(after, ["clip_id", "next", "track_id"])
    t = (F.col("frame") - F.col("prev")) / (F.col("next") - F.col("prev"))
    size = F.zip_with("lwh", "__lwh", lambda x, y: x + (y - x) * t)
    mixed = mat.with_interpolated_pose(mixed, "m", "__m", t, "__pose")
    names = ["clip_id", "frame", "track_id", "object_type", "is_moving"]
    return copied.select(*names, "lwh", "m").unionByName(mixed.select(*names, size.alias("lwh"), F.col("__pose").alias("m")))


def unlabelled_frames(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """(clip_id, n): render frames before the first label, for which interpolate_objects() has no rows."""
    first = objects.groupBy("clip_id").agg(F.min("frame").alias("first"))
    return frames.join(first, "clip_id", "left").filter("first IS NULL OR frame < first").groupBy("clip_id").agg(F.count("*").alias("n"))


def objects_at(objects: DataFrame, frames: DataFrame, every: int = 3) -> DataFrame:
    """Objects of the labelled frame at or before each frame, labels being on multiples of `every`."""
    f = frames.select("clip_id", "frame", (F.floor(F.col("frame") / every) * every).cast("int").alias("__label"))
    o = objects.withColumnRenamed("frame", "__label")
    return f.join(o, ["clip_id", "__label"]).drop("__label")
