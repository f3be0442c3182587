"""Whole jobs on scene tables: conversion, rendering and chunk selection, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetables.functions import mat
from scenetables.operators import objects as obj
from scenetables.operators import points, raster, resample
from scenetables.sources import scene, scratch


def camera_tracks(vehicle: DataFrame, extrinsics: DataFrame) -> DataFrame:
    """(clip_id, camera, frame, m) in image axes: the vehicle's pose times the camera's place on it. Extrinsics are those of
    the clip's first frame, a few rows for each clip; Spark broadcasts them where they are small."""
    e = extrinsics.select("clip_id", "camera", F.col("m").alias("em"))
    moved = vehicle.join(e, "clip_id").select("clip_id", "camera", "frame", mat.mat_mul("m", "em").alias("m"))
    return moved.select("clip_id", "camera", "frame", mat.flu_to_opencv("m").alias("m"))


def converted(vehicle: DataFrame, extrinsics: DataFrame, calibrations: DataFrame, features: DataFrame, labels: DataFrame, times: DataFrame) -> dict[str, DataFrame]:
    """Scene tables from decoded vehicle records at 10 Hz: tracks go to 30 Hz (three frames for each record), objects and
    timestamps onto the same index."""
    def at_30_hz(p: DataFrame, keys: Sequence[str]) -> DataFrame:
        return resample.extrapolate_poses(resample.upsample_poses(p, keys), keys)

    return {
        "camera_pose": at_30_hz(camera_tracks(vehicle, extrinsics), ["clip_id", "camera"]),
        "vehicle_pose": at_30_hz(vehicle, ["clip_id"]),
        "intrinsics": scene.record_intrinsics(calibrations),
        "map_features": scene.record_map_features(features),
        "objects": obj.record_objects(labels),
        "timestamps": scene.record_timestamps(times),
    }


def rendered_frames(camera_pose: DataFrame, settings: dict) -> DataFrame:
    """(clip_id, camera, frame, pos) to render, by the dataset's rates and chunk settings."""
    return resample.render_frames(camera_pose, ["clip_id", "camera"], settings["INPUT_POSE_FPS"], settings["TARGET_RENDER_FPS"], settings["TARGET_CHUNK_FRAME"], settings["OVERLAP_FRAME"], settings["MAX_CHUNK"])


def _cameras(camera_pose: DataFrame, intrinsics: DataFrame, settings: dict) -> tuple[DataFrame, DataFrame]:
    """The cameras to render, with their poses and models, as a scratch table, and their (clip_id, camera, frame, pos)."""
    wanted = rendered_frames(camera_pose, settings)
    cameras = scratch.stored(wanted.join(camera_pose, ["clip_id", "camera", "frame"]).join(intrinsics, ["clip_id", "camera"]), "cameras")
    return cameras, cameras.select("clip_id", "camera", "frame", "pos")


def rendered_map(camera_pose: DataFrame, intrinsics: DataFrame, objects: DataFrame, features: DataFrame, settings: dict, w: int, h: int) -> DataFrame:
    """(clip_id, camera, chunk, pos, u, v, r, g, b): the map condition of every chunk. Objects are cleaned and interpolated
    once for a clip, not for each camera. Cameras and objects, which several joins read, are written to the scratch folder first."""
    cameras, frames = _cameras(camera_pose, intrinsics, settings)
    moving = scratch.stored(obj.interpolate_objects(obj.clean_static(objects), frames.select("clip_id", "frame").distinct()), "objects")
    pixels = raster.hdmap_condition(features, moving, cameras, w, h)
    chunks = resample.chunked(frames, ["clip_id", "camera"], settings["TARGET_CHUNK_FRAME"], settings["OVERLAP_FRAME"])
    return pixels.join(chunks, ["clip_id", "camera", "frame"]).select("clip_id", "camera", "chunk", "pos", "u", "v", "r", "g", "b")


def rendered_lidar(camera_pose: DataFrame, intrinsics: DataFrame, objects: DataFrame, lidar: DataFrame, sweeps: DataFrame, settings: dict, w: int, h: int) -> DataFrame:
    """(clip_id, camera, chunk, pos, u, v, grey): the LiDAR condition of every chunk. Cameras are written to the scratch folder first."""
    cameras, frames = _cameras(camera_pose, intrinsics, settings)
    every = frames.select("clip_id", "frame").unionByName(sweeps.select("clip_id", "frame")).distinct()
    moving = obj.interpolate_objects(obj.clean_static(objects), every)
    pixels = points.lidar_condition(lidar, sweeps, moving, frames.select("clip_id", "frame").distinct(), cameras, w, h)
    chunks = resample.chunked(frames, ["clip_id", "camera"], settings["TARGET_CHUNK_FRAME"], settings["OVERLAP_FRAME"])
    return pixels.join(chunks, ["clip_id", "camera", "frame"]).select("clip_id", "camera", "chunk", "pos", "u", "v", "grey")


def video_chunks(videos: DataFrame, settings: dict) -> DataFrame:
    """(clip_id, camera, chunk, pos, frame) of camera videos (clip_id, camera, n_frames) cut like the rendered ones."""
    f = videos.withColumn("last", F.col("n_frames") - 1).select("clip_id", "camera", F.explode(F.expr("sequence(0, last)")).alias("frame"))
    return resample.chunked(rendered_frames(f, settings), ["clip_id", "camera"], settings["TARGET_CHUNK_FRAME"], settings["OVERLAP_FRAME"])
