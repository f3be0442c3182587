"""Queries on boxes, poses, cameras, clips of lines and rasters by both camera models, from vectors of the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import geometry, objects, points, raster, resample
from scenetables.plans.scene_queries import _BOX, _V, _boxes, _points, _vectors, cut_sql

W, H = 64, 48
BEV = 80
LAYERS = ("crosswalks", "poles", "lanelines")
#: Coefficients of the f-theta cameras here: forward (angle to pixels), backward (pixels to angle), and the linear part.
FW, BW, LIN = (0, 30, 0, 1.5, 0, -0.2), (0, 0.02, 0, 0.000004), (1.1, 0.02, -0.01)
EDGE = 1.2
#: Of the drive: metres from frame to frame, and quarters of that over which the map is strewn.
STEP, ROAD = 150.0, 24


def _r(c, n: int = 4):
    return F.round(c, n) + 0.0


def _xyz(p) -> list:
    return [_r(p[a]).alias(a) for a in "xyz"]


def _array(values) -> F.Column:
    return F.array(*map(mat.d, values))


def box_corners(spark, sf_dir):
    b = _boxes(_vectors(spark, sf_dir), 0)
    return b.select("clip_id", "track_id", F.posexplode(geometry.corners("lwh", "m")).alias("k", "p")).select("clip_id", "track_id", "k", *_xyz(F.col("p")))


def box_lines(spark, sf_dir):
    """Edges of the line through all edges of a box, and their length in all."""
    s = raster.object_segments(_boxes(_vectors(spark, sf_dir), 0))
    length = mat.norm([F.col("p1")[a] - F.col("p0")[a] for a in "xyz"])
    return s.groupBy("clip_id", F.col("prim_id").alias("track_id")).agg(F.count("*").alias("n"), _r(F.sum(length)).alias("length"))


def box_outlines(spark, sf_dir):
    b = _boxes(_vectors(spark, sf_dir), 0)
    axis = lambda i: F.array(*(F.col("m")[4 * j + i] for j in range(3)))
    v = geometry.box_outline(axis(0), axis(1), axis(2), axis(3), F.col("lwh"))
    return b.select("clip_id", "track_id", F.posexplode(v).alias("k", "p")).select("clip_id", "track_id", "k", *_xyz(F.col("p")))


def cuboid_vertices(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    of = lambda *names: F.struct(*(F.col(n).alias(a) for n, a in zip(names, "xyz")))
    size = F.struct(*((F.abs(n) + 1).alias(a) for n, a in zip(("e9", "e10", "e11"), "xyz")))
    c = geometry.cuboid_vertices(of("e0", "e1", "e2"), of("e3", "e4", "e5"), size)
    return v.select("clip_id", "id", F.posexplode(c).alias("k", "p")).select("clip_id", "id", "k", *_xyz(F.col("p")))


def _lines(v: DataFrame) -> DataFrame:
    """clip_id, vertices: a clip's vectors in their order."""
    f = v.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("r", *(F.col(f"e{i}").alias(a) for i, a in enumerate("xyz"))))).alias("p"))
    return f.select("clip_id", F.transform("p", lambda p: geometry.point(p["x"], p["y"], p["z"])).alias("vertices"))


def closed_rings(spark, sf_dir):
    """Edges and length of each clip's ring."""
    s = geometry.segments(_lines(_vectors(spark, sf_dir)).withColumn("vertices", geometry.closed("vertices")))
    length = mat.norm([F.col("p1")[a] - F.col("p0")[a] for a in "xyz"])
    return s.groupBy("clip_id").agg(F.count("*").alias("n"), _r(F.sum(length)).alias("length"))


def near_clipped_lines(spark, sf_dir):
    """Each clip's line as seen by a camera at the origin, without what is behind it."""
    f = _lines(_vectors(spark, sf_dir))
    p = f.select("clip_id", F.explode(geometry.near_plane_clipped("vertices")).alias("p"))
    return p.groupBy("clip_id").agg(F.count("*").alias("n"), *(_r(F.sum(F.col("p")[a])).alias(a) for a in "xyz"))


def near_clipped_segments(spark, sf_dir):
    s = geometry.segments(_lines(_vectors(spark, sf_dir)))
    a, b = geometry.segment_near_clip([F.col("p0")[c] for c in "xyz"], [F.col("p1")[c] for c in "xyz"])
    return s.select("clip_id", "seg_id", *(_r(x).alias(f"{e}_{n}") for e, p in (("a", a), ("b", b)) for x, n in zip(p, "xyz")))


def _tilted(v: DataFrame) -> DataFrame:
    m = mat.pose(mat.euler_zyx(F.col("e3"), F.col("e4") / 4, F.col("e5")), [F.col(f"e{i}") for i in range(3)])
    return v.select("clip_id", "id", "r", m.alias("m"))


def grounded_poses(spark, sf_dir):
    """Tilted poses laid flat, in either convention, the second at height 9."""
    p = _tilted(_vectors(spark, sf_dir))
    p = p.select("clip_id", "id", mat.grounded("m").alias("a"), mat.grounded(mat.flu_to_opencv("m"), mat.d(9), "opencv").alias("b"))
    return p.select("clip_id", "id", *(_r(F.col("a")[i]).alias(n) for n, i in (("cos", 0), ("sin", 4), ("x", 3), ("y", 7), ("z", 11))), *(_r(F.col("b")[i]).alias(n) for n, i in (("right_x", 0), ("forward_x", 2), ("height", 11))))


def pinhole_rays(spark, sf_dir):
    """Rays through pixels of a camera resized by half, and its fields of view."""
    v = _vectors(spark, sf_dir)
    k = camera.pinhole_rescale(F.abs("e0") + 20, F.abs("e1") + 21, mat.d(32), mat.d(24), F.lit(W), F.lit(H), mat.d(0.5), mat.d(0.5))
    v = v.select("clip_id", "id", "e2", "e3", *(c.alias(n) for c, n in zip(k, ("fx", "fy", "cx", "cy", "w", "h"))))
    ray = camera.pinhole_unproject(*(F.col(c) for c in ("fx", "fy", "cx", "cy")), F.col("e2") * 4, F.col("e3") * 4)
    fov = camera.pinhole_fov(F.col("fx"), F.col("fy"), F.col("w"), F.col("h"))
    return v.select("clip_id", "id", _r(ray[0]).alias("x"), _r(ray[1]).alias("y"), *(_r(c).alias(n) for c, n in zip(fov, ("fov_h", "fov_v"))))


def ftheta_rays(spark, sf_dir):
    """Rays through pixels of an f-theta camera."""
    v = _vectors(spark, sf_dir)
    ray, valid = camera.ftheta_unproject(_array(BW), _array(LIN), mat.d(32), mat.d(24), F.col("e0") * 8 + 32, F.col("e1") * 6 + 24)
    return v.select("clip_id", "id", *(_r(c, 6).alias(a) for c, a in zip(ray, "xyz")), valid.alias("valid"))


def ray_grid(spark, sf_dir):
    """Rays of the pixels of small cameras, one for each vector."""
    v = _vectors(spark, sf_dir)
    c = v.select("clip_id", F.col("id").alias("camera"), (F.abs("e0") + 2).alias("fx"), (F.abs("e1") + 2).alias("fy"), mat.d(2).alias("cx"), mat.d(1.5).alias("cy"), F.lit(4).alias("w"), F.lit(3).alias("h"))
    return camera.ray_grid(c).select("clip_id", "camera", "u", "v", *(_r(a).alias(a) for a in "xyz"))


def ftheta_vectors(spark, sf_dir):
    """f-theta vectors parsed, resized by half and written again, with the fields of view."""
    v = _vectors(spark, sf_dir)
    is_bw = F.when(F.col("id") % 2 == 0, mat.d(1)).otherwise(mat.d(0))
    x = F.array(F.col("e0") + 32, F.col("e1") + 24, mat.d(W), mat.d(H), mat.d(0), F.abs("e2") + 1, F.col("e3") / 10, *[mat.d(0)] * 3, is_bw)
    p = v.select("clip_id", "id", camera.parse_ftheta(x).alias("s"))
    s = F.col("s")
    new = camera.ftheta_rescale(s["poly"], s["is_bw"], s["cx"], s["cy"], s["w"], s["h"], mat.d(0.5), mat.d(0.5))
    p = p.withColumn("t", F.struct(*(c.alias(n) for c, n in zip(new, ("poly", "cx", "cy", "w", "h"))), s["is_bw"].alias("is_bw"), s["lin"].alias("lin")))
    out = p.withColumn("x", camera.ftheta_vector(F.col("t"))).withColumn("fov", F.struct(*(c.alias(n) for n, c in camera.ftheta_fov(_array(BW), _array(LIN), s["cx"], s["cy"], s["w"], s["h"]).items())))
    return out.select("clip_id", "id", *(_r(F.col("x")[i]).alias(f"x{i}") for i in range(14)), *(_r(F.col("fov")[n]).alias(f"fov_{n}") for n in ("h", "v", "max_angle")))


def _polynomials(v: DataFrame) -> DataFrame:
    """f-theta cameras, a polynomial of each vector: backward ones for even ids, forward ones for odd ids."""
    back = F.array(mat.d(0), mat.d(0.02) + F.abs("e0") / 1000, F.abs("e1") / 1e5, F.abs("e2") / 1e7, mat.d(0), mat.d(0))
    ahead = F.array(mat.d(0), 40 + F.abs("e0"), F.col("e1") / 10, 1 + F.abs("e2") / 10, mat.d(0), mat.d(0))
    is_bw = F.col("id") % 2 == 0
    return v.select("clip_id", F.col("id").alias("camera"), F.when(is_bw, back).otherwise(ahead).alias("poly"), is_bw.alias("is_bw"), _array((1, 0, 0)).alias("lin"), mat.d(31).alias("cx"), mat.d(25).alias("cy"), F.lit(W).alias("w"), F.lit(H).alias("h"))


def ftheta_calibration(spark, sf_dir):
    """Polynomials fitted the other way, and what lies at the image's edge."""
    c = camera.calibrate_ftheta(_polynomials(_vectors(spark, sf_dir)))
    at = lambda poly, x: camera.horner(F.col(poly), mat.d(x))
    return c.select("clip_id", "camera", *(_r(x, 3).alias(n) for n, x in (("ahead_1", at("fw", 0.1)), ("ahead_5", at("fw", 0.5)), ("max_angle", F.col("max_angle")), ("edge_r", F.col("edge_r")), ("edge_dr", F.col("edge_dr")))), *(_r(at("bw", x), 4).alias(f"back_{x}") for x in (5, 30)))


def slerp_track(spark, sf_dir):
    """Each clip's unit quaternions at every third frame, aligned and interpolated."""
    v = _vectors(spark, sf_dir)
    n = mat.norm([F.col(f"e{i}") for i in range(4)])
    q = v.select("clip_id", (F.col("r") * 3).alias("frame"), *((F.col(f"e{i}") / n).alias(c) for i, c in enumerate("wxyz")))
    spine = v.groupBy("clip_id").agg(F.max("r").alias("n")).select("clip_id", F.explode(F.expr("sequence(1, 3 * n + 2)")).alias("frame"))
    return resample.slerp_track(spine, q, ["clip_id"]).select("clip_id", "frame", *(_r(F.col(c)).alias(c) for c in "wxyz"))


def squad_track(spark, sf_dir):
    """The same by spherical quadrangles."""
    v = _vectors(spark, sf_dir)
    n = mat.norm([F.col(f"e{i}") for i in range(4)])
    q = v.select("clip_id", (F.col("r") * 3).alias("frame"), *((F.col(f"e{i}") / n).alias(c) for i, c in enumerate("wxyz")))
    spine = v.groupBy("clip_id").agg(F.max("r").alias("n")).select("clip_id", F.explode(F.expr("sequence(1, 3 * n + 2)")).alias("frame"))
    return resample.squad_track(spine, q, ["clip_id"]).select("clip_id", "frame", *(_r(F.col(c)).alias(c) for c in "wxyz"))


def pose_extrapolate(spark, sf_dir):
    """Each clip's yaw poses upsampled and carried on by two frames."""
    v = _vectors(spark, sf_dir)
    p = v.select("clip_id", (F.col("r") - 1).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col(f"e{i}") for i in range(3)]).alias("m"))
    out = resample.extrapolate_poses(resample.upsample_poses(p, ["clip_id"]), ["clip_id"])
    return out.select("clip_id", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in (("cos", 0), ("sin", 4), ("x", 3), ("y", 7), ("z", 11))))


def rig_expansion(spark, sf_dir):
    """A clip's poses as a front camera's track, carried to a side camera by their places at the clip's start."""
    v = _vectors(spark, sf_dir)
    m = mat.pose(mat.yaw(F.col("e3")), [F.col("e0"), F.col("e1"), mat.d(0)])
    track = v.filter("r > 2").select("clip_id", (F.col("r") - 2).alias("frame"), m.alias("m"))
    cams = v.filter("r <= 2").select("clip_id", F.when(F.col("r") == 1, "front").otherwise("side").alias("camera"), F.lit(0).alias("frame"), m.alias("m"))
    out = resample.expand_rig(track, cams, "front")
    return out.select("clip_id", "camera", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in (("cos", 0), ("sin", 4), ("x", 3), ("y", 7))))


def objects_at_labels(spark, sf_dir):
    """Boxes labelled at every third frame, at every frame."""
    v = _vectors(spark, sf_dir)
    o = _boxes(v, 0).drop("frame").join(v.select(F.col("id").cast("string").alias("track_id"), ((F.col("r") % 4) * 3).alias("frame")), "track_id")
    f = v.groupBy("clip_id").agg(F.max("r").alias("n")).select("clip_id", F.explode(F.expr("sequence(0, n)")).alias("frame"))
    return objects.objects_at(o, f).select("clip_id", "frame", "track_id", _r(F.col("m")[3]).alias("x"))


def world_points(spark, sf_dir):
    """Points of two returns of one sensor that are not near, carried into the world."""
    v = _vectors(spark, sf_dir)
    p = _points(v).withColumn("sensor", F.when(F.col("point_id") % 3 == 0, "SIDE").otherwise("TOP"))
    both = points.near_filtered(points.merged_returns(p.filter("point_id % 2 = 0"), p.filter("point_id % 2 = 1")), 1.5)
    sweeps = v.filter("r = 1").select("clip_id", F.lit(0).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col("e4"), F.col("e5"), mat.d(1)]).alias("m"))
    return points.to_world(both, sweeps).select("clip_id", "point_id", "sensor", *(_r(a).alias(a) for a in "xyz"))


def _camera(v: DataFrame) -> DataFrame:
    """A camera a clip, 6 behind the origin and 1 up, that looks along x: pinhole for even clips, f-theta for odd ones."""
    m = mat.flu_to_opencv(mat.pose([mat.d(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [mat.d(-6), mat.d(0), mat.d(1)]))
    wide = F.col("clip_id") % 2 == 1
    none = lambda c, on: F.when(on, c)
    fw = _array(FW)
    return v.select("clip_id").distinct().select(
        "clip_id", F.lit("front").alias("camera"), F.lit(0).alias("frame"), m.alias("m"), none(mat.d(30), ~wide).alias("fx"), none(mat.d(30), ~wide).alias("fy"), mat.d(32).alias("cx"), mat.d(24).alias("cy"), none(fw, wide).alias("fw"),
        none(_array(LIN), wide).alias("lin"), none(mat.d(EDGE), wide).alias("max_angle"), none(camera.horner(fw, mat.d(EDGE)), wide).alias("edge_r"), none(camera.horner(camera.derivative(fw), mat.d(EDGE)), wide).alias("edge_dr"),
    )


def _kinds(boxes: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Bus", "Person", "Rider", "Car", "Tree"))), (F.col("track_id").cast("long") % 5 + 1).cast("int"))
    return boxes.withColumn("object_type", kind)


def box_raster(spark, sf_dir):
    """The boxes of each clip as lines in the image of a pinhole or an f-theta camera."""
    v = _vectors(spark, sf_dir)
    out = raster.draw_boxes(_kinds(_boxes(v, 0)), _camera(v), W, H)
    return out.select("clip_id", "u", "v", *raster.RGB)


def map_raster(spark, sf_dir):
    """Map features of four vectors each, in front of the camera: areas, lines, and lines that are densified."""
    v = _vectors(spark, sf_dir)
    at = F.floor((F.col("r") - 1) / 4)
    p = F.struct("r", F.abs("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"))
    f = v.groupBy("clip_id", at.cast("int").alias("feature_id")).agg(F.array_sort(F.collect_list(p)).alias("p"))
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (F.col("feature_id") % 3 + 1).cast("int"))
    f = f.select("clip_id", layer.alias("layer"), "feature_id", F.transform("p", lambda q: geometry.point(q["x"], q["y"], q["z"])).alias("vertices"))
    return raster.draw_map(f, _camera(v), W, H).select("clip_id", "u", "v", *raster.RGB)


def _drive(v: DataFrame) -> DataFrame:
    """_camera() at four frames of a clip, along a road on which most of the map is out of sight."""
    c = _camera(v).drop("frame").withColumn("frame", F.explode(F.expr("sequence(0, 3)")))
    return c.withColumn("m", mat.pose(mat.rot("m"), [F.col("m")[3] + F.col("frame") * STEP, F.col("m")[7], F.col("m")[11]]))


def _road(v: DataFrame) -> DataFrame:
    """Map features of four vectors each, strewn along a road."""
    at = F.floor((F.col("r") - 1) / 4)
    p = F.struct("r", (F.abs("e0") + (at % ROAD) * STEP / 4).alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"))
    f = v.groupBy("clip_id", at.cast("int").alias("feature_id")).agg(F.array_sort(F.collect_list(p)).alias("p"))
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (F.col("feature_id") % 3 + 1).cast("int"))
    return f.select("clip_id", layer.alias("layer"), "feature_id", F.transform("p", lambda q: geometry.point(q["x"], q["y"], q["z"])).alias("vertices"))


def hdmap_condition(spark, sf_dir):
    """The map along a road and the boxes of each frame, in the images of a camera that drives there."""
    v = _vectors(spark, sf_dir)
    f = _road(v)
    o = _kinds(_boxes(v, 0)).withColumn("frame", (F.col("track_id").cast("long") % 4).cast("int"))
    o = o.withColumn("m", mat.pose(mat.rot("m"), [F.col("m")[3] + F.col("frame") * STEP, F.col("m")[7], F.col("m")[11]]))
    return raster.hdmap_condition(f, o, _drive(v), W, H).select("clip_id", "frame", "u", "v", *raster.RGB)


def lidar_condition(spark, sf_dir):
    """Depth images of three sweeps a clip, gathered over windows of render frames; points in moving boxes follow them."""
    v = _vectors(spark, sf_dir)
    p = v.select("clip_id", (F.col("r") % 3 * 3).alias("frame"), F.col("id").alias("point_id"), *((F.col(f"e{i}") * 3).alias(a) for i, a in enumerate("xyz")))
    sweeps = v.filter("r <= 3").select("clip_id", ((F.col("r") - 1) * 3).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col("e4"), F.col("e5"), mat.d(0)]).alias("m"))
    o = v.filter("r % 5 = 0").withColumn("frame", F.explode(F.expr("sequence(0, 6)")))
    m = mat.pose(mat.yaw(F.col("e6")), [F.col("e0") * 3 + F.col("frame") * 0.5, F.col("e1") * 3, F.col("e2") * 3])
    o = o.select("clip_id", "frame", F.col("id").cast("string").alias("track_id"), F.lit("Car").alias("object_type"), F.lit(True).alias("is_moving"), F.array(*((F.abs(f"e{i}") + 1) * 2 for i in (9, 10, 11))).alias("lwh"), m.alias("m"))
    frames = v.select("clip_id").distinct().withColumn("frame", F.explode(F.expr("sequence(0, 7)")))
    cameras = _camera(v).drop("lin", "frame").join(frames, "clip_id")
    return points.lidar_condition(p, sweeps, o, frames, cameras, W, H).select("clip_id", "frame", "u", "v", "grey")


def splat_projection(spark, sf_dir):
    """Points in front of a camera of either model, projected for splatting."""
    v = _vectors(spark, sf_dir)
    p = _points(v).withColumn("camera", F.lit("front"))
    out = points.project_for_splat(p.select("clip_id", "camera", "frame", *"xyz"), _camera(v).drop("lin"))
    return out.groupBy("clip_id").agg(F.count("*").alias("n"), *(_r(F.sum(c)).alias(c) for c in ("pu", "pv", "depth")))


def bev_map(spark, sf_dir):
    """Each clip's line around its first pose, seen from above, with the ego and the places of the clip."""
    v = _vectors(spark, sf_dir)
    s = geometry.segments(_lines(v)).withColumn("prim_id", F.format_string("%04d", "seg_id")).select("*", *(F.lit(x).alias(c) for x, c in zip((10, 200, 30), raster.RGB)))
    ego = v.filter("r = 1").select("clip_id", F.lit(0).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col("e4"), F.col("e5"), mat.d(0)]).alias("m"))
    path = v.select("clip_id", F.col("e6").alias("x"), F.col("e7").alias("y"), mat.d(0).alias("z"))
    return raster.bev_map(s, ego, BEV, 8.0, 3, path).drop("frame")


QUERIES = {f.__name__: f for f in (box_corners, box_lines, box_outlines, cuboid_vertices, closed_rings, near_clipped_lines, near_clipped_segments, grounded_poses, pinhole_rays, ftheta_rays, ray_grid, ftheta_vectors, ftheta_calibration, slerp_track, squad_track, pose_extrapolate, rig_expansion, objects_at_labels, world_points, box_raster, map_raster, hdmap_condition, lidar_condition, splat_projection, bev_map)}


def _rounded(*pairs: str) -> str:
    return ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in (p.split(": ", 1) for p in pairs))


def _signs(rows) -> str:
    return "(VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(rows)) + ") AS g(k, sa, sb, sc)"


_CORNER = f"""{_BOX},
corner AS (
  SELECT clip_id, track_id, k, sa, sb, sc, l, w, h, bx + c * l / 2 * sa - s * w / 2 * sb AS x, b_y + s * l / 2 * sa + c * w / 2 * sb AS y, bz + h / 2 * sc AS z FROM box, {_signs(geometry.CORNERS)})"""
_EDGE = "e AS (SELECT *, lead(e0) OVER w AS f0, lead(e1) OVER w AS f1, lead(e2) OVER w AS f2 FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY r))".replace("e AS", "ed AS")


def _poly(coefficients, x: str) -> str:
    return " + ".join(f"{c}::DOUBLE * pow({x}, {i})" for i, c in enumerate(coefficients) if c)


def _slope(coefficients, x: str) -> str:
    return " + ".join(f"{i * c}::DOUBLE * pow({x}, {i - 1})" for i, c in enumerate(coefficients) if c)


def _wide(x: str, y: str, z: str, lin: tuple) -> tuple[str, str]:
    """Pixel of an f-theta camera."""
    flat, angle = f"sqrt({x} * {x} + {y} * {y})", f"acos(least(greatest({z} / sqrt({x} * {x} + {y} * {y} + {z} * {z}), -1), 1))"
    r = f"CASE WHEN {angle} <= {EDGE} THEN {_poly(FW, angle)} ELSE {_poly(FW, f'{EDGE}::DOUBLE')} + ({angle} - {EDGE}::DOUBLE) * ({_slope(FW, f'{EDGE}::DOUBLE')}) END"
    k = f"(CASE WHEN {flat} > 0 THEN ({r}) / {flat} ELSE 0 END)"
    return f"({lin[0]}::DOUBLE * {k} * {x} + {lin[1]}::DOUBLE * {k} * {y} + 32)", f"({lin[2]}::DOUBLE * {k} * {x} + {k} * {y} + 24)"


def _pixel(x: str, y: str, z: str, lin: tuple = LIN) -> tuple[str, str]:
    wide = _wide(x, y, z, lin)
    return tuple(f"CASE WHEN clip_id % 2 = 1 THEN {b} ELSE {a} * 30 / {z} + {c} END" for a, b, c in ((x, wide[0], 32), (y, wide[1], 24)))


_BACK = "(" + _poly(BW, "rr") + ")"


def _angle(u: str, v: str) -> str:
    """Angle of a pixel's ray."""
    det = LIN[0] - LIN[1] * LIN[2]
    x, y = f"((({u}) - cx - {LIN[1]}::DOUBLE * (({v}) - cy)) / {det}::DOUBLE)", f"(({LIN[0]}::DOUBLE * (({v}) - cy) - {LIN[2]}::DOUBLE * (({u}) - cx)) / {det}::DOUBLE)"
    return f"acos(cos({_poly(BW, f'sqrt({x} * {x} + {y} * {y})')}))"


_SIGNED = """q AS (
  SELECT clip_id, r * 3 AS frame, e0 / n AS w, e1 / n AS x, e2 / n AS y, e3 / n AS z FROM (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS n FROM v)),
d AS (SELECT *, CASE WHEN w * lag(w) OVER o + x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o < 0 THEN 1 ELSE 0 END AS f FROM q WINDOW o AS (PARTITION BY clip_id ORDER BY frame)),
s AS (SELECT clip_id, frame, w * s AS w, x * s AS x, y * s AS y, z * s AS z FROM (SELECT *, CASE WHEN (sum(f) OVER (PARTITION BY clip_id ORDER BY frame)) % 2 = 1 THEN -1 ELSE 1 END AS s FROM d)),
spine AS (SELECT clip_id, f AS frame FROM (SELECT clip_id, max(r) AS n FROM v GROUP BY clip_id), unnest(range(1, 3 * n + 3)) AS t(f))"""


def _q(op: str, a: str, b: str) -> list[str]:
    """Items of a quaternion product, a conjugated if op is 'inverse'."""
    s = "-" if op == "inverse" else ""
    w, x, y, z = f"{a}w", f"({s}{a}x)", f"({s}{a}y)", f"({s}{a}z)"
    return [f"({w} * {b}w - {x} * {b}x - {y} * {b}y - {z} * {b}z)", f"({w} * {b}x + {x} * {b}w + {y} * {b}z - {z} * {b}y)", f"({w} * {b}y - {x} * {b}z + {y} * {b}w + {z} * {b}x)", f"({w} * {b}z + {x} * {b}y - {y} * {b}x + {z} * {b}w)"]


def _slerp(name: str, source: str, a: str, b: str, t: str, out: str) -> str:
    """A CTE that adds the interpolation of two quaternions (prefixes a and b) without alignment."""
    dot = " + ".join(f"{a}{c} * {b}{c}" for c in "wxyz")
    raw = ", ".join(f"ka * {a}{c} + kb * {b}{c} AS raw_{c}" for c in "wxyz")
    norm = "sqrt(" + " + ".join(f"raw_{c} * raw_{c}" for c in "wxyz") + ")"
    return f"""{name}1 AS (SELECT *, acos(least(greatest({dot}, -1), 1)) AS an, {t} AS tt FROM {source}),
{name}2 AS (SELECT *, CASE WHEN sin(an) < 1e-9 THEN 1 - tt ELSE sin((1 - tt) * an) / greatest(sin(an), 1e-9) END AS ka, CASE WHEN sin(an) < 1e-9 THEN tt ELSE sin(tt * an) / greatest(sin(an), 1e-9) END AS kb FROM {name}1),
{name}3 AS (SELECT *, {raw} FROM {name}2),
{name} AS (SELECT * EXCLUDE (an, tt, ka, kb, raw_w, raw_x, raw_y, raw_z), {', '.join(f'raw_{c} / {norm} AS {out}{c}' for c in 'wxyz')} FROM {name}3)"""


def _log(q: list[str]) -> list[str]:
    v = f"sqrt({q[1]} * {q[1]} + {q[2]} * {q[2]} + {q[3]} * {q[3]})"
    return [f"(CASE WHEN {v} > 1e-12 THEN atan2({v}, {q[0]}) / greatest({v}, 1e-12) ELSE 1 END * {c})" for c in q[1:]]


def _five(p: str, x: str) -> str:
    """A polynomial without intercept, of degree 5."""
    return " + ".join(f"{p}{k} * pow({x}::DOUBLE, {k})" for k in range(1, 6))


def _eliminated() -> str:
    """CTEs g0 to g5: the normal equations of degree 5, solved one unknown at a time."""
    out = ["g0 AS (SELECT clip_id, camera, scale, height, " + ", ".join([*(f"sum(pow(x, {i + j})) AS m{i}{j}" for i in range(1, 6) for j in range(1, 6)), *(f"sum(pow(x, {i}) * y) AS m{i}6" for i in range(1, 6))]) + " FROM unit GROUP BY ALL)"]
    for k in range(1, 6):
        cells = [f"m{k}{j} / m{k}{k} AS m{k}{j}" if i == k else f"m{i}{j} - m{i}{k} * (m{k}{j} / m{k}{k}) AS m{i}{j}" for i in range(1, 6) for j in range(1, 7)]
        out.append(f"g{k} AS (SELECT clip_id, camera, scale, height, {', '.join(cells)} FROM g{k - 1})")
    return ",\n".join(out)


#: Calibrated polynomials `edged`: fw and bw, the angle a of the image's farthest corner. The domain of forward ones is found step by step.
_CALIBRATED = f"""p AS (SELECT clip_id, id AS camera, id % 2 = 0 AS back, CASE WHEN id % 2 = 0 THEN 0.02::DOUBLE + abs(e0) / 1000 ELSE 40 + abs(e0) END AS p1, CASE WHEN id % 2 = 0 THEN abs(e1) / 1e5::DOUBLE ELSE e1 / 10 END AS p2,
  CASE WHEN id % 2 = 0 THEN abs(e2) / 1e7::DOUBLE ELSE 1 + abs(e2) / 10 END AS p3, sqrt(33.0::DOUBLE * 33 + 25 * 25) AS border FROM v),
steps AS (SELECT clip_id, camera, i, CASE WHEN p1 + 2 * p2 * t + 3 * p3 * t * t <= 0 THEN i - 1 WHEN p1 * t + p2 * t * t + p3 * t * t * t > border THEN i END AS stop FROM (SELECT *, i * pi() / 2000 AS t FROM p, unnest(range(1, 2001)) AS s(i) WHERE NOT back)),
domains AS (SELECT clip_id, camera, coalesce(arg_min(stop, i) FILTER (stop IS NOT NULL), 2000) * pi() / 2000 AS top FROM steps GROUP BY ALL),
sampled AS (SELECT p.*, coalesce(d.top, border) * i / 499 AS y FROM p LEFT JOIN domains d USING (clip_id, camera), unnest(range(500)) AS s(i)),
valued AS (SELECT *, p1 * y + p2 * y * y + p3 * y * y * y AS x FROM sampled),
scaled AS (SELECT *, max(x) OVER w AS scale, max(y) OVER w AS height FROM valued WINDOW w AS (PARTITION BY clip_id, camera)),
unit AS (SELECT clip_id, camera, x / scale AS x, y / height AS y, scale, height FROM scaled),
{_eliminated()},
fits AS (SELECT clip_id, camera, {', '.join(f'm{k}6 * height / pow(scale, {k}) AS f{k}' for k in range(1, 6))} FROM g5),
polys AS (SELECT clip_id, camera, border, {', '.join(f"CASE WHEN back THEN {a} ELSE {b} END AS bw{k}, CASE WHEN back THEN {b} ELSE {a} END AS fw{k}" for k in range(1, 6) for a, b in [(f'p{k}' if k < 4 else '0', f'f{k}')])} FROM p JOIN fits USING (clip_id, camera)),
edged AS (SELECT *, acos(cos({_five('bw', 'r')})) AS a FROM (SELECT *, sqrt(32.0::DOUBLE * 32 + 25 * 25) AS r FROM polys))"""

_HELD = "CASE WHEN pf IS NULL THEN n_{c} WHEN nf IS NULL OR pf = nf THEN p_{c} ELSE q_{c} END"
_SEGMENT_CUT = "t + {e}"

_CAMERA = f"""{_CORNER},
cam AS (SELECT clip_id, track_id, k, -y AS x, -(z - 1) AS y, x + 6 AS z FROM corner),
px AS (SELECT *, {_pixel('x', 'y', 'z')[0]} AS u, {_pixel('x', 'y', 'z')[1]} AS v FROM cam),
drawn AS (SELECT clip_id, track_id FROM px GROUP BY ALL HAVING bool_or(z > 0) AND bool_or(round_even(u, 0) BETWEEN 0 AND {W - 1} AND round_even(v, 0) BETWEEN 0 AND {H - 1}) AND min(z) <= 122.5::DOUBLE),
pairs AS (SELECT seg, a, b FROM (SELECT seg, ([{', '.join(map(str, geometry.BOX_LINE))}])[seg + 1] AS a, ([{', '.join(map(str, geometry.BOX_LINE))}])[seg + 2] AS b FROM unnest(range(15)) AS t(seg))),
raw AS (
  SELECT p.clip_id, p.track_id, seg, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS b_y, q.z AS bz, (p.z + q.z) / 2 AS depth
  FROM drawn JOIN cam p USING (clip_id, track_id) JOIN pairs ON pairs.a = p.k JOIN cam q ON q.clip_id = p.clip_id AND q.track_id = p.track_id AND q.k = pairs.b),
near AS (
  SELECT clip_id, track_id, seg, depth, az >= 0 OR bz >= 0 AS seen, az * bz < 0 AND az <= 0 AS cut_a, az * bz < 0 AND az > 0 AS cut_b, ax, ay, az, bx, b_y, bz, az / nullif(az - bz, 0) AS t FROM raw),
ends AS (
  SELECT clip_id, track_id, seg, depth,
    CASE WHEN cut_a THEN ax + (bx - ax) * (t + 0.2::DOUBLE) ELSE ax END AS ax, CASE WHEN cut_a THEN ay + (b_y - ay) * (t + 0.2::DOUBLE) ELSE ay END AS ay, CASE WHEN cut_a THEN az + (bz - az) * (t + 0.2::DOUBLE) ELSE az END AS az,
    CASE WHEN cut_b THEN ax + (bx - ax) * (t - 0.2::DOUBLE) ELSE bx END AS bx, CASE WHEN cut_b THEN ay + (b_y - ay) * (t - 0.2::DOUBLE) ELSE b_y END AS b_y, CASE WHEN cut_b THEN az + (bz - az) * (t - 0.2::DOUBLE) ELSE bz END AS bz
  FROM near WHERE seen)"""


def _raster_sql(source: str, w: int, h: int, width: int, columns: str) -> str:
    """CTEs from segments `s` (clip_id, id, u1, v1, u2, v2): hit(clip_id, id, u, v)."""
    return f"""{source},
{cut_sql(w, h)},
tt AS (SELECT c.*, u, v, pow(u2 - u1, 2) + pow(v2 - v1, 2) AS n2 FROM cut c, unnest(range({w})) AS a(u), unnest(range({h})) AS b(v)
  WHERE u BETWEEN least(u1, u2) - {width} AND greatest(u1, u2) + {width} AND v BETWEEN least(v1, v2) - {width} AND greatest(v1, v2) + {width}),
kk AS (SELECT *, CASE WHEN n2 = 0 THEN 0 ELSE least(greatest(((u - u1) * (u2 - u1) + (v - v1) * (v2 - v1)) / n2, 0), 1) END AS k FROM tt),
hit AS (SELECT {columns}, u, v FROM kk WHERE pow(u - u1 - k * (u2 - u1), 2) + pow(v - v1 - k * (v2 - v1), 2) <= {width * width / 4}::DOUBLE)"""


_PA, _PB = _pixel("ax", "ay", "az"), _pixel("bx", "b_y", "bz")
_SHADE = "trunc(2 * (122.5::DOUBLE - least(greatest(depth, 0), 122.5::DOUBLE)) / 255 * {c})::INTEGER"
_CLASS = [(kind, raster.CLASS_COLOURS[kind]) for kind in ("Truck", "Pedestrian", "Cyclist", "Car", "Others")]

def _box_sql(vectors: str) -> str:
    """Boxes of the vectors `v` as lines in the image of their clip."""
    return f"""WITH {vectors}, {_CAMERA},
{_raster_sql(f"s AS (SELECT clip_id, (track_id, seg, depth) AS id, {_PA[0]} AS u1, {_PA[1]} AS v1, {_PB[0]} AS u2, {_PB[1]} AS v2 FROM ends WHERE az > 0 AND bz > 0)", W, H, raster.BOX_WIDTH, "clip_id, id[1] AS track_id, id[2] AS seg, id[3] AS depth")},
top AS (SELECT clip_id, u, v, track_id::BIGINT % 5 AS cls, arg_max(depth, (track_id, seg)) AS depth FROM hit GROUP BY ALL),
lit AS (SELECT clip_id, u, v, {', '.join('CASE cls ' + ' '.join(f"WHEN {k} THEN {_SHADE.format(c=rgb[i])}" for k, (_, rgb) in enumerate(_CLASS)) + f' END AS {c}' for i, c in enumerate(raster.RGB))} FROM top)
SELECT clip_id, u::INTEGER AS u, v::INTEGER AS v, max(r) AS r, max(g) AS g, max(b) AS b FROM lit GROUP BY ALL"""


def _map_sql(vectors: str, f: str) -> str:
    """Map features `f` (clip_id, prim, r, and x, y, z in the camera) in the image of their clip."""
    return f"""WITH {vectors}, f AS ({f}),
px AS (SELECT *, {_pixel('x', 'y', 'z')[0]} AS u, {_pixel('x', 'y', 'z')[1]} AS w, prim % 3 AS kind FROM f),
-- areas
seen AS (SELECT clip_id, prim, avg(z) AS depth FROM px WHERE kind = 0 GROUP BY ALL
  HAVING count(*) >= 3 AND bool_or(round_even(u, 0) BETWEEN 0 AND {W - 1} AND round_even(w, 0) BETWEEN 0 AND {H - 1}) AND min(z) <= 122.5::DOUBLE),
q AS (SELECT clip_id, prim, r, trunc(u) AS u, trunc(w) AS w FROM px JOIN seen USING (clip_id, prim)),
flat AS (SELECT a.clip_id, a.prim FROM q a JOIN q b USING (clip_id, prim) JOIN q c USING (clip_id, prim) GROUP BY ALL HAVING max(abs((b.u - a.u) * (c.w - a.w) - (b.w - a.w) * (c.u - a.u))) = 0),
rows AS (SELECT y FROM unnest(range({H})) AS t(y)),
x AS (SELECT a.clip_id, a.prim, y, CASE WHEN a.w = b.w THEN a.u ELSE a.u + (b.u - a.u) * ((y - a.w) / (b.w - a.w)) END AS x FROM q a JOIN q b ON a.clip_id = b.clip_id AND a.prim = b.prim ANTI JOIN flat ON flat.clip_id = a.clip_id AND flat.prim = a.prim, rows WHERE a.w <= y AND b.w >= y),
chord AS (SELECT clip_id, prim, y, greatest(ceil(min(x) - 1e-9), 0)::INTEGER AS lo, least(floor(max(x) + 1e-9), {W - 1})::INTEGER AS hi FROM x GROUP BY ALL),
area AS (SELECT clip_id, u::INTEGER AS u, y::INTEGER AS v, max(prim) AS prim FROM chord, unnest(range(lo, hi + 1)) AS t(u) GROUP BY ALL),
-- lines, every edge of the second kind in pieces
edge AS (SELECT clip_id, prim, kind, r, x AS x0, y AS y0, z AS z0, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(z) OVER o AS z1 FROM px WHERE kind > 0 WINDOW o AS (PARTITION BY clip_id, prim ORDER BY r)),
cutin AS (SELECT *, CASE WHEN kind = 1 THEN 2 ELSE greatest(trunc(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)) / 0.8::DOUBLE)::BIGINT, 2) END AS n FROM edge WHERE x1 IS NOT NULL),
piece AS (SELECT clip_id, prim, r * 1000 + k AS seg, x0 + (x1 - x0) * k / (n - 1) AS ax, y0 + (y1 - y0) * k / (n - 1) AS ay, z0 + (z1 - z0) * k / (n - 1) AS az,
  x0 + (x1 - x0) * (k + 1) / (n - 1) AS bx, y0 + (y1 - y0) * (k + 1) / (n - 1) AS b_y, z0 + (z1 - z0) * (k + 1) / (n - 1) AS bz FROM cutin, unnest(range(n - 1)) AS t(k)),
vertex AS (SELECT clip_id, prim, seg, ax AS x, ay AS y, az AS z FROM piece UNION ALL SELECT clip_id, prim, seg, bx, b_y, bz FROM piece),
place AS (SELECT clip_id, prim, z, {_pixel('x', 'y', 'z')[0]} AS u, {_pixel('x', 'y', 'z')[1]} AS w FROM vertex),
drawn AS (SELECT clip_id, prim FROM place GROUP BY ALL HAVING bool_or(round_even(u, 0) BETWEEN 0 AND {W - 1} AND round_even(w, 0) BETWEEN 0 AND {H - 1}) AND min(z) <= 122.5::DOUBLE),
{_raster_sql(f"s AS (SELECT clip_id, (prim, seg, (az + bz) / 2) AS id, {_PA[0]} AS u1, {_PA[1]} AS v1, {_PB[0]} AS u2, {_PB[1]} AS v2 FROM piece JOIN drawn USING (clip_id, prim))", W, H, raster.MAP_WIDTH, "clip_id, id[1] AS prim, id[2] AS seg, id[3] AS depth")},
line AS (SELECT clip_id, u, v, prim % 3 AS kind, arg_max(depth, (prim, seg)) AS depth FROM hit GROUP BY ALL),
every AS (SELECT clip_id, u::INTEGER AS u, v::INTEGER AS v, kind, depth FROM line UNION ALL SELECT clip_id, u, v, 0, depth FROM area JOIN seen USING (clip_id, prim)),
lit AS (SELECT clip_id, u, v, {', '.join('CASE kind ' + ' '.join(f"WHEN {k} THEN {_SHADE.format(c=next(y[2 + i] for y in raster.LAYERS if y[0] == n))}" for k, n in enumerate(LAYERS)) + f' END AS {c}' for i, c in enumerate(raster.RGB))} FROM every)
SELECT clip_id, u, v, max(r) AS r, max(g) AS g, max(b) AS b FROM lit GROUP BY ALL"""


#: A clip's frame is a clip of its own in these queries, with the frame before its number; that leaves the number even or odd.
_FRAME = 10_000_000_000
_STREWN = f"""SELECT frame * {_FRAME} + clip_id AS clip_id, prim, r, x, y, z FROM (
  SELECT clip_id, frame, (r - 1) // 4 AS prim, r, -e1 AS x, -(e2 - 1) AS y, abs(e0) + (r - 1) // 4 % {ROAD} * {STEP / 4}::DOUBLE - frame * {STEP}::DOUBLE + 6 AS z FROM v, unnest(range(4)) AS t(frame)) WHERE z > 0"""



def _condition_sql(boxed: str) -> str:
    """The map along the road and the boxes, of which `boxed` makes clips of frames."""
    return f"""SELECT (clip_id % {_FRAME})::BIGINT AS clip_id, (clip_id // {_FRAME})::INTEGER AS frame, u, v, max(r) AS r, max(g) AS g, max(b) AS b FROM (
  SELECT * FROM ({_map_sql(_V, _STREWN)}) UNION ALL
  SELECT * FROM ({_box_sql(_V.replace("v AS (", "v0 AS (") + f", v AS ({boxed})")})) GROUP BY ALL"""


ORACLE_SQL = {
    "box_corners": f"WITH {_V}, {_CORNER} SELECT clip_id, track_id, k, {_rounded('x: x', 'y: y', 'z: z')} FROM corner",
    "box_lines": f"""WITH {_V}, {_CORNER}, o AS (SELECT i, ([{', '.join(map(str, geometry.BOX_LINE))}])[i + 1] AS a, ([{', '.join(map(str, geometry.BOX_LINE))}])[i + 2] AS b FROM unnest(range(15)) AS t(i))
SELECT p.clip_id, p.track_id, count(*) AS n, round(sum(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))), 4) AS length
FROM o JOIN corner p ON p.k = o.a JOIN corner q ON q.k = o.b AND q.clip_id = p.clip_id AND q.track_id = p.track_id GROUP BY ALL""",
    "box_outlines": f"""WITH {_V}, {_CORNER}, o AS (SELECT i, ([{', '.join(map(str, geometry.BOX_OUTLINE))}])[i + 1] AS a FROM unnest(range(12)) AS t(i))
SELECT clip_id, track_id, i::INTEGER AS k, {_rounded('x: x', 'y: y', 'z: z')} FROM o JOIN corner ON corner.k = o.a""",
    "cuboid_vertices": f"""WITH {_V}, a AS (
  SELECT *, cos(e3) AS ca, sin(e3) AS sa_, cos(e4) AS cb, sin(e4) AS sb_, cos(e5) AS cc, sin(e5) AS sc_, (abs(e9) + 1) / 2 AS hx, (abs(e10) + 1) / 2 AS hy, (abs(e11) + 1) / 2 AS hz FROM v)
SELECT clip_id, id, k, {_rounded('x: e0 + ca * cb * hx * sa + (ca * sb_ * sc_ - sa_ * cc) * hy * sb + (ca * sb_ * cc + sa_ * sc_) * hz * sc', 'y: e1 + sa_ * cb * hx * sa + (sa_ * sb_ * sc_ + ca * cc) * hy * sb + (sa_ * sb_ * cc - ca * sc_) * hz * sc', 'z: e2 - sb_ * hx * sa + cb * sc_ * hy * sb + cb * cc * hz * sc')}
FROM a, {_signs(geometry.CUBOID_CORNERS)}""",
    "closed_rings": f"""WITH {_V}, n AS (
  SELECT *, coalesce(lead(e0) OVER w, first_value(e0) OVER w) AS f0, coalesce(lead(e1) OVER w, first_value(e1) OVER w) AS f1, coalesce(lead(e2) OVER w, first_value(e2) OVER w) AS f2
  FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY r))
SELECT clip_id, count(*) AS n, round(sum(sqrt(pow(f0 - e0, 2) + pow(f1 - e1, 2) + pow(f2 - e2, 2))), 4) + 0.0 AS length FROM n GROUP BY clip_id""",
    "near_clipped_lines": f"""WITH {_V}, {_EDGE},
k AS (SELECT *, e2 / nullif(e2 - f2, 0) AS t FROM ed),
p AS (
  SELECT clip_id, e0 AS x, e1 AS y, e2 AS z FROM k WHERE e2 >= 0
  UNION ALL SELECT clip_id, e0 + (f0 - e0) * s, e1 + (f1 - e1) * s, e2 + (f2 - e2) * s FROM (SELECT *, CASE WHEN e2 >= 0 THEN t - 0.05::DOUBLE ELSE t + 0.05::DOUBLE END AS s FROM k WHERE f2 IS NOT NULL AND (e2 >= 0) <> (f2 >= 0)))
SELECT clip_id, count(*) AS n, round(sum(x), 4) + 0.0 AS x, round(sum(y), 4) + 0.0 AS y, round(sum(z), 4) + 0.0 AS z FROM p GROUP BY clip_id""",
    "near_clipped_segments": f"""WITH {_V}, {_EDGE},
k AS (SELECT *, e2 / nullif(e2 - f2, 0) AS t, e2 >= 0 OR f2 >= 0 AS seen, e2 * f2 < 0 AS crosses FROM ed WHERE f2 IS NOT NULL)
SELECT clip_id, (r - 1)::INTEGER AS seg_id, """
    + ", ".join(f"round(CASE WHEN seen THEN CASE WHEN crosses AND e2 <= 0 THEN e{i} + (f{i} - e{i}) * (t + 0.2::DOUBLE) ELSE e{i} END END, 4) + 0.0 AS a_{n}" for i, n in enumerate("xyz"))
    + ", "
    + ", ".join(f"round(CASE WHEN seen THEN CASE WHEN crosses AND e2 > 0 THEN e{i} + (f{i} - e{i}) * (t - 0.2::DOUBLE) ELSE f{i} END END, 4) + 0.0 AS b_{n}" for i, n in enumerate("xyz"))
    + " FROM k",
    "grounded_poses": f"""WITH {_V}, f AS (SELECT *, cos(e3) * cos(e4 / 4) AS fx, sin(e3) * cos(e4 / 4) AS fy FROM v), u AS (SELECT *, fx / sqrt(fx * fx + fy * fy) AS c, fy / sqrt(fx * fx + fy * fy) AS s FROM f)
SELECT clip_id, id, {_rounded('cos: c', 'sin: s', 'x: e0', 'y: e1', 'z: e2', 'right_x: s', 'forward_x: c')}, 9.0::DOUBLE AS height FROM u""",
    "pinhole_rays": f"""WITH {_V}, k AS (SELECT *, (abs(e0) + 20) / 2 AS fx, (abs(e1) + 21) / 2 AS fy FROM v)
SELECT clip_id, id, {_rounded('x: (e2 * 4 - 16) / fx', 'y: (e3 * 4 - 12) / fy', 'fov_h: 2 * atan(32 / (2 * fx))', 'fov_v: 2 * atan(24 / (2 * fy))')} FROM k""",
    "ftheta_rays": f"""WITH {_V}, p AS (SELECT clip_id, id, (e0 * 8 - {LIN[1]}::DOUBLE * e1 * 6) / {LIN[0] - LIN[1] * LIN[2]}::DOUBLE AS x, ({LIN[0]}::DOUBLE * e1 * 6 - {LIN[2]}::DOUBLE * e0 * 8) / {LIN[0] - LIN[1] * LIN[2]}::DOUBLE AS y FROM v),
r AS (SELECT *, sqrt(x * x + y * y) AS rr FROM p), a AS (SELECT *, {_BACK} AS a FROM r)
SELECT clip_id, id, round(sin(a) / rr * x, 6) + 0.0 AS x, round(sin(a) / rr * y, 6) + 0.0 AS y, round(cos(a), 6) + 0.0 AS z, rr > 0 AS valid FROM a""",
    "ray_grid": f"""WITH {_V}, g AS (SELECT clip_id, id AS camera, u::INTEGER AS u, v_::INTEGER AS v, (u + 0.5::DOUBLE - 2) / (abs(e0) + 2) AS x, (v_ + 0.5::DOUBLE - 1.5::DOUBLE) / (abs(e1) + 2) AS y FROM v, unnest(range(4)) AS a(u), unnest(range(3)) AS b(v_)),
n AS (SELECT *, sqrt(x * x + y * y + 1) AS n FROM g)
SELECT clip_id, camera, u, v, round(x / n, 4) + 0.0 AS x, round(y / n, 4) + 0.0 AS y, round(1 / n, 4) + 0.0 AS z FROM n""",
    "ftheta_vectors": f"""WITH {_V}, s AS (SELECT clip_id, id, e0 + 32 AS cx, e1 + 24 AS cy, abs(e2) + 1 AS p1, e3 / 10 AS p2, id % 2 = 0 AS bw FROM v)
SELECT clip_id, id, {_rounded('x0: cx / 2', 'x1: cy / 2')}, 32.0::DOUBLE AS x2, 24.0::DOUBLE AS x3, 0.0::DOUBLE AS x4, round(CASE WHEN bw THEN p1 * 2 ELSE p1 / 2 END, 4) + 0.0 AS x5, round(CASE WHEN bw THEN p2 * 4 ELSE p2 / 2 END, 4) + 0.0 AS x6,
  0.0::DOUBLE AS x7, 0.0::DOUBLE AS x8, 0.0::DOUBLE AS x9, CASE WHEN bw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x10, 1.0::DOUBLE AS x11, 0.0::DOUBLE AS x12, 0.0::DOUBLE AS x13,
  round({_angle('0', 'cy')} + {_angle(str(W - 1), 'cy')}, 4) + 0.0 AS fov_h, round({_angle('cx', '0')} + {_angle('cx', str(H - 1))}, 4) + 0.0 AS fov_v,
  round(greatest({_angle('0', '0')}, {_angle(str(W - 1), '0')}, {_angle('0', str(H - 1))}, {_angle(str(W - 1), str(H - 1))}), 4) + 0.0 AS fov_max_angle FROM s""",
    "ftheta_calibration": f"""WITH {_V}, {_CALIBRATED}
SELECT clip_id, camera, round({_five('fw', '0.1')}, 3) + 0.0 AS ahead_1, round({_five('fw', '0.5')}, 3) + 0.0 AS ahead_5, round(a, 3) + 0.0 AS max_angle, round({_five('fw', 'a')}, 3) + 0.0 AS edge_r,
  round(fw1 + 2 * fw2 * a + 3 * fw3 * a * a + 4 * fw4 * pow(a, 3) + 5 * fw5 * pow(a, 4), 3) + 0.0 AS edge_dr, round({_five('bw', '5')}, 4) + 0.0 AS back_5, round({_five('bw', '30')}, 4) + 0.0 AS back_30 FROM edged""",
    "slerp_track": f"""WITH {_V}, {_SIGNED},
b AS (SELECT p.clip_id, p.frame, a.frame AS pf, c.frame AS nf, {', '.join(f'a.{x} AS p_{x}, c.{x} AS n_{x}' for x in 'wxyz')}
  FROM spine p ASOF LEFT JOIN s a ON a.clip_id = p.clip_id AND p.frame >= a.frame ASOF LEFT JOIN s c ON c.clip_id = p.clip_id AND p.frame <= c.frame),
{_slerp('m', 'b', 'p_', 'n_', '(frame - pf)::DOUBLE / nullif(nf - pf, 0)::DOUBLE', 'q_')}
SELECT clip_id, frame::INTEGER AS frame, {', '.join(f"round({_HELD.format(c=c)}, 4) + 0.0 AS {c}" for c in 'wxyz')} FROM m""",
    "squad_track": f"""WITH {_V}, {_SIGNED},
around AS (SELECT *, {', '.join(f'coalesce(lag({x}) OVER o, {x}) AS b_{x}, coalesce(lead({x}) OVER o, {x}) AS a_{x}, {x} AS m_{x}' for x in 'wxyz')} FROM s WINDOW o AS (PARTITION BY clip_id ORDER BY frame)),
logs AS (SELECT *, {', '.join(f"{e} AS lb{i}" for i, e in enumerate(_log(_q('inverse', 'm_', 'b_'))))}, {', '.join(f"{e} AS la{i}" for i, e in enumerate(_log(_q('inverse', 'm_', 'a_'))))} FROM around),
step AS (SELECT *, {', '.join(f'-(lb{i} + la{i}) / 4 AS h{i}' for i in range(3))} FROM logs),
ex AS (SELECT *, sqrt(h0 * h0 + h1 * h1 + h2 * h2) AS hn FROM step),
ek AS (SELECT *, cos(hn) AS g_w, {', '.join(f"CASE WHEN hn > 1e-12 THEN sin(hn) / greatest(hn, 1e-12) ELSE 1 END * h{i} AS g_{c}" for i, c in enumerate('xyz'))} FROM ex),
tan AS (SELECT clip_id, frame, w, x, y, z, {', '.join(f'{e} AS t{c}' for e, c in zip(_q('', 'm_', 'g_'), 'wxyz'))} FROM ek),
b AS (SELECT p.clip_id, p.frame, a.frame AS pf, c.frame AS nf, {', '.join(f'a.{x} AS p_{x}, c.{x} AS n_{x}, a.t{x} AS pt_{x}, c.t{x} AS nt_{x}' for x in 'wxyz')}
  FROM spine p ASOF LEFT JOIN tan a ON a.clip_id = p.clip_id AND p.frame >= a.frame ASOF LEFT JOIN tan c ON c.clip_id = p.clip_id AND p.frame <= c.frame),
bf AS (SELECT *, (frame - pf)::DOUBLE / nullif(nf - pf, 0)::DOUBLE AS fr FROM b),
{_slerp('m', 'bf', 'p_', 'n_', 'fr', 'c_')}, {_slerp('i', 'm', 'pt_', 'nt_', 'fr', 'i_')}, {_slerp('j', 'i', 'c_', 'i_', '2 * fr * (1 - fr)', 'q_')}
SELECT clip_id, frame::INTEGER AS frame, {', '.join(f"round({_HELD.format(c=c)}, 4) + 0.0 AS {c}" for c in 'wxyz')} FROM j""",
    "pose_extrapolate": f"""WITH {_V}, pr AS (SELECT clip_id, r - 1 AS frame, e0, e1, e2, e3, lead(e0) OVER w AS f0, lead(e1) OVER w AS f1, lead(e2) OVER w AS f2, lead(e3) OVER w AS f3 FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY r)),
up AS (
  SELECT clip_id, frame * 3 + k AS frame, e3 + coalesce(atan2(sin(f3 - e3), cos(f3 - e3)), 0) * k / 3.0::DOUBLE AS yaw, e0 + coalesce(f0 - e0, 0) * k / 3.0::DOUBLE AS x, e1 + coalesce(f1 - e1, 0) * k / 3.0::DOUBLE AS y, e2 + coalesce(f2 - e2, 0) * k / 3.0::DOUBLE AS z
  FROM pr, unnest(range(CASE WHEN f0 IS NULL THEN 1 ELSE 3 END)) AS t(k)),
ends AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lead(x) OVER w AS nx FROM up WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
tail AS (SELECT clip_id, frame + k AS frame, yaw, x + k * (x - coalesce(px, x)) AS x, y + k * (y - coalesce(py, y)) AS y, z + k * (z - coalesce(pz, z)) AS z FROM ends, unnest([1, 2]) AS t(k) WHERE nx IS NULL)
SELECT clip_id, frame::INTEGER AS frame, {_rounded('cos: cos(yaw)', 'sin: sin(yaw)', 'x: x', 'y: y', 'z: z')} FROM (FROM up UNION ALL FROM tail)""",
    "rig_expansion": f"""WITH {_V}, f AS (SELECT clip_id, e0 AS x, e1 AS y, e3 AS a FROM v WHERE r = 1), c AS (SELECT clip_id, CASE WHEN r = 1 THEN 'front' ELSE 'side' END AS camera, e0 AS x, e1 AS y, e3 AS a FROM v WHERE r <= 2),
rel AS (SELECT c.clip_id, camera, c.a - f.a AS a, cos(f.a) * (c.x - f.x) + sin(f.a) * (c.y - f.y) AS x, cos(f.a) * (c.y - f.y) - sin(f.a) * (c.x - f.x) AS y FROM c JOIN f USING (clip_id))
SELECT v.clip_id, camera, (r - 2)::INTEGER AS frame, {_rounded('cos: cos(e3 + a)', 'sin: sin(e3 + a)', 'x: e0 + cos(e3) * x - sin(e3) * y', 'y: e1 + sin(e3) * x + cos(e3) * y')} FROM v JOIN rel USING (clip_id) WHERE r > 2""",
    "objects_at_labels": f"""WITH {_V}, f AS (SELECT clip_id, f FROM (SELECT clip_id, max(r) AS n FROM v GROUP BY clip_id), unnest(range(n + 1)) AS t(f))
SELECT f.clip_id, f::INTEGER AS frame, id::VARCHAR AS track_id, round(e0, 4) + 0.0 AS x FROM f JOIN v ON v.clip_id = f.clip_id AND v.r % 4 * 3 = f // 3 * 3""",
    "world_points": f"""WITH {_V}, s AS (SELECT clip_id, cos(e3) AS c, sin(e3) AS s, e4 AS tx, e5 AS ty FROM v WHERE r = 1)
SELECT v.clip_id, id AS point_id, 'TOP' AS sensor, {_rounded('x: c * e0 - s * e1 + tx', 'y: s * e0 + c * e1 + ty', 'z: e2 + 1')} FROM v JOIN s USING (clip_id)
WHERE id % 3 <> 0 AND sqrt(e0 * e0 + e1 * e1 + e2 * e2) >= 1.5::DOUBLE""",
    "box_raster": _box_sql(_V),
    "map_raster": _map_sql(_V, "SELECT clip_id, (r - 1) // 4 AS prim, r, -e1 AS x, -(e2 - 1) AS y, abs(e0) + 6 AS z FROM v"),
    "hdmap_condition": _condition_sql(f"SELECT * REPLACE (id % 4 * {_FRAME} + clip_id AS clip_id) FROM v0"),
    "lidar_condition": f"""WITH {_V},
pts AS (SELECT clip_id, id AS point_id, r % 3 * 3 AS sweep, e0 * 3 AS x, e1 * 3 AS y, e2 * 3 AS z FROM v WHERE sqrt(pow(e0 * 3, 2) + pow(e1 * 3, 2) + pow(e2 * 3, 2)) >= 3),
sw AS (SELECT clip_id, (r - 1) * 3 AS sweep, cos(e3) AS c, sin(e3) AS s, e4 AS tx, e5 AS ty FROM v WHERE r <= 3),
world AS (SELECT clip_id, sweep, point_id, c * x - s * y + tx AS x, s * x + c * y + ty AS y, z FROM pts JOIN sw USING (clip_id, sweep)),
obj AS (SELECT clip_id, id::VARCHAR AS track, f AS frame, e0 * 3 + f * 0.5::DOUBLE AS ox, e1 * 3 AS oy, e2 * 3 AS oz, cos(e6) AS c, sin(e6) AS s, (abs(e9) + 1) * 2 AS l, (abs(e10) + 1) * 2 AS w, (abs(e11) + 1) * 2 AS h
  FROM v, unnest(range(7)) AS t(f) WHERE r % 5 = 0),
held AS (
  SELECT q.clip_id, sweep, point_id, track, (x - ox) * c + (y - oy) * s AS qx, (y - oy) * c - (x - ox) * s AS qy, z - oz AS qz FROM world q JOIN obj o ON o.clip_id = q.clip_id AND o.frame = q.sweep
  WHERE abs((x - ox) * c + (y - oy) * s) <= l / 2 * 1.2::DOUBLE + 1e-6 AND abs((y - oy) * c - (x - ox) * s) <= w / 2 * 1.2::DOUBLE + 1e-6 AND abs(z - oz) <= h / 2 * 1.2::DOUBLE + 1e-6),
win AS (SELECT clip_id, f AS frame, k, least(round_even(least(greatest(f + k, 0), 7) / 3.0, 0) * 3, 6)::BIGINT AS sweep FROM (SELECT DISTINCT clip_id FROM v), unnest(range(8)) AS t(f), unnest([-2, -1, 0, 1, 2]) AS q(k)),
one AS (SELECT a.clip_id, a.frame, a.k, a.sweep, h.point_id, min(h.track) AS track, bool_or(o.track IS NULL) AS gone FROM win a JOIN held h ON h.clip_id = a.clip_id AND h.sweep = a.sweep
  LEFT JOIN obj o ON o.clip_id = a.clip_id AND o.track = h.track AND o.frame = a.frame GROUP BY ALL),
moved AS (
  SELECT a.clip_id, a.frame, CASE WHEN n.track IS NULL THEN p.x ELSE o.c * h.qx - o.s * h.qy + o.ox END AS x, CASE WHEN n.track IS NULL THEN p.y ELSE o.s * h.qx + o.c * h.qy + o.oy END AS y, CASE WHEN n.track IS NULL THEN p.z ELSE h.qz + o.oz END AS z
  FROM win a JOIN world p ON p.clip_id = a.clip_id AND p.sweep = a.sweep LEFT JOIN one n ON n.clip_id = a.clip_id AND n.frame = a.frame AND n.k = a.k AND n.sweep = a.sweep AND n.point_id = p.point_id
  LEFT JOIN held h ON h.clip_id = a.clip_id AND h.sweep = a.sweep AND h.point_id = p.point_id AND h.track = n.track LEFT JOIN obj o ON o.clip_id = a.clip_id AND o.track = n.track AND o.frame = a.frame
  WHERE NOT coalesce(gone, false)),
cam AS (SELECT clip_id, frame, -y AS x, -(z - 1) AS y, x + 6 AS z FROM moved),
pp AS (SELECT clip_id, frame, {_pixel('x', 'y', 'z', (1, 0, 0))[0]} AS pu, {_pixel('x', 'y', 'z', (1, 0, 0))[1]} AS pv, z AS depth FROM cam WHERE z > 0),
sp AS (SELECT * FROM pp WHERE pu BETWEEN -4 AND {W + 4} AND pv BETWEEN -4 AND {H + 4}),
top AS (SELECT clip_id, frame, max(ln(1 + least(depth, 1000))) + 1e-7 AS top FROM sp GROUP BY ALL),
fw AS (SELECT sp.*, 1 / (exp(ln(1 + least(depth, 1000)) / top * 50) + 1e-7) AS f FROM sp JOIN top USING (clip_id, frame)),
o AS (SELECT *, floor(pu)::INTEGER + a AS u, floor(pv)::INTEGER + b AS v FROM fw, unnest([-2, -1, 0, 1, 2]) AS t(a), unnest([-2, -1, 0, 1, 2]) AS q(b)),
g AS (SELECT clip_id, frame, u, v, sum(depth * f * k) / sum(f * k) AS depth FROM (SELECT *, exp(-0.5::DOUBLE * (pow(pu - u - 0.5::DOUBLE, 2) + pow(pv - v - 0.5::DOUBLE, 2))) AS k FROM o WHERE u BETWEEN 0 AND {W - 1} AND v BETWEEN 0 AND {H - 1}) GROUP BY ALL HAVING sum(f * k) > 0)
SELECT clip_id, frame::INTEGER AS frame, u, v, trunc(least(greatest(depth, 0), 75) / 75 * 255)::INTEGER AS grey FROM g""",
    "splat_projection": f"""WITH {_V}, c AS (SELECT clip_id, -e1 AS x, -(e2 - 1) AS y, e0 + 6 AS z FROM v),
p AS (SELECT clip_id, {_pixel('x', 'y', 'z', (1, 0, 0))[0]} AS pu, {_pixel('x', 'y', 'z', (1, 0, 0))[1]} AS pv, z FROM c WHERE z > 0)
SELECT clip_id, count(*) AS n, round(sum(pu), 4) + 0.0 AS pu, round(sum(pv), 4) + 0.0 AS pv, round(sum(z), 4) + 0.0 AS depth FROM p GROUP BY clip_id""",
    "bev_map": f"""WITH {_V}, {_EDGE}, ego AS (SELECT clip_id, cos(e3) AS c, sin(e3) AS s, e4 AS tx, e5 AS ty FROM v WHERE r = 1),
w AS (
  SELECT clip_id, printf('%04d', r - 1) AS p, e0 AS x1, e1 AS y1, f0 AS x2, f1 AS y2 FROM ed WHERE f0 IS NOT NULL
  UNION ALL SELECT clip_id, '~ego', tx - c, ty - s, tx + c, ty + s FROM ego),
b AS (SELECT clip_id, p AS id, {BEV / 2}::DOUBLE - (c * (y1 - ty) - s * (x1 - tx)) * {BEV / 8}::DOUBLE AS u1, {BEV / 2}::DOUBLE - (c * (x1 - tx) + s * (y1 - ty)) * {BEV / 8}::DOUBLE AS v1,
  {BEV / 2}::DOUBLE - (c * (y2 - ty) - s * (x2 - tx)) * {BEV / 8}::DOUBLE AS u2, {BEV / 2}::DOUBLE - (c * (x2 - tx) + s * (y2 - ty)) * {BEV / 8}::DOUBLE AS v2 FROM w JOIN ego USING (clip_id)),
{_raster_sql(f"s AS (SELECT * FROM b WHERE (u1 >= 0 AND u1 < {BEV} AND v1 >= 0 AND v1 < {BEV}) OR (u2 >= 0 AND u2 < {BEV} AND v2 >= 0 AND v2 < {BEV}))", BEV, BEV, 3, "clip_id, id")},
lines AS (SELECT clip_id, u, v, max(id) AS id FROM hit GROUP BY ALL),
places AS (SELECT clip_id, {BEV / 2}::DOUBLE - (c * (e7 - ty) - s * (e6 - tx)) * {BEV / 8}::DOUBLE AS u, {BEV / 2}::DOUBLE - (c * (e6 - tx) + s * (e7 - ty)) * {BEV / 8}::DOUBLE AS v FROM v JOIN ego USING (clip_id)),
discs AS (SELECT DISTINCT clip_id, floor(u)::INTEGER AS u, floor(v)::INTEGER AS v, 1 AS r FROM places WHERE u >= 0 AND v >= 0 AND u < {BEV} AND v < {BEV} UNION ALL SELECT clip_id, {BEV // 2}, {BEV // 2}, 3 FROM ego),
black AS (SELECT DISTINCT clip_id, u + a AS u, v + b_ AS v FROM discs, unnest(range(-3, 4)) AS t(a), unnest(range(-3, 4)) AS q(b_) WHERE a * a + b_ * b_ <= r * r AND u + a BETWEEN 0 AND {BEV - 1} AND v + b_ BETWEEN 0 AND {BEV - 1})
SELECT clip_id, u::INTEGER AS u, v::INTEGER AS v, 0 AS r, 0 AS g, 0 AS b FROM black UNION ALL
SELECT clip_id, u::INTEGER, v::INTEGER, CASE WHEN id = '~ego' THEN 255 ELSE 10 END, CASE WHEN id = '~ego' THEN 0 ELSE 200 END, CASE WHEN id = '~ego' THEN 0 ELSE 30 END FROM lines ANTI JOIN black USING (clip_id, u, v)""",
}
