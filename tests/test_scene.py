"""Closed-form cases and properties of the scene operators, against plain numpy."""

import io
import json
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import geometry, objects, points, raster, resample
from scenetables.plans import manifest, scenes
from scenetables.sources import scene, sinks, tars
from scenetables.streaming import resume

I16 = [float(x) for x in mat.IDENTITY]


def rz(deg, t=(0, 0, 0)):
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    return [c, -s, 0.0, float(t[0]), s, c, 0.0, float(t[1]), 0.0, 0.0, 1.0, float(t[2]), 0.0, 0.0, 0.0, 1.0]


def random_pose(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = q, rng.normal(size=3)
    return m


def one(spark, *columns, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())).select(*columns).first()


def test_matrices(spark):
    rng = np.random.default_rng(0)
    a, b = (random_pose(rng) for _ in range(2))
    a[:3, :3] += rng.normal(size=(3, 3)) * 0.1
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    r = df.select(mat.mat_mul("a", "b").alias("ab"), mat.affine_inv("a").alias("i"), F.array(*mat.inv_apply("a", [mat.d(1), mat.d(2), mat.d(3)])).alias("p"), mat.nearest_rotation("a").alias("n"), mat.opencv_to_flu(mat.flu_to_opencv("b")).alias("same")).first()
    assert np.allclose(r.ab, (a @ b).ravel()) and np.allclose(r.i, np.linalg.inv(a).ravel())
    assert np.allclose(r.p, (np.linalg.inv(a) @ [1, 2, 3, 1])[:3]) and np.allclose(r.same, b.ravel())
    u, _, v = np.linalg.svd(a[:3, :3])
    assert np.allclose(np.array(r.n).reshape(4, 4)[:3, :3], u @ v, atol=1e-12)
    assert one(spark, mat.flu_to_opencv("m"), m=I16)[0] == [0, 0, 1, 0, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 1]


def test_interpolated_pose(spark):
    df = spark.createDataFrame([(rz(0), rz(90, (3, 0, 0)))], "a array<double>, b array<double>")
    m = mat.with_interpolated_pose(df, "a", "b", mat.d(1 / 3), "m").first().m
    assert np.allclose(m, rz(30, (1, 0, 0)))
    rng = np.random.default_rng(1)
    rows = [(random_pose(rng).ravel().tolist(), random_pose(rng).ravel().tolist()) for _ in range(50)]
    for r in mat.with_interpolated_pose(spark.createDataFrame(rows, "a array<double>, b array<double>"), "a", "b", mat.d(0.3), "m").collect():
        q = np.array(r.m).reshape(4, 4)[:3, :3]
        assert np.allclose(q @ q.T, np.eye(3)) and np.linalg.det(q) > 0.99
    ends = mat.with_interpolated_pose(spark.createDataFrame(rows, "a array<double>, b array<double>"), "a", "b", mat.d(1), "m").collect()
    assert all(np.allclose(r.m, r.b) for r in ends)


def test_upsample_and_extrapolate(spark):
    df = spark.createDataFrame([("c", k, rz(0, (3 * k, 0, 0))) for k in range(3)], "clip_id string, frame int, m array<double>")
    out = resample.extrapolate_poses(resample.upsample_poses(df, ["clip_id"]), ["clip_id"]).orderBy("frame").collect()
    assert [r.frame for r in out] == list(range(9)) and np.allclose([r.m[3] for r in out], range(9))


@pytest.mark.parametrize("overlap,want", [(1, {0: [0, 1, 2, 3], 1: [3, 4, 5, 6], 2: [6, 7, 8, 9]}), (0, {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]})])
def test_chunks(spark, overlap, want):
    got = {}
    for r in resample.chunked(spark.range(10).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("pos")), ["clip_id"], 4, overlap).orderBy("chunk", "pos").collect():
        got.setdefault(r.chunk, []).append(r.pos)
    assert got == want


def test_render_frames_stop_at_max_chunk(spark):
    df = spark.range(50).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame"))
    assert resample.render_frames(df, ["clip_id"], 30, 30, 4, 1, 2).count() == 7
    assert [r.frame for r in resample.render_frames(df, ["clip_id"], 30, 10).orderBy("pos").collect()] == list(range(0, 50, 3))


def keyed(spark, pairs):
    return spark.createDataFrame([("t", "a", f, float(v)) for f, v in pairs], "track string, attr string, frame int, value double")


def spine(spark, frames):
    return spark.createDataFrame([("t", f) for f in frames], "track string, frame int")


def test_hold_linear_bezier(spark):
    k = keyed(spark, [(3, 1), (6, 2)])
    at = lambda way, kf, frames: [r.value for r in resample.evaluate_tracks(spine(spark, frames), kf, way).orderBy("frame").collect()]
    assert at("hold", k, [0, 3, 5, 9]) == [1, 1, 1, 2]
    assert at("linear", k, [0, 3, 4, 9]) == pytest.approx([1, 1, 4 / 3, 2])
    b = at("bezier", keyed(spark, [(0, 0), (10, 5), (20, 0)]), [-1, 5, 10, 15, 25])
    assert b[0] == 0 and b[2] == 5 and b[4] == 0 and b[1] == pytest.approx(b[3])
    assert at("bezier", keyed(spark, [(0, 0), (10, 10)]), [5]) == pytest.approx([5])
    changed = resample.set_keyframes(k, keyed(spark, [(3, 9), (4, 7)]))
    assert {(r.frame, r.value) for r in changed.collect()} == {(3, 9), (4, 7), (6, 2)}
    assert resample.remove_keyframes(changed, changed.filter("frame = 4").select("track", "attr", "frame")).count() == 2


def test_sign_alignment_restarts_at_zero(spark):
    q = lambda f, w, x: ("t", f, float(w), float(x), 0.0, 0.0)
    df = spark.createDataFrame([q(0, 1, 0), q(1, -1, 0), q(2, 1, 0), q(3, 0, -1), q(4, 0, 1)], "track string, frame int, w double, x double, y double, z double")
    out = resample.align_signs(df, ["track"]).orderBy("frame").collect()
    assert [(r.w, r.x) for r in out] == [(1, 0), (1, 0), (1, 0), (0, -1), (0, -1)]


@pytest.mark.parametrize("rotation", ["components", "slerp", "squad"])
def test_pose_tracks_pass_their_keyframes(spark, rotation):
    rows = []
    for k, deg in enumerate([0, 40, 100, 120]):
        h = math.radians(deg) / 2
        s = -1 if k == 2 else 1
        rows.append(("c", 10 * k, float(k), 0.0, 1.0, s * math.cos(h), 0.0, 0.0, s * math.sin(h)))
    kf = spark.createDataFrame(rows, "clip_id string, frame int, x double, y double, z double, qw double, qx double, qy double, qz double")
    sp = spark.range(31).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame"))
    out = {r.frame: np.array(r.m).reshape(4, 4) for r in resample.pose_track(sp, kf, ["clip_id"], rotation=rotation).collect()}
    assert len(out) == 31
    for k, deg in enumerate([0, 40, 100, 120]):
        assert np.allclose(out[10 * k], np.array(rz(deg, (k, 0, 1))).reshape(4, 4), atol=1e-5)
    for m in out.values():
        assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3), atol=1e-4)


def test_novel_trajectory_needs_both_ends(spark):
    kf = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("c", 6, 6.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "clip_id string, frame int, x double, y double, z double, qw double, qx double, qy double, qz double")
    rig = spark.createDataFrame([("c", "side", rz(90, (0, 1, 0)))], "clip_id string, camera string, m array<double>")
    last = spark.createDataFrame([("c", 6)], "clip_id string, last int")
    out = resample.novel_trajectory(kf, last, rig, "linear").orderBy("frame").collect()
    assert len(out) == 7 and np.allclose(out[3].m, rz(90, (3, 1, 0)), atol=1e-5)
    with pytest.raises(Exception, match="first and last"):
        resample.novel_trajectory(kf.filter("frame = 0"), last, rig).collect()


OBJECTS = "clip_id string, frame int, track_id string, object_type string, is_moving boolean, lwh array<double>, m array<double>"


def test_static_cleaning(spark):
    rows = [("c", 3 * k, "t", "Car", False, [length, 2.0, 1.0], rz(yaw, (x, 0, 0))) for k, (length, yaw, x) in enumerate([(4.0, 0, 0), (4.2, 0, 2), (4.4, 180, 100)])]
    rows.append(("c", 9, "t", "Car", True, [9.0, 9.0, 9.0], rz(5, (7, 0, 0))))
    out = objects.clean_static(spark.createDataFrame(rows, OBJECTS)).orderBy("frame").collect()
    for r in out[:3]:
        assert np.allclose(r.lwh, [4.2, 2, 1]) and np.allclose(r.m, rz(0, (1, 0, 0)))
    assert out[3].lwh == [9, 9, 9] and np.allclose(out[3].m, rz(5, (7, 0, 0)))


def test_object_interpolation(spark):
    at = lambda f, t, x: ("c", f, t, "Car", False, [1.0, 1.0, 1.0], rz(0, (x, 0, 0)))
    o = spark.createDataFrame([at(0, "A", 0), at(0, "B", 5), at(3, "A", 3), at(30, "Z", 0)], OBJECTS)
    frames = spark.createDataFrame([("c", f) for f in range(6)], "clip_id string, frame int")
    got = {}
    for r in objects.interpolate_objects(o, frames).collect():
        got.setdefault(r.frame, {})[r.track_id] = round(r.m[3], 6)
    assert got == {0: {"A": 0, "B": 5}, 1: {"A": 1}, 2: {"A": 2}, 3: {"A": 3}, 4: {"A": 3}, 5: {"A": 3}}
    assert objects.unlabelled_frames(o.filter("frame >= 3"), frames).first().n == 3


def test_boxes_hold_and_move_points(spark):
    box = spark.createDataFrame([("c", 0, "t", "Car", True, [4.0, 2.0, 2.0], I16)], OBJECTS)
    p = spark.createDataFrame([("c", 0, k, *map(float, xyz)) for k, xyz in enumerate([(2.4, 0, 0), (2.41, 0, 0), (0, 1.2, 1.2), (1, 0, 0)])], "clip_id string, frame int, point_id long, x double, y double, z double")
    assert {r.point_id for r in points.points_in_boxes(p, box, scale=1.2).collect()} == {0, 2, 3}
    target = spark.createDataFrame([("c", 0, "t", "Car", True, [4.0, 2.0, 2.0], rz(0, (10, 0, 0)))], OBJECTS)
    moved = {r.point_id: (r.x, r.y, r.z) for r in points.moved_with_boxes(p, box, target).collect()}
    assert moved[3] == (11, 0, 0) and moved[1] == (2.41, 0, 0)
    assert {r.point_id for r in points.moved_with_boxes(p, box, target.limit(0)).collect()} == {1}
    same = {r.point_id: r.x for r in points.moved_with_boxes(p, box, box).collect()}
    assert same == pytest.approx({0: 2.4, 1: 2.41, 2: 0, 3: 1})
    plan = points.points_in_boxes(p, box)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan
    with pytest.raises(Exception, match="missing"):
        points.moved_with_boxes(p, box, target.limit(0), strict=True).collect()


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    boxes = [(random_pose(rng), rng.uniform(0.5, 6, 3)) for _ in range(12)]
    for m, _ in boxes:
        m[:3, 3] *= 8
    pts = rng.normal(size=(800, 3)) * 8
    b = spark.createDataFrame([("c", 0, str(k), "Car", True, lwh.tolist(), m.ravel().tolist()) for k, (m, lwh) in enumerate(boxes)], OBJECTS)
    p = spark.createDataFrame([("c", 0, k, *map(float, x)) for k, x in enumerate(pts)], "clip_id string, frame int, point_id long, x double, y double, z double")
    want = {(k, str(j)) for j, (m, lwh) in enumerate(boxes) for k, x in enumerate(pts) if (np.abs((np.linalg.inv(m) @ [*x, 1])[:3]) <= lwh / 2 + 1e-6).all()}
    for cell in (1.0, 8.0):
        assert {(r.point_id, r.track_id) for r in points.points_in_boxes(p, b, cell=cell).collect()} == want


def test_sweeps(spark):
    f = spark.createDataFrame([("c", k) for k in range(7)], "clip_id string, frame int")
    assert [r.s for r in f.select("frame", points.nearest_sweep(F.col("frame"), 3).alias("s")).orderBy("frame").collect()] == [0, 0, 3, 3, 3, 6, 6]
    assert [one(spark, points.nearest_sweep(F.lit(k), 2))[0] for k in (1, 3, 5)] == [0, 4, 4]
    got = [r.sweep for r in points.sweep_window(f, f.filter("frame % 3 = 0")).filter("frame = 0").orderBy("offset").collect()]
    assert got == [0, 0, 0, 0, 3]


def test_cameras(spark):
    px = camera.pinhole_project(*map(mat.d, (100, 100, 50, 40)), [F.col("x"), F.col("y"), F.col("z")])
    assert tuple(one(spark, *px, x=0.5, y=0.5, z=2.0)) == (75, 65)
    assert tuple(one(spark, *px, x=1.0, y=1.0, z=0.0)) == (None, None)
    fw, lin = F.array(*map(mat.d, (0, 100, 0, 0, 0, 0))), F.array(*map(mat.d, (1, 0, 0)))
    u = camera.ftheta_project(fw, lin, mat.d(5), mat.d(6), mat.d(2), mat.d(200), mat.d(100), [mat.d(1), mat.d(0), mat.d(1)])
    assert one(spark, *u)[0] == pytest.approx(5 + 25 * math.pi) and one(spark, *u)[1] == 6
    bw = F.array(*map(mat.d, (0, 0.01, 0, 0, 0, 0)))
    ray, valid = camera.ftheta_unproject(bw, lin, mat.d(5), mat.d(6), mat.d(5 + 25 * math.pi), mat.d(6))
    r = one(spark, *ray, valid)
    assert np.allclose(r[:3], [math.sqrt(0.5), 0, math.sqrt(0.5)]) and r[3]
    centre, ok = camera.ftheta_unproject(bw, lin, mat.d(5), mat.d(6), mat.d(5), mat.d(6))
    assert tuple(one(spark, *centre, ok)) == (0, 0, 1, False)


def test_ftheta_calibration(spark):
    c = spark.createDataFrame([("c", "a", 640.0, 360.0, 1280, 720, [0.0, 1 / 500, 0.0, 2e-10, 0.0, 0.0], True, [1.0, 0.0, 0.0]), ("c", "b", 640.0, 360.0, 1280, 720, [0.0, 500.0, 0.0, -10.0, 0.0, 0.0], False, [1.0, 0.0, 0.0])], "clip_id string, camera string, cx double, cy double, w int, h int, poly array<double>, is_bw boolean, lin array<double>")
    for r in camera.calibrate_ftheta(c).collect():
        for x in np.linspace(10, 600, 7):
            angle = sum(k * x**i for i, k in enumerate(r.bw))
            assert sum(k * angle**i for i, k in enumerate(r.fw)) == pytest.approx(x, abs=0.5)
        assert r.edge_dr > 0
    v = one(spark, camera.parse_ftheta(F.col("v")).alias("s"), v=[640.0, 360.0, 1280.0, 720.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 1.0]).s
    assert v.poly == [0, 1, 2, 3, 4, 5] and v.is_bw and v.lin == [1, 0, 0]


def test_geometry(spark):
    line = lambda *zs: F.array(*(geometry.point(mat.d(x), mat.d(0), mat.d(z)) for x, z in enumerate(zs)))
    z = lambda c: [round(p.z, 6) for p in one(spark, c.alias("v")).v]
    assert z(geometry.near_plane_clipped(line(1, -1))) == [1, 0.1] and z(geometry.near_plane_clipped(line(-1, -1, 1))) == [0.1, 1]
    assert z(geometry.near_plane_clipped(line(-1, -2))) == [] and z(geometry.near_plane_clipped(line(2))) == [2]
    f = spark.range(1).select(F.lit("c").alias("clip_id"), F.array(*(geometry.point(mat.d(x), mat.d(0), mat.d(0)) for x in (0, 3))).alias("vertices"))
    assert sorted(r.x for r in geometry.densified(f, 0.8).collect()) == [0, 1.5, 3]
    ring = one(spark, geometry.closed(F.array(*map(F.lit, "abc"))).alias("r")).r
    assert ring == ["a", "b", "c", "a"]
    box = spark.range(1).withColumn("c", geometry.corners(F.array(*map(mat.d, (4, 2, 2))), F.array(*map(mat.d, I16))))
    assert len(box.select(geometry.box_polyline("c").alias("v")).first().v) == 16
    cut = one(spark, geometry.clipped_to_image(*map(mat.d, (-10, 5, 30, 5)), F.lit(20), F.lit(10)).alias("c")).c
    assert tuple(cut) == (0, 5, 19, 5)
    assert one(spark, *(geometry.depth_shade(mat.d(61.25), F.lit(c)) for c in (98, 183, 249)))[:] == (47, 87, 119)
    assert one(spark, *(geometry.depth_grey(mat.d(c)) for c in (37.5, 80, 0)))[:] == (127, 255, 0)


def test_raw_cuboid(spark):
    s = lambda x, y, z: F.struct(mat.d(x).alias("x"), mat.d(y).alias("y"), mat.d(z).alias("z"))
    v = one(spark, geometry.cuboid_vertices(s(1, 2, 3), s(math.pi / 2, 0, 0), s(2, 4, 6)).alias("v")).v
    assert np.allclose([(p.x, p.y, p.z) for p in v][:2], [(3, 1, 0), (-1, 1, 0)])


def test_rasters(spark):
    p = spark.createDataFrame([(k, 1.2, 2.5, z, 8, 8, *rgb) for k, (z, rgb) in enumerate([(5.0, (0, 0, 255)), (2.0, (255, 0, 0))])], "id int, u double, v double, z double, w int, h int, r int, g int, b int")
    px = raster.z_buffer(p, [])
    assert tuple(px.first()) == (1, 2, 255, 0, 0)
    assert raster.thickened(px, 3, 8, 8, keys=[]).count() == 9 and raster.thickened(px, 1, 8, 8, disc=True, keys=[]).count() == 5
    over = raster.overlay(px, spark.createDataFrame([(1, 2, 255, 100, 0)], "u int, v int, r int, g int, b int"), [])
    assert tuple(over.first()) == (1, 2, 255, 80, 0)
    square = spark.createDataFrame([(1, [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0), (2.0, 2.0)], 9, 9, 9)], "prim_id int, px array<struct<u:double,v:double>>, r int, g int, b int")
    filled = raster.hull_raster(square.withColumn("ring", raster.hull_ring("px")), 8, 8, [])
    assert {(r.u, r.v) for r in filled.collect()} == {(u, v) for u in range(1, 5) for v in range(1, 4)}


def test_map_and_boxes_in_a_camera(spark):
    cam = spark.createDataFrame([("c", "front", f, mat_list, 100.0, 100.0, 64.0, 48.0, 128, 96) for f in (0, 1) for mat_list in [I16]], "clip_id string, camera string, frame int, m array<double>, fx double, fy double, cx double, cy double, w int, h int")
    verts = [(-1.0, 0.5, 4.0), (1.0, 0.5, 4.0), (1.0, 0.5, 9.0), (-1.0, 0.5, 9.0)]
    feats = spark.createDataFrame([("c", "lanes", 0, verts[:2]), ("c", "lanelines", 1, verts[1:3]), ("c", "crosswalks", 2, verts), ("c", "lanes", 3, [(0.0, 0.0, -5.0), (0.0, 0.0, -9.0)])], "clip_id string, layer string, feature_id int, vertices array<struct<x:double,y:double,z:double>>")
    objs = spark.createDataFrame([("c", 0, "t", "Bus", True, [1.0, 1.0, 1.0], rz(0, (0, 0, 6)))], OBJECTS)
    out = raster.hdmap_condition(feats, objs, cam, 128, 96)
    n = {r.frame: r.n for r in out.groupBy("frame").agg(F.count("*").alias("n")).collect()}
    assert n[1] > 100 and n[0] > n[1] and out.filter("u < 0 OR u > 127 OR v < 0 OR v > 95").count() == 0
    with pytest.raises(Exception, match="unknown layer"):
        raster.draw_map(feats.withColumn("layer", F.lit("rivers")), cam, 128, 96).collect()


def test_lidar_condition(spark):
    rng = np.random.default_rng(5)
    pts = [("c", f, k, *map(float, x)) for f in (0, 3) for k, x in enumerate(rng.normal(size=(60, 3)) * [1, 1, 0.3] + [0, 0, 6])]
    p = spark.createDataFrame(pts, "clip_id string, frame int, point_id long, x double, y double, z double")
    sweeps = spark.createDataFrame([("c", f, I16) for f in (0, 3)], "clip_id string, frame int, m array<double>")
    objs = spark.createDataFrame([("c", f, "t", "Car", True, [1.0, 1.0, 1.0], rz(0, (0.1 * f, 0, 6))) for f in range(4)], OBJECTS)
    frames = spark.createDataFrame([("c", f) for f in range(4)], "clip_id string, frame int")
    cams = spark.createDataFrame([("c", "front", f, I16, 50.0, 50.0, 32.0, 24.0) for f in range(4)], "clip_id string, camera string, frame int, m array<double>, fx double, fy double, cx double, cy double")
    out = points.lidar_condition(p, sweeps, objs, frames, cams, 64, 48)
    grey = [r.grey for r in out.collect()]
    assert len(grey) > 200 and 10 < np.median(grey) < 30


def test_tar_round_trip_and_scans(spark, tmp_path):
    o = spark.createDataFrame([("c1", f, t, "Car", t == "b", [1.0, 2.0, 3.0], rz(10 * f)) for f in (0, 3) for t in "ab"], OBJECTS)
    packed = sinks.sample_tars(sinks.object_members(o)).collect()
    folder = tmp_path / "all_object_info"
    folder.mkdir()
    for r in packed:
        (folder / f"{r.clip_id}.tar").write_bytes(r.tar)
    back = scene.objects(scene.read_tars(spark, f"file://{tmp_path}", "all_object_info"))
    key = lambda r: (r.frame, r.track_id)
    for a, b in zip(sorted(o.collect(), key=key), sorted(back.collect(), key=key)):
        assert (a.clip_id, a.frame, a.track_id, a.object_type, a.is_moving, a.lwh) == (b.clip_id, b.frame, b.track_id, b.object_type, b.is_moving, b.lwh) and np.allclose(a.m, b.m)
    npy, npz = io.BytesIO(), io.BytesIO()
    np.save(npy, np.eye(4))
    np.savez(npz, xyz=np.arange(6.0).reshape(2, 3), lidar_to_world=np.eye(4))
    pose, lidar = tmp_path / "pose", tmp_path / "lidar_raw"
    for d, members in ((pose, {"000000.pose.front.npy": npy, "000003.pose.front_left.npy": npy}), (lidar, {"000003.lidar_raw.npz": npz})):
        d.mkdir()
        with tarfile.open(d / "c1.tar", "w") as tar:
            for name, content in members.items():
                info = tarfile.TarInfo(f"c1.{name}")
                info.size = len(content.getvalue())
                tar.addfile(info, io.BytesIO(content.getvalue()))
    m = scene.read_tars(spark, f"file://{tmp_path}", "pose")
    got = scene.camera_poses(m, "front").collect()
    assert [(r.frame, r.m) for r in got] == [(0, I16)] and scene.camera_poses(m).count() == 2
    pts, sweeps = scene.lidar_tables(tars.read_lidar(spark, str(lidar / "c1.tar")))
    assert sorted((r.frame, r.point_id, r.x, r.z) for r in pts.collect()) == [(3, 0, 0, 2), (3, 1, 3, 5)] and sweeps.first().m == I16
    listing = scene.files(spark, f"file://{tmp_path}")
    assert scene.in_folders(listing, ["pose"], {"lidar": ["lidar_raw"]}, ["lidar"]).count() == 2
    with pytest.raises(ValueError, match="radar"):
        scene.in_folders(listing, [], {}, ["radar"])
    assert [r.clip_id for r in scene.clip_list(spark, listing=listing).collect()] == ["c1"]


def test_map_layer_scan(spark):
    def shape(kind, body):
        return {"labelData": {"shape3d": {kind: body}}}

    cube = {"center": {"x": 0, "y": 0, "z": 0}, "orientation": {"x": 0, "y": 0, "z": 0}, "dimensions": {"x": 2, "y": 2, "z": 2}}
    text = json.dumps({"labels": [shape("polyline3d", {"vertices": [[0, 0, 0], [1, 0, 0]]}), shape("cuboid3d", cube), shape("surface", {"vertices": [[0, 0, 0], [1, 0, 0], [1, 1, 0]]})]})
    df = spark.createDataFrame([("c", "lanes", text)], "clip_id string, layer string, json string")
    got = {r.feature_id: (r.geom_type, len(r.vertices)) for r in scene.map_features(df).collect()}
    assert got == {0: ("polyline", 2), 1: ("cuboid3d", 8), 2: ("polygon", 3)}
    assert scene.vertices_anywhere(df).count() == 2


def test_caption_scans(spark, tmp_path):
    (tmp_path / "a.b.json").write_text(json.dumps({"original": "x", "Night": "y"}))
    (tmp_path / "seg_0.txt").write_text("a car\nturns")
    (tmp_path / "wide.csv").write_text('k1,k2\n"t, 1",t2\n')
    assert {(r.clip_id, r.variation, r.text) for r in scene.variations(spark, f"{tmp_path}/*.json").collect()} == {("a", "original", "x"), ("a", "Night", "y")}
    assert [tuple(r) for r in scene.captions(spark, f"{tmp_path}/*.txt", "_0.txt").collect()] == [("seg_0", "a car\nturns")]
    assert {tuple(r) for r in scene.wide_csv(spark, f"{tmp_path}/wide.csv").collect()} == {("k1", "t, 1"), ("k2", "t2")}
    texts = spark.createDataFrame([(json.dumps({"k_front": "f", "k_front_left": "fl", "k_zz": "n"}),)], "json string")
    views = spark.createDataFrame([("front",), ("front_left",), ("left",)], "view string")
    assert {tuple(r) for r in scene.multiview_captions(texts, views).collect()} == {("k", "front", "f"), ("k", "front_left", "fl")}


def test_names_and_captions(spark):
    s = lambda c, **v: one(spark, c.alias("x"), **v).x
    assert s(manifest.cleaned_caption(F.col("t")), t="Rewritten Caption: a\nb   c") == "a b  c"
    assert s(manifest.video_key(F.col("t")), t="seg_0") == "seg" and s(manifest.video_key(F.col("t")), t="seg_12") == "seg_12"
    assert s(manifest.chunk_suffix(F.col("t")), t="seg_12") == "_12"
    assert s(manifest.after_marker(F.col("t")), t="x New caption: y New caption: z") == " z" and s(manifest.after_marker(F.col("t")), t="none") is None
    assert s(manifest.without_thinking(F.col("t")), t="<think>\n\n</think>\n\nhello") == "hello"
    assert s(manifest.clip_from_record(F.col("t")), t="segment-123_with_camera_labels") == "123" and s(manifest.snake_case(F.col("t")), t="roadLine") == "road_line"


def test_complete_views(spark):
    views = manifest.view_table(spark, ["a", "b", "c"])
    rows = [("x", "hdmap", v, f"x/{v}") for v in "cab"] + [("y", "hdmap", v, f"y/{v}") for v in "ab"] + [("x", "hdmap", "a", "x/z")]
    listing = spark.createDataFrame(rows, "clip_id string, kind string, view string, path string")
    out = manifest.complete_views(listing, views, ["hdmap"]).collect()
    assert [(r.clip_id, r.paths) for r in out] == [("x", {"hdmap": ["x/a", "x/b", "x/c"]})]


def test_inference_retries(spark):
    def make():
        seen = {}

        def model(b):
            out = []
            for k in b["id"]:
                seen[k] = seen.get(k, 0) + 1
                out.append(f"ok {k}" if k == 0 or k == 1 and seen[k] == 3 else "bad")
            return out

        return model

    got = {r.id: (r.response, r.error) for r in manifest.batch_infer(spark.range(3).coalesce(1), make, lambda x: x.startswith("ok")).collect()}
    assert got == {0: ("ok 0", None), 1: ("ok 1", None), 2: (None, "not accepted")}


def test_pairs_by_name(spark):
    a = spark.createDataFrame([("v1", "r/v1", 5)], "name string, path string, n_frames int")
    assert manifest.paired_by_name(a, a).count() == 1
    with pytest.raises(Exception, match="no equal partner"):
        manifest.paired_by_name(a, a.withColumn("name", F.lit("v2"))).collect()


def test_masks(spark):
    px = spark.createDataFrame([("i", u, 0) for u in range(10)], "image string, u int, v int")
    r = spark.createDataFrame([("i", 0, 0, 1, 0), ("i", 5, 0, 6, 0)], "image string, u0 int, v0 int, u1 int, v1 int")
    gone = lambda how: {x.u for x in points.removal_mask(px, r, ["image"], how).filter("removed").collect()}
    assert gone("any") == {0, 1, 5, 6} and gone("all") == set()


def test_conversion_and_rendering_jobs(spark):
    n = 5
    vehicle = spark.createDataFrame([("c", f, rz(0, (float(f), 0, 0))) for f in range(n)], "clip_id string, frame int, m array<double>")
    ext = spark.createDataFrame([("c", "front", I16)], "clip_id string, camera string, m array<double>")
    cal = spark.createDataFrame([("c", 0, "FRONT", 50.0, 50.0, 32.0, 24.0, 64, 48)], "clip_id string, frame int, name string, fx double, fy double, cx double, cy double, w int, h int")
    line = [(x, y, 0.0) for x, y in ((6.0, -3.0), (6.0, 3.0))]
    feats = spark.createDataFrame([("c", 0, 0, "lane", line, None), ("c", 0, 1, "speed_bump", line, None)], "clip_id string, frame int, feature_id int, kind string, polyline array<struct<x:double,y:double,z:double>>, polygon array<struct<x:double,y:double,z:double>>")
    lab = spark.createDataFrame([("c", f, "t", "vehicle", True, 0.0, 8.0, 0.0, 0.0, 2.0, 1.0, 1.0, 1.0, 0.0, 0.0, rz(0, (float(f), 0, 0))) for f in range(n)] + [("c", 0, "u", "sign", True, *[0.0] * 10, I16)], "clip_id string, frame int, track_id string, type string, synced boolean, heading double, cx double, cy double, cz double, l double, w double, h double, vx double, vy double, vz double, vehicle_m array<double>")
    times = spark.createDataFrame([("c", f, 1_000_000 * f) for f in range(n)], "clip_id string, frame int, micros long")
    t = scenes.converted(vehicle, ext, cal, feats, lab, times)
    assert t["camera_pose"].count() == 3 * n and t["objects"].count() == n and t["map_features"].count() == 1
    intr = t["intrinsics"].select("clip_id", "camera", *(F.col("v")[i].alias(k) for i, k in enumerate(("fx", "fy", "cx", "cy"))), F.col("v")[4].cast("int").alias("w"), F.col("v")[5].cast("int").alias("h"))
    settings = sinks.settings(json.dumps({"INPUT_POSE_FPS": 30, "TARGET_RENDER_FPS": 30, "TARGET_CHUNK_FRAME": 4, "OVERLAP_FRAME": 0}))
    out = scenes.rendered_map(t["camera_pose"], intr, t["objects"], t["map_features"], settings, 64, 48)
    assert {r.chunk for r in out.select("chunk").distinct().collect()} == {0, 1, 2}
    videos = spark.createDataFrame([("c", "front", 9)], "clip_id string, camera string, n_frames int")
    assert scenes.video_chunks(videos, settings).count() == 8


def test_growing_folder(spark, tmp_path):
    src, dst, chk = (str(tmp_path / x) for x in ("src", "dst", "chk"))
    step = lambda: resume.process_new(spark, src, "id long", lambda d: d.withColumn("x", F.col("id") * 2), dst, chk)
    spark.range(3).write.parquet(src)
    step()
    spark.range(3, 5).write.mode("append").parquet(src)
    step()
    step()
    assert sorted(r.x for r in spark.read.parquet(dst).collect()) == [0, 2, 4, 6, 8]


def test_scene_files_by_bucket(spark, tmp_path):
    df = spark.createDataFrame([(f"c{k % 7}", k) for k in range(50)], "clip_id string, frame int")
    sinks.write_scene(df, str(tmp_path / "t"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50
    assert sinks.remaining(df, df.filter("frame < 40"), ["clip_id", "frame"]).count() == 10
