"""Further cases of the scene operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import geometry, objects, points, raster, resample
from scenetables.plans import manifest
from scenetables.sources import scene, tars
from test_scene import I16, OBJECTS, one, rz


def test_grounded_poses(spark):
    tilted = mat.pose(mat.euler_zyx(mat.d(0.5), mat.d(0.2), mat.d(0.1)), [mat.d(1), mat.d(2), mat.d(3)])
    df = spark.range(1).select(tilted.alias("m"))
    r = df.select(mat.grounded("m").alias("a"), mat.grounded(mat.flu_to_opencv("m"), mat.d(9), "opencv").alias("b")).first()
    assert np.allclose(r.a, rz(math.degrees(0.5), (1, 2, 3)))
    back = spark.createDataFrame([(r.b,)], "m array<double>").select(mat.opencv_to_flu("m").alias("m")).first().m
    assert np.allclose(back, rz(math.degrees(0.5), (1, 2, 9)))
    with pytest.raises(ValueError, match="ned"):
        mat.grounded("m", convention="ned")


def test_axis_angle(spark):
    m = one(spark, mat.axis_angle(mat.d(math.pi / 2), F.lit("z"), [mat.d(1), mat.d(0), mat.d(0)]).alias("m")).m
    assert np.allclose(m, rz(90, (1, 0, 0)))
    with pytest.raises(Exception, match="unknown axis"):
        one(spark, mat.axis_angle(mat.d(1), F.lit("w"), [mat.d(0)] * 3))


def test_spin_and_rig(spark):
    kf = spark.createDataFrame([("c", 0, 0.0), ("c", 2, math.pi)], "clip_id string, frame int, value double")
    sp = spark.range(3).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame"))
    track = resample.spin_track(sp, kf, ["clip_id"], "z")
    assert np.allclose({r.frame: r.m for r in track.collect()}[1], rz(90))
    cams = spark.createDataFrame([("c", "front", 0, rz(10)), ("c", "side", 0, rz(40, (0, 1, 0)))], "clip_id string, camera string, frame int, m array<double>")
    got = {(r.camera, r.frame): r.m for r in resample.expand_rig(track, cams, "front").collect()}
    want = np.array(rz(90)).reshape(4, 4) @ np.linalg.inv(np.array(rz(10)).reshape(4, 4)) @ np.array(rz(40, (0, 1, 0))).reshape(4, 4)
    assert np.allclose(got["side", 1], want.ravel()) and np.allclose(got["front", 1], rz(90))


def test_objects_at_labels(spark):
    o = spark.createDataFrame([("c", f, "t", "Car", True, [1.0] * 3, rz(0, (f, 0, 0))) for f in (0, 3)], OBJECTS)
    f = spark.createDataFrame([("c", k) for k in range(5)], "clip_id string, frame int")
    assert {r.frame: r.m[3] for r in objects.objects_at(o, f).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_pinhole_model(spark):
    r = one(spark, *camera.pinhole_rescale(*map(mat.d, (100, 110, 50, 40, 101, 81)), mat.d(0.5), mat.d(0.5)))
    assert tuple(r) == (50, 55, 25, 20, 50, 40)
    fov = one(spark, *camera.pinhole_fov(mat.d(50), mat.d(40), mat.d(100), mat.d(80)))
    assert np.allclose(fov, math.pi / 2)
    k = one(spark, camera.pinhole_matrix(*map(mat.d, (100, 110, 50, 40))).alias("k"), camera.pinhole_inverse_matrix(*map(mat.d, (100, 110, 50, 40))).alias("i"))
    assert np.allclose(np.array(k.k).reshape(3, 3) @ np.array(k.i).reshape(3, 3), np.eye(3))


def test_rays(spark):
    i = spark.createDataFrame([("c", "front", 2.0, 2.0, 1.0, 1.0, 2, 2)], "clip_id string, camera string, fx double, fy double, cx double, cy double, w int, h int")
    g = camera.ray_grid(i)
    rays = {(r.u, r.v): (r.x, r.y, r.z) for r in g.collect()}
    assert len(rays) == 4 and np.allclose(rays[0, 0], np.array([-0.25, -0.25, 1]) / np.linalg.norm([-0.25, -0.25, 1]))
    p = spark.createDataFrame([("c", "front", 0, rz(90, (5, 6, 7)))], "clip_id string, camera string, frame int, m array<double>")
    r = camera.posed_rays(g, p).filter("u = 0 AND v = 0").first()
    assert (r.ox, r.oy, r.oz) == (5, 6, 7) and np.allclose((r.x, r.y), (-rays[0, 0][1], rays[0, 0][0]))


def test_ftheta_helpers(spark):
    poly = F.array(*map(mat.d, (0, 2, 4)))
    back = one(spark, *camera.ftheta_rescale(poly, F.lit(True), *map(mat.d, (10, 20, 40, 60)), mat.d(0.5), mat.d(0.5)))
    assert back[0] == [0, 4, 16] and tuple(back[1:]) == (5, 10, 20, 30)
    with pytest.raises(Exception, match="aspect"):
        one(spark, *camera.ftheta_rescale(poly, F.lit(True), *map(mat.d, (10, 20, 40, 60)), mat.d(0.5), mat.d(0.6)))
    f = camera.ftheta_fov(F.array(mat.d(0), mat.d(0.01)), F.array(*map(mat.d, (1, 0, 0))), mat.d(50), mat.d(40), F.lit(101), F.lit(81))
    r = one(spark, f["h"].alias("h"), f["v"].alias("v"), f["max_angle"].alias("m"))
    assert np.allclose((r.h, r.v, r.m), (1.0, 0.8, 0.01 * math.hypot(50, 40)))
    rig = {"rig": {"sensors": [{"name": "front", "properties": {"Model": "ftheta", "bw-poly": "0 0.001 0", "cx": "5", "cy": "6", "width": "10", "height": "12"}}, {"name": "lidar", "properties": {"Model": "lidar"}}]}}
    df = spark.createDataFrame([("c", json.dumps(rig))], "clip_id string, json string")
    got = camera.rig_cameras(df).collect()
    assert [(r.camera, r.cx, r.w, r.poly, r.is_bw, r.lin) for r in got] == [("front", 5, 10, [0, 0.001, 0], True, [1, 0, 0])]


def test_culls_and_crops(spark):
    rows = [("a", 5.0, 5.0, 1.0), ("a", 99.0, 5.0, 1.0), ("b", 5.0, 5.0, -1.0), ("b", 6.0, 6.0, -2.0), ("c", 5.0, 5.0, 200.0), ("c", 6.0, 5.0, 150.0), ("d", 5.0, 5.0, -1.0), ("d", 99.0, 5.0, 2.0)]
    p = spark.createDataFrame(rows, "prim string, u double, v double, z double").withColumn("w", F.lit(10)).withColumn("h", F.lit(10))
    assert {r.prim for r in geometry.visible(p, ["prim"], 2).collect()} == {"a", "d"}
    assert {r.prim for r in geometry.visible(p, ["prim"], 2, hull=True).collect()} == {"a"}
    px = spark.createDataFrame([(u, 3) for u in range(10)], "u int, v int")
    assert {r.u for r in geometry.center_cropped(px, 10, 8, 4, 4).collect()} == {0, 1, 2, 3}


def test_birds_eye_map(spark):
    seg = spark.createDataFrame([("c", 0, 0, (-5.0, 3.0, 0.0), (5.0, 3.0, 0.0), 200, 0, 0), ("c", 1, 0, (90.0, 0.0, 0.0), (99.0, 0.0, 0.0), 0, 200, 0)], "clip_id string, prim_id int, seg_id int, p0 struct<x:double,y:double,z:double>, p1 struct<x:double,y:double,z:double>, r int, g int, b int")
    egos = spark.createDataFrame([("c", 0, I16)], "clip_id string, frame int, m array<double>")
    out = {(r.u, r.v): (r.r, r.g, r.b) for r in raster.bev_map(seg, egos, 60, 60.0).collect()}
    assert out[30, 30] == (255, 0, 0) and out[27, 28] == (200, 0, 0) and all(c[1] in (0, 255) for c in out.values())


def test_default_intrinsics(spark):
    cams = spark.createDataFrame([("c", "front"), ("c", "side"), ("c", "roof")], "clip_id string, camera string")
    own = spark.createDataFrame([("c", "front", [1.0])], "clip_id string, camera string, values array<double>")
    rig = spark.createDataFrame([("rig_side", [2.0])], "camera string, values array<double>")
    names = spark.createDataFrame([("side", "rig_side"), ("roof", "rig_roof")], "camera string, rig_camera string")
    got = {r.camera: (r["values"], r.is_default) for r in scene.with_default_intrinsics(cams, own, rig, names).collect()}
    assert got == {"front": ([1.0], False), "side": ([2.0], True), "roof": (None, False)}


def test_task_lists(spark):
    cap = spark.createDataFrame([("a", "Night", "t"), ("b", "Night", "t"), ("c", "Night", "t")], "clip_id string, variation string, text string")
    views = manifest.view_table(spark, ["l", "r"])
    listing = spark.createDataFrame([(c, "hdmap", v, f"{c}/{v}") for c in "ab" for v in "lr"] + [("c", "hdmap", "l", "c/l")], "clip_id string, kind string, view string, path string")
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "clip_id string")
    done = spark.createDataFrame([("b_Night",)], "output string")
    assert [r.output for r in manifest.multiview_tasks(cap, listing, views, inputs, done).collect()] == ["a_Night"]
    todo = manifest.caption_tasks(cap.select("clip_id", "text"), spark.createDataFrame([("a",)], "clip_id string"))
    assert todo.count() == 14
    chat = manifest.chat_prompts(todo, "sys", "Caption: %s Kind: %s").filter("variation = 'Foggy'").first().messages
    assert [(m.role, m.content) for m in chat] == [("system", "sys"), ("user", "Caption: t Kind: Foggy")]
    said = spark.createDataFrame([("a", "Night", "New caption: x\ny"), ("b", "Night", "no")], "clip_id string, variation string, response string")
    assert [tuple(r) for r in manifest.rewritten(said).collect()] == [("a", "Night", " x y")]
    emb = spark.createDataFrame([([[1.0], [2.0], [0.0]], [1, 1, 0])], "embedding array<array<double>>, mask array<int>")
    r = manifest.truncated_embeddings(emb).first()
    assert r.embedding == [[1.0], [2.0]] and r.mask == [1, 1] and r.n_tokens == 2
    caps = spark.createDataFrame([("pinhole_front", "seg", "a car"), ("pinhole_front", "zz", "none")], "view string, key string, text string")
    vids = spark.createDataFrame([("pinhole_front", "seg_0", "p/seg_0.mp4")], "view string, stem string, path string")
    e = manifest.embedding_tasks(caps, vids, spark.createDataFrame([], "view string, key string")).collect()
    assert [(r.key, r.chunk, r.path) for r in e] == [("seg", "_0", "p/seg_0.mp4")] and e[0].prompt.endswith("facing forward. a car")


def test_near_points_and_returns(spark):
    p = spark.createDataFrame([("TOP", 1.0, 2.0, 2.0), ("TOP", 1.0, 1.0, 1.0), ("SIDE", 9.0, 0.0, 0.0)], "sensor string, x double, y double, z double")
    both = points.merged_returns(p, p)
    assert both.count() == 4 and points.near_filtered(both).count() == 2


def test_camera_models_together(spark):
    """A pinhole camera, and f-theta cameras from vectors of either direction that mean the same lens."""
    fw, bw = [0.0, 100.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.01, 0.0, 0.0, 0.0, 0.0]
    vectors = spark.createDataFrame([("c", "a", [32.0, 24.0, 64.0, 48.0, *fw, 0.0]), ("c", "b", [32.0, 24.0, 64.0, 48.0, *bw, 1.0, 1.0, 0.0, 0.0]), ("c", "none", None)], "clip_id string, camera string, values array<double>")
    small = camera.ftheta_models(vectors, 32, 24)
    pin = spark.createDataFrame([("c", "p", 50.0, 50.0, 16.0, 12.0, 32, 24)], "clip_id string, camera string, fx double, fy double, cx double, cy double, w int, h int")
    every = camera.camera_models(pin, small)
    assert every.count() == 3
    rows = every.withColumn("p", F.struct(mat.d(0.2).alias("x"), mat.d(-0.1).alias("y"), mat.d(2).alias("z")))
    u, v = camera.project(camera.model_columns(rows), F.col("p"))
    got = {r.camera: (r.u, r.v) for r in rows.select("camera", u.alias("u"), v.alias("v")).collect()}
    assert got["p"] == pytest.approx((21, 9.5))
    angle, flat = math.atan2(math.hypot(0.2, 0.1), 2), math.hypot(0.2, 0.1)
    for c in "ab":
        assert got[c] == pytest.approx((16 + 50 * angle * 0.2 / flat, 12 - 50 * angle * 0.1 / flat), abs=1e-3)


def test_ftheta_intrinsics_from_tars(spark, tmp_path):
    import io
    import tarfile

    (tmp_path / "ftheta_intrinsic").mkdir()
    with tarfile.open(tmp_path / "ftheta_intrinsic" / "c.tar", "w") as tar:
        out = io.BytesIO()
        np.save(out, np.arange(14.0))
        info = tarfile.TarInfo("c.ftheta_intrinsic.front.npy")
        info.size = len(out.getvalue())
        tar.addfile(info, io.BytesIO(out.getvalue()))
    r = scene.ftheta_intrinsics(scene.read_tars(spark, str(tmp_path), "ftheta_intrinsic")).first()
    assert (r.clip_id, r.camera, r["values"]) == ("c", "front", list(map(float, range(14))))


def test_lidar_by_uri(spark, tmp_path):
    import io
    import tarfile

    path = tmp_path / "c.tar"
    with tarfile.open(path, "w") as tar:
        out = io.BytesIO()
        np.savez(out, xyz=np.ones((2, 3)), lidar_to_world=np.eye(4))
        info = tarfile.TarInfo("c.000003.lidar_raw.npz")
        info.size = len(out.getvalue())
        tar.addfile(info, io.BytesIO(out.getvalue()))
    for at in (str(path), f"file://{path}"):
        r = tars.read_lidar(spark, at).first()
        assert (r.clip_id, r.frame, len(r.points)) == ("c", 3, 2)


def test_settings_by_mode():
    from scenetables.sources import sinks

    text = '{"INPUT_POSE_FPS": 30, "POST_TRAINING": {"MAX_CHUNK": 2, "OVERLAP_FRAME": 1}, "NOT_POST_TRAINING": {"OVERLAP_FRAME": 0}}'
    assert sinks.settings(text, True) == {"INPUT_POSE_FPS": 30, "MAX_CHUNK": 2, "OVERLAP_FRAME": 1}
    assert sinks.settings(text, False) == {"INPUT_POSE_FPS": 30, "MAX_CHUNK": -1, "OVERLAP_FRAME": 0}
    with pytest.raises(KeyError):
        sinks.settings("{}", True)


def test_embeddings_by_view_and_chunk(spark, tmp_path):
    from scenetables.sources import sinks

    rows = spark.createDataFrame([("front", "c", "_0", "a car", [[1.0]]), ("front", "c", "_1", "a bus", [[2.0]]), ("left", "d", "_0", "a tram", [[3.0]])], "view string, clip_id string, chunk string, text string, embedding array<array<double>>")
    sinks.write_embeddings(rows, str(tmp_path / "e"), 4)
    back = spark.read.parquet(str(tmp_path / "e"))
    assert {(r.view, r.name, r.text, r.embedding[0][0]) for r in back.collect()} == {("front", "c_0", "a car", 1.0), ("front", "c_1", "a bus", 2.0), ("left", "d_0", "a tram", 3.0)}
    todo = sinks.remaining(rows.withColumn("name", F.concat("clip_id", "chunk")), back.filter("chunk = '_0'"), ["view", "name"])
    assert [r.name for r in todo.collect()] == ["c_1"]


def test_brackets_take_linear_time(spark):
    """A clip of 100,000 frames with few labels; a frame from each row to the clip's end would take minutes."""
    import time

    sp = spark.range(100_000).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame"))
    labels = sp.filter("frame % 30000 = 7")
    began = time.time()
    r = resample.bracket(sp, labels, ["clip_id"]).agg(F.count("*").alias("n"), F.sum("prev").alias("p"), F.sum("next").alias("x")).first()
    assert r.n == 100_000 and time.time() - began < 60
    assert r.p == 30000 * 7 + 30000 * 30007 + 30000 * 60007 + (100_000 - 90007) * 90007 and r.x == 8 * 7 + 30000 * (30007 + 60007 + 90007)


def test_points_in_boxes_of_all_sizes(spark):
    """Boxes from centimetres to a kilometre against all pairs; a box is sent to four cells at most."""
    r = np.random.default_rng(11)
    boxes = []
    for k in range(60):
        lwh = (10 ** r.uniform(-2, 3, 3)).tolist()
        boxes.append(("c", k % 2, f"t{k:02d}", "Car", True, lwh, rz(float(r.uniform(0, 360)), [*r.uniform(-300, 300, 2).tolist(), float(r.uniform(-5, 5))])))
    boxes += [("c", 0, "nan", "Car", True, [math.nan, 1.0, 1.0], rz(0)), ("c", 0, "far", "Car", True, [1.0, 1.0, 1.0], rz(0, (math.inf, 0, 0)))]
    p = [("c", k % 2, k, *map(float, r.uniform(-400, 400, 2)), float(r.uniform(-5, 5))) for k in range(1500)] + [("c", 0, 9999, math.nan, 0.0, 0.0)]
    b = spark.createDataFrame(boxes, OBJECTS)
    pts = spark.createDataFrame(p, "clip_id string, frame int, point_id long, x double, y double, z double")
    got = sorted((x.point_id, x.track_id) for x in points.points_in_boxes(pts, b, scale=1.1, cell=2.0).collect())

    def holds(box, q):
        m = np.array(box[6]).reshape(4, 4)
        local = np.linalg.inv(m[:3, :3]) @ (np.array(q) - m[:3, 3])
        return bool((np.abs(local) <= np.array(box[5]) / 2 * 1.1 + 1e-6).all())

    want = sorted((q[2], box[2]) for q in p[:-1] for box in boxes[:60] if q[1] == box[1] and holds(box, q[3:]))
    assert len(want) > 80 and got == want
    cells = b.limit(60).withColumn("bm", F.col("m")).select(points._bounds(1.1, 2.0).alias("b"))
    for row in cells.collect():
        side = 2.0 * 2**row.b.level
        assert all(math.floor((a + x) / side) - math.floor((a - x) / side) <= 1 for a, x in zip(row.b.at, row.b.reach))


def test_layout_goes_by_size(spark, tmp_path, monkeypatch):
    """One clip holds most rows: tasks and files stay bounded, its rows stay in one bucket, in order; small tables are one file."""
    from scenetables.sources import sinks

    rows = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 97).cast("string"))).alias("clip_id"), F.col("id").cast("int").alias("frame"), F.col("id").cast("double").alias("x"))
    small = sinks.write_scene(rows.limit(100), str(tmp_path / "s"))
    assert (small.buckets, small.tasks) == (1, 1)
    monkeypatch.setattr(sinks, "BUCKET_BYTES", 200_000)
    monkeypatch.setattr(sinks, "TASK_BYTES", 100_000)
    monkeypatch.setattr(sinks, "FILE_BYTES", 60_000)
    plan = sinks.write_scene(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).withColumn("file", F.input_file_name())
    assert plan.buckets == 8 and 10 <= plan.tasks <= 14 and back.count() == 60_000
    files = back.groupBy("file", "bucket").agg(F.count("*").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b")).collect()
    assert max(f.n for f in files) <= plan.rows_per_file < 4000
    assert all(r.n == 1 for r in back.groupBy("clip_id").agg(F.countDistinct("bucket").alias("n")).collect())
    hot = back.filter("clip_id = 'hot'").groupBy("file").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).orderBy("a").collect()
    assert len(hot) > 5 and all(p.b < q.a for p, q in zip(hot, hot[1:]))


def test_files_of_rows(spark, tmp_path):
    from scenetables.sources import tars

    rows = spark.createDataFrame([("a.txt", b"one"), ("b.json", b"{}"), ("c", None)], "name string, bytes binary")
    tars.write_files(rows, f"file://{tmp_path}/f")
    (tmp_path / "f" / "a.txt").write_text("mine")
    tars.write_files(rows, f"file://{tmp_path}/f")
    assert {p.name: p.read_text() for p in (tmp_path / "f").iterdir()} == {"a.txt": "mine", "b.json": "{}", "c": ""}
    tars.write_files(rows, str(tmp_path / "f"), replace=True)
    assert (tmp_path / "f" / "a.txt").read_text() == "one"
