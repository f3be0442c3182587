"""Visibility tiles against all pairs, and images filled by kernels against the relational forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import dense, geometry, points, raster, tiles

W, H = 64, 48
MODEL = "clip_id string, camera string, frame int, m array<double>, fx double, fy double, cx double, cy double, fw array<double>, lin array<double>, max_angle double, edge_r double, edge_dr double"


def turned(yaw, pitch, at, scale=1.0):
    """Camera poses in image axes, looking along yaw."""
    c, s, p, q = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ np.array([[p, 0, q], [0, 1, 0], [-q, 0, p]])
    cols = np.stack([-r[:, 1], -r[:, 2], r[:, 0]], axis=1) * scale
    return [*map(float, [*cols[0], at[0], *cols[1], at[1], *cols[2], at[2], 0, 0, 0, 1])]


def scene(spark, seed=0, n=300, spread=700.0):
    """Cameras of both models, some tilted, scaled or beyond any bound, among features of all sizes."""
    r = np.random.default_rng(seed)
    fw = [0.0, 30.0, 0.0, 1.5, 0.0, -0.2]
    edge = lambda a: (sum(c * a**k for k, c in enumerate(fw)), sum(k * c * a ** (k - 1) for k, c in enumerate(fw) if k))
    cams = []
    for k in range(24):
        m = turned(r.uniform(0, 6.3), r.uniform(-0.3, 0.3), [*r.uniform(-spread, spread, 2), 1.5], 1.1 if k % 5 == 0 else 1.0)
        if k % 3:
            cams.append(("c", "p", k, m, 40.0, 38.0, 30.0, 25.0, None, None, None, None, None))
        else:
            a = 1.5 if k == 3 else 1.1
            cams.append(("c", "w", k, m, None, None, 31.0, 24.0, fw, [1.1, 0.02, -0.01], a, *edge(a)))
    features = []
    for k in range(n):
        size = 10 ** r.uniform(-0.5, 3)
        at, way = np.array([*r.uniform(-spread, spread, 2), r.uniform(-3, 5)]), r.uniform(0, 6.3)
        line = [at + np.array([math.cos(way), math.sin(way), 0]) * size * t + r.normal(size=3) * 0.3 for t in np.linspace(0, 1, r.integers(2, 6))]
        features.append(("c", k, 200, 100, 50, [tuple(map(float, p)) for p in line]))
    features += [("c", n, 1, 1, 1, []), ("d", n + 1, 1, 1, 1, features[0][5])]
    f = spark.createDataFrame(features, "clip_id string, prim_id int, r int, g int, b int, vertices array<struct<x:double,y:double,z:double>>")
    return f, spark.createDataFrame(cams, MODEL)


def all_pairs(features, viewers, on=("clip_id",), tile=0):
    return features.join(viewers, list(on))


@pytest.mark.parametrize("draw", [lambda f, c: raster.draw_lines(f, c, W, H, 5), lambda f, c: raster.draw_hulls(f, c, W, H)])
def test_same_pixels(spark, monkeypatch, draw):
    f, c = scene(spark)
    with_tiles = sorted(draw(f, c).collect())
    monkeypatch.setattr(tiles, "meeting", all_pairs)
    monkeypatch.setattr(tiles, "in_view", lambda joined: joined)
    assert with_tiles and with_tiles == sorted(draw(f, c).collect())


def test_fewer_rows_meet(spark):
    """Rows that meet follow what is in sight: a longer road does not add to them."""
    met = []
    for n, spread in ((400, 2000.0), (1600, 8000.0)):
        f, c = scene(spark, 1, n, spread)
        f = f.filter(F.size("vertices") > 1).withColumn("vertices", F.slice("vertices", 1, 2)).withColumn("vertices", F.transform("vertices", lambda p: geometry.point(*(p[a] * 0.01 + F.col("vertices")[0][a] * 0.99 for a in "xyz"))))
        c = c.filter("fw IS NULL").withColumn("__inv", mat.affine_inv("m"))
        joined = tiles.meeting(tiles.with_place(f), tiles.camera_view(c, W, H))
        met.append((joined.count(), f.count() * c.count()))
    assert all(a * 15 < b for a, b in met) and met[1][0] < 2 * met[0][0] + 200
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("pitch", [0.0, 0.2])
def test_bird_s_eye(spark, monkeypatch, pitch):
    """Tilted egos, for which height moves a place, meet all segments."""
    r = np.random.default_rng(3)
    egos = [("c", k, turned(r.uniform(0, 6.3), pitch, [*r.uniform(-300, 300, 2), 1.0])) for k in range(6)]
    egos = spark.createDataFrame(egos, "clip_id string, frame int, m array<double>").withColumn("m", mat.opencv_to_flu("m"))
    p = [(*r.uniform(-300, 300, 2), 0.5) for _ in range(400)]
    rows = [("c", f"{k:04d}", 0, tuple(map(float, p[k])), tuple(map(float, p[k + 1] if k % 2 else (p[k][0] + 9.0, p[k][1], 0.0))), 9, 8, 7) for k in range(399)]
    s = spark.createDataFrame(rows, "clip_id string, prim_id string, seg_id int, p0 struct<x:double,y:double,z:double>, p1 struct<x:double,y:double,z:double>, r int, g int, b int")
    path = spark.createDataFrame([("c", *map(float, q)) for q in p], "clip_id string, x double, y double, z double")
    draw = lambda: sorted(raster.bev_map(s, egos, 80, 60.0, 3, path).collect())
    with_tiles = draw()
    monkeypatch.setattr(raster, "_around", lambda rows, ends, egos, metres: rows.join(egos, ["clip_id"]))
    assert len(with_tiles) > 100 and with_tiles == draw()


def images(spark, n=3000):
    r = np.random.default_rng(7)
    rows = [(f"c{k % 3}", f"id{k % 500:03d}", float(u), float(v), float(z), int(k % 256), int(k % 7), 9, W, H) for k, (u, v, z) in enumerate(zip(r.uniform(-5, 70, n), r.uniform(-5, 50, n), np.round(r.uniform(-1, 4, n), 1)))]
    rows += [("c0", "x", None, 1.0, 1.0, 1, 1, 1, W, H), ("c1", "y", math.nan, 1.0, 1.0, 1, 1, 1, W, H), ("c9", "z", 500.0, 1.0, 1.0, 1, 1, 1, W, H)]
    return spark.createDataFrame(rows, "clip_id string, id string, u double, v double, z double, r int, g int, b int, w int, h int").dropDuplicates(["clip_id", "id", "z"])


@pytest.fixture
def small_batches(spark):
    """Groups that come in many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dense_z_buffer(spark, small_batches):
    p = images(spark)
    got = sorted(dense.z_buffer(p, W, H, ["clip_id"]).collect())
    assert got == sorted(raster.z_buffer(p, ["clip_id"]).collect()) and len(got) > 1000


def test_dense_lines(spark, small_batches):
    r = np.random.default_rng(8)
    rows = [(f"c{k % 2}", f"{int(r.integers(0, 200)):03d}", k, *map(float, r.uniform(-40, 100, 4)), int(k % 256), 3, 4) for k in range(600)] + [("c0", "500", 0, 5.0, 5.0, 5.0, 5.0, 1, 2, 3)]
    s = spark.createDataFrame(rows, "clip_id string, prim_id string, seg_id int, u1 double, v1 double, u2 double, v2 double, r int, g int, b int")
    got = sorted(dense.line_raster(s, W, H, 4, ["clip_id"]).collect())
    assert got == sorted(raster.line_raster(s, W, H, 4, ["clip_id"]).collect()) and len(got) > 1000


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "gaussian"])
def test_dense_splat(spark, small_batches, kernel):
    p = images(spark).filter("z > 0 AND u IS NOT NULL AND NOT isnan(u)").select("clip_id", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("z").alias("depth"))
    got, want = ({tuple(x)[:3]: tuple(x)[3:] for x in f(p, ["clip_id"], W, H, kernel).collect()} for f in (dense.depth_splat, points.depth_splat))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in got)


def test_widest_camera_has_no_bound(spark):
    _, c = scene(spark)
    v = tiles.camera_view(c.withColumn("__inv", mat.affine_inv("m")), W, H).select("frame", "__view.base").collect()
    assert {r["frame"] for r in v if r["base"] is None} == {3}
    assert all(r["base"] > geometry.MAX_DEPTH for r in v if r["base"] is not None)
    assert camera.model_columns(c)[-1] == "edge_dr"


def test_birds_eye_images_send_lines_not_pixels(spark):
    """Lines and dots reach an image's kernel as rows, so no task sorts pixels (they were sorted by max_by before); dots lie over every line, names in order, null first."""
    e = spark.range(1).select(F.lit(1).alias("clip_id"), F.lit(0).alias("frame"), mat.pose(mat.yaw(mat.d(0)), [mat.d(0)] * 3).alias("m"))
    point = lambda x, y: F.struct(mat.d(x).alias("x"), mat.d(y).alias("y"), mat.d(0).alias("z"))
    names = [(None, 1), ("a", 2), ("~zz", 3), ("", 4)]
    s = spark.createDataFrame(names, "prim_id string, r int").select(F.lit(1).alias("clip_id"), "prim_id", F.lit(0).alias("seg_id"), point(-3, 3).alias("p0"), point(3, 3).alias("p1"), "r", F.lit(9).alias("g"), F.lit(9).alias("b"))
    path = spark.createDataFrame([(1, 3.0, 3.0, 0.0)] * 2, "clip_id int, x double, y double, z double")
    got = raster.bev_map(s, e, 80, 8.0, 3, path)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    at = {(p.u, p.v): (p.r, p.g, p.b) for p in got.collect()}
    assert at[10, 40] == (3, 9, 9) and at[40, 37] == at[37, 40] == (0, 0, 0) and at[40, 43] == (0, 0, 0) and at[40, 33] == (255, 0, 0)
    assert at[10, 10] == at[10, 11] == at[9, 10] == (0, 0, 0) and at[9, 11] == (3, 9, 9)
    some = raster.bev_map(s.filter("prim_id IS NULL OR prim_id = ''"), e, 80, 8.0, 3)
    assert {(p.r, p.g, p.b) for p in some.collect()} == {(4, 9, 9), raster.EGO}


def test_hull_kernel(spark):
    """The kernel gives the pixels of the relational form, whose exploded pixels were sorted in the stage that made them."""
    r = np.random.default_rng(5)
    rows = [(k % 3, k, [(float(u), float(v)) for u, v in np.round(r.uniform(-20, 80, (int(r.integers(1, 8)), 2)) * (1 if k % 2 else 0.5))], k, 7, 9) for k in range(60)]
    p = spark.createDataFrame(rows, "clip_id int, prim_id int, px array<struct<u:double,v:double>>, r int, g int, b int").withColumn("ring", raster.hull_ring("px"))
    fast = dense.hull_raster(p, W, H, ["clip_id"])
    assert "SortAggregate" not in fast._jdf.queryExecution().executedPlan().toString()
    got, want = ({tuple(x) for x in d.collect()} for d in (fast, raster.hull_raster(p, W, H, ["clip_id"])))
    assert got == want and len(got) > 500
