"""Queries that write the files of scenes and read them again, and on the parts of jobs that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import resample
from scenetables.plans import geometry_queries as geo
from scenetables.plans import manifest, scenes
from scenetables.plans import record_queries as records
from scenetables.plans import track_queries as tracks
from scenetables.plans.scene_queries import _V, _boxes, _vectors
from scenetables.plans.track_queries import _daily, _table
from scenetables.sources import scene, scratch, sinks, tars

_r = geo._r


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The folder of files (name, bytes)."""
    folder = scratch.folder(spark, name)
    tars.write_files(rows, folder)
    return folder


def _lidar(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and poses of three sweeps a clip."""
    clip, frame = F.col("clip_id").cast("string").alias("clip_id"), (F.col("r") % 3 * 3).cast("int").alias("frame")
    p = v.select(clip, frame, F.col("id").alias("point_id"), *(F.round(f"e{i}", 2).alias(a) for i, a in enumerate("xyz")))
    s = v.filter("r <= 3").select(clip, frame, mat.pose(mat.yaw(F.col("e3")), [F.col("e4"), F.col("e5"), mat.d(0)]).alias("m"))
    return p, s


def lidar_tars(spark, sf_dir):
    """LiDAR sweeps as members of a tar for each clip; later sweeps are read back by a filter that reaches the reader."""
    p, s = _lidar(_vectors(spark, sf_dir))
    folder = scratch.folder(spark, "lidar")
    tars.write_tars(tars.lidar_members(p, s), folder)
    points, poses = scene.lidar_tables(tars.read_lidar(spark, folder).filter("frame >= 3"))
    out = points.groupBy("clip_id", "frame").agg(F.count("*").alias("n"), *(F.round(F.sum(a), 3).alias(a) for a in "xyz"))
    return out.join(poses, ["clip_id", "frame"]).select("clip_id", "frame", "n", *(_r(F.col(a), 3).alias(a) for a in "xyz"), _r(F.col("m")[0]).alias("cos"), _r(F.col("m")[3]).alias("tx"))


def indexed_members(spark, sf_dir):
    """Objects of some frames, found in an index of tar members and read by their places."""
    v = _vectors(spark, sf_dir)
    o = _boxes(v, 0).withColumn("clip_id", F.col("clip_id").cast("string")).withColumn("frame", (F.col("track_id").cast("long") % 5).cast("int"))
    folder = scratch.folder(spark, "objects")
    tars.write_tars(sinks.object_members(o), folder)
    index = scratch.stored(tars.tar_index(spark, folder), "index")
    back = scene.objects(tars.read_indexed(index.filter("frame IN (1, 3)")))
    return back.select("clip_id", "frame", "track_id", _r(F.col("m")[3]).alias("x"), _r(F.col("lwh")[0]).alias("l"))


def caption_files(spark, sf_dir):
    """Captions as text files, one for each chunk of a clip; those of first chunks read."""
    s = _table(spark, sf_dir, "supplier")
    rows = s.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"), "s_suppkey", "s_name").select(F.format_string("clip%d_%d.txt", "s_suppkey", "chunk").alias("name"), F.concat("s_name", F.lit(" caption\nof chunk "), F.col("chunk").cast("string")).alias("bytes"))
    c = scene.captions(spark, _written(spark, rows, "captions"), "_0.txt")
    return c.select("clip_id", F.md5("text").alias("digest"))


def variation_files(spark, sf_dir):
    """Variations of captions as one JSON file for each clip."""
    s = _table(spark, sf_dir, "supplier")
    c = s.select(F.concat(F.lit("clip"), F.col("s_suppkey").cast("string")).alias("clip_id"), F.explode(F.create_map(F.lit("original"), F.col("s_name"), F.lit("Night"), F.concat(F.lit('a "dark" '), F.col("s_nationkey").cast("string")))).alias("variation", "text"))
    maps = sinks.variation_maps(c).select(F.concat("clip_id", F.lit(".rewritten.json")).alias("name"), F.col("json").alias("bytes"))
    return scene.variations(spark, _written(spark, maps, "variations"))


def wide_csv(spark, sf_dir):
    """Captions of a nation's suppliers as a CSV file of two rows, keys above texts."""
    s = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    row = lambda f: F.array_join(F.transform("s", f), ",")
    text = F.concat(row(lambda x: F.concat(F.lit("key"), x["s_suppkey"].cast("string"))), F.lit("\n"), row(lambda x: F.concat(F.lit('"'), x["s_name"], F.lit(', said ""so"""'))), F.lit("\n"))
    return scene.wide_csv(spark, _written(spark, s.select(F.format_string("nation%d.csv", "s_nationkey").alias("name"), text.alias("bytes")), "csv"))


def clip_lists(spark, sf_dir):
    """Orders of clips that a JSON list names, and of one clip by its id."""
    c = _table(spark, sf_dir, "customer").filter("c_custkey % 7 = 2")
    ids = c.groupBy((F.col("c_custkey") % 4).alias("k")).agg(F.to_json(F.sort_array(F.collect_list(F.col("c_custkey").cast("string")))).alias("bytes")).select(F.format_string("list%d.json", "k").alias("name"), "bytes")
    listed = scene.clip_list(spark, json_path=_written(spark, ids, "lists")).unionByName(scene.clip_list(spark, clip="1")).distinct()
    o = _table(spark, sf_dir, "orders").withColumn("clip_id", F.col("o_custkey").cast("string"))
    return o.join(listed, "clip_id", "left_semi").select("o_orderkey", "o_custkey")


def camera_forms(spark, sf_dir):
    """Cameras of rig JSON; the rays of their frames, whether those lie in a cone, and places in shares of an image."""
    v = _vectors(spark, sf_dir)
    text = F.format_string(
        '{"rig":{"sensors":[{"name":"wide","properties":{"Model":"ftheta","polynomial":" 0 %.6f  2.5","polynomial-type":"angle-to-pixeldistance","cx":"32","cy":"24.5","width":"64","height":"48","linear-c":"1.5"}},'
        '{"name":"back","properties":{"Model":"ftheta","bw-poly":"0 0.02 %.6f","cx":"%.6f","cy":"1","width":"8","height":"6"}},{"name":"hole","properties":{"Model":"pinhole"}}]}}', "e0", "e1", "e2")  # fmt: skip
    c = camera.rig_cameras(v.select(F.col("id").alias("clip_id"), text.alias("json")))
    grid = camera.ray_grid(v.select(F.col("id").alias("clip_id"), F.lit("wide").alias("camera"), (F.abs("e6") + 0.3).alias("fx"), *(mat.d(x).alias(n) for n, x in (("fy", 2), ("cx", 1), ("cy", 1))), F.lit(2).alias("w"), F.lit(2).alias("h")))
    poses = v.select(F.col("id").alias("clip_id"), F.lit("wide").alias("camera"), F.lit(0).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col("e4"), F.col("e5"), mat.d(1)]).alias("m"))
    rays = camera.posed_rays(grid, poses)
    share = camera.uv(F.col("u") + 0.5, F.col("v") + 0.5, mat.d(2), mat.d(2))
    seen = camera.inside_fov([F.col(a) for a in "xyz"], mat.d(0.6))
    rays = rays.groupBy("clip_id", "camera").agg(F.count_if(seen).alias("n_seen"), *(_r(F.sum(a)).alias(a) for a in ("ox", "oy", "oz", "x", "y", "z")), _r(F.sum(share[0] * 2 + share[1])).alias("shares"))
    out = c.join(rays, ["clip_id", "camera"], "left")
    return out.select("clip_id", "camera", "cx", "cy", "w", "h", _r(F.col("poly")[1], 6).alias("p1"), _r(F.col("poly")[2], 6).alias("p2"), "is_bw", F.col("lin")[0].alias("c"), "n_seen", "ox", "oy", "oz", "x", "y", "z", "shares")


def grounded_paths(spark, sf_dir):
    """Bezier paths through each user's days, laid flat at a height, carried to two cameras."""
    d = _daily(spark, sf_dir)
    k = d.select("clip_id", "frame", *(F.col("value").alias(a) for a in "xyz"), *(mat.d(x).alias(f"q{c}") for c, x in zip("wxyz", (0.5, -0.5, 0.5, -0.5))))  # looks along x
    last = k.groupBy("clip_id").agg(F.max("frame").alias("last"))
    identity = [mat.d(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    rig = k.select("clip_id").distinct().withColumn("camera", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", mat.pose(identity, [F.col("camera") * 2.0, F.col("camera") * 1.0, F.col("camera") * 3.0]))
    heights = k.select("clip_id").distinct().withColumn("height", (F.col("clip_id") % 7).cast("double"))
    out = resample.novel_trajectory(k, last, rig, "bezier", heights)
    return out.select("clip_id", "camera", "frame", *(_r(F.col("m")[i] + (3e-8 if n in "xy" else 0)).alias(n) for n, i in (("x", 3), ("y", 7), ("z", 11), ("forward_x", 2), ("right_y", 4))))


def slerped_poses(spark, sf_dir):
    """Straight positions and slerped rotations along each user's days."""
    d = _daily(spark, sf_dir)
    half = F.col("value") / 2
    k = d.select("clip_id", "frame", F.col("value").alias("x"), F.col("frame").cast("double").alias("y"), mat.d(0).alias("z"), F.cos(half).alias("qw"), mat.d(0).alias("qx"), mat.d(0).alias("qy"), F.sin(half).alias("qz"))
    spine = k.groupBy("clip_id").agg(F.max("frame").alias("last")).select("clip_id", F.explode(F.expr("sequence(0, last + 2)")).alias("frame"))
    out = resample.pose_track(spine, k, ["clip_id"], "linear", "slerp")
    return out.select("clip_id", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in (("cos", 0), ("sin", 4), ("x", 3), ("y", 7))))


def converted_scene(spark, sf_dir):
    """Camera tracks that the conversion makes of vehicle records, with the intrinsics of the clip's first frame."""
    v = _vectors(spark, sf_dir)
    vehicle = v.select("clip_id", (F.col("r") - 1).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col(f"e{i}") for i in range(3)]).alias("m"))
    clips = v.filter("r = 1").select("clip_id", F.lit("front").alias("camera"), mat.pose([mat.d(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [mat.d(0)] * 3).alias("m"))
    calibrations = v.select("clip_id", (F.col("r") - 1).alias("frame"), F.lit("FRONT").alias("name"), F.col("id").cast("double").alias("fx"), *(mat.d(x).alias(n) for n, x in (("fy", 2), ("cx", 3), ("cy", 4))), F.lit(64).alias("w"), F.lit(48).alias("h"))
    point = F.array(geo.geometry.point(F.col("e0"), F.col("e1"), F.col("e2")))
    features = v.select("clip_id", (F.col("r") % 2).cast("int").alias("frame"), F.col("id").alias("feature_id"), F.lit("lane").alias("kind"), point.alias("polyline"), point.alias("polygon"))
    labels = v.select(
        "clip_id", (F.col("r") - 1).alias("frame"), F.col("id").cast("string").alias("track_id"), F.lit("vehicle").alias("type"), F.lit(True).alias("synced"), F.col("e3").alias("heading"),
        *(F.col(f"e{i}").alias(n) for i, n in enumerate(("cx", "cy", "cz"))), mat.d(4).alias("l"), mat.d(2).alias("w"), mat.d(1.5).alias("h"), mat.d(3).alias("vx"), mat.d(0).alias("vy"), mat.d(0).alias("vz"),
        mat.pose([mat.d(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [mat.d(0)] * 3).alias("vehicle_m"),
    )
    t = scenes.converted(vehicle, clips, calibrations, features, labels, v.select("clip_id", (F.col("r") - 1).alias("frame"), F.col("id").alias("micros")))
    lanes = t["map_features"].groupBy("clip_id").agg(F.count("*").alias("n_lanes"))
    tracks = t["objects"].groupBy("clip_id").agg(F.max("frame").alias("last_label"))
    out = t["camera_pose"].join(t["intrinsics"], ["clip_id", "camera"]).join(t["timestamps"], ["clip_id", "frame"], "left").join(lanes, "clip_id", "left").join(tracks, "clip_id", "left")
    return out.select("clip_id", "camera", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in (("cos", 2), ("sin", 6), ("x", 3), ("y", 7), ("z", 11))), F.col("v")[0].alias("fx"), F.unix_micros("ts").alias("micros"), "n_lanes", "last_label")


def rendered_chunks(spark, sf_dir):
    """The map condition of every chunk of two frames that overlap by one, from poses, cameras, map and objects."""
    v = _vectors(spark, sf_dir)
    drive = geo._drive(v)
    boxes = geo._kinds(_boxes(v, 0)).drop("frame").withColumn("frame", F.explode(F.expr("sequence(0, 3)")))
    boxes = boxes.withColumn("m", mat.pose(mat.rot("m"), [F.col("m")[3] + F.col("frame") * geo.STEP, F.col("m")[7], F.col("m")[11]]))
    settings = sinks.settings('{"INPUT_POSE_FPS": 30, "TARGET_RENDER_FPS": 30, "TARGET_CHUNK_FRAME": 2, "OVERLAP_FRAME": 1}')
    models = geo._camera(v).select("clip_id", "camera", *camera.PINHOLE_MODEL, *camera.FTHETA_MODEL)
    out = scenes.rendered_map(drive.select("clip_id", "camera", "frame", "m"), models, boxes, geo._road(v), settings, geo.W, geo.H)
    return out.select("clip_id", "chunk", "pos", "u", "v", *geo.raster.RGB)


def embedding_tables(spark, sf_dir):
    """Captions with embeddings written by view and clip, and read again: those of one view that a resumed run still has to do."""
    e = _table(spark, sf_dir, "embeddings")
    rows = e.select(F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("view"), F.concat(F.lit("clip"), F.floor(F.col("vec_id") / 6).cast("string")).alias("clip_id"), F.concat(F.lit("_"), (F.col("vec_id") % 6).cast("string")).alias("chunk"), F.col("label").cast("string").alias("text"), F.array(F.col("embedding").cast("array<double>")).alias("embedding"))
    folder = scratch.folder(spark, "embeddings")
    sinks.write_embeddings(rows.filter("label <> 3"), folder)
    back = spark.read.parquet(folder).filter("view = 'left'")
    todo = sinks.remaining(rows.withColumn("name", F.concat("clip_id", "chunk")).filter("view = 'left'"), back, ["view", "name"])
    total = lambda c: _r(F.aggregate(c[0], mat.d(0), lambda acc, x: acc + x))
    one = lambda d, done: d.select("view", "name", "text", total(F.col("embedding")).alias("total"), F.lit(done).alias("done"))
    return one(back, True).unionByName(one(todo, False))


def snake_names(spark, sf_dir):
    """Names of kinds in lower case with underscores."""
    p = _table(spark, sf_dir, "part")
    name = F.concat(F.lit("partKey"), F.when(F.col("p_partkey") % 2 == 0, "OfTheRoad").otherwise("LaneXY"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", manifest.snake_case(name).alias("name"))


QUERIES = {f.__name__: f for f in (lidar_tars, indexed_members, caption_files, variation_files, wide_csv, clip_lists, camera_forms, grounded_paths, slerped_poses, converted_scene, rendered_chunks, embedding_tables, snake_names)}

#: Rays of images of two by two pixels, turned by a pose.
_RAYS = """g AS (SELECT id, e3, e4, e5, (u - 0.5::DOUBLE) / (abs(e6) + 0.3::DOUBLE) AS dx, (w - 0.5::DOUBLE) / 2 AS dy, (u + 0.5::DOUBLE) + (w + 0.5::DOUBLE) / 2 AS share FROM v, unnest(range(2)) AS a(u), unnest(range(2)) AS b(w)),
n AS (SELECT *, sqrt(dx * dx + dy * dy + 1) AS n FROM g),
rays AS (SELECT id, count_if(acos(1 / n) <= 0.6::DOUBLE)::BIGINT AS n_seen, sum(e4) AS ox, sum(e5) AS oy, 4.0::DOUBLE AS oz, sum((cos(e3) * dx - sin(e3) * dy) / n) AS x, sum((sin(e3) * dx + cos(e3) * dy) / n) AS y, sum(1 / n) AS z, sum(share) AS shares FROM n GROUP BY id)"""


def _bezier_sql() -> str:
    """The values of Bezier curves through each user's days."""
    text = tracks.ORACLE_SQL["bezier_track"]
    head, tail = text.rsplit("SELECT e.clip_id", 1)
    return head + ", curve AS (SELECT e.clip_id" + tail.replace(", 4) AS value", ", 12) AS value") + ")"


_R = "round({}, {}) + 0.0"
ORACLE_SQL = {
    "lidar_tars": f"""WITH {_V}, s AS (SELECT clip_id, r % 3 * 3 AS frame, cos(e3) AS cos, e4 AS tx FROM v WHERE r <= 3), p AS (SELECT clip_id, r % 3 * 3 AS frame, {', '.join(f'round(e{i}, 2)::FLOAT::DOUBLE AS {a}' for i, a in enumerate('xyz'))} FROM v)
SELECT p.clip_id::VARCHAR AS clip_id, p.frame::INTEGER AS frame, count(*) AS n, {', '.join(f'round(sum({a}), 3) + 0.0 AS {a}' for a in 'xyz')}, round(any_value(cos), 4) + 0.0 AS cos, round(any_value(tx), 4) + 0.0 AS tx
FROM p JOIN s ON s.clip_id = p.clip_id AND s.frame = p.frame WHERE p.frame >= 3 GROUP BY p.clip_id, p.frame""",
    "indexed_members": f"WITH {_V} SELECT clip_id::VARCHAR AS clip_id, (id % 5)::INTEGER AS frame, id::VARCHAR AS track_id, round(e0, 4) + 0.0 AS x, round((abs(e9) + 1) * 2, 4) + 0.0 AS l FROM v WHERE id % 5 IN (1, 3)",
    "caption_files": "SELECT 'clip' || s_suppkey || '_0' AS clip_id, md5(s_name || ' caption' || chr(10) || 'of chunk 0') AS digest FROM supplier",
    "variation_files": "SELECT 'clip' || s_suppkey AS clip_id, k AS variation, CASE k WHEN 'original' THEN s_name ELSE 'a \"dark\" ' || s_nationkey END AS text FROM supplier, unnest(['original', 'Night']) AS t(k)",
    "wide_csv": "SELECT 'key' || s_suppkey AS key, s_name || ', said \"so\"' AS text FROM supplier",
    "clip_lists": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 1 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 2)",
    "camera_forms": f"""WITH {_V}, {_RAYS}
SELECT v.id AS clip_id, camera, CASE camera WHEN 'wide' THEN 32.0::DOUBLE ELSE round(e2, 6) + 0.0 END AS cx, CASE camera WHEN 'wide' THEN 24.5::DOUBLE ELSE 1.0::DOUBLE END AS cy, CASE camera WHEN 'wide' THEN 64 ELSE 8 END AS w, CASE camera WHEN 'wide' THEN 48 ELSE 6 END AS h,
  CASE camera WHEN 'wide' THEN round(e0, 6) + 0.0 ELSE 0.02::DOUBLE END AS p1, CASE camera WHEN 'wide' THEN 2.5::DOUBLE ELSE round(e1, 6) + 0.0 END AS p2, camera = 'back' AS is_bw, CASE camera WHEN 'wide' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS c, n_seen,
  {', '.join(f'round({a}, 4) + 0.0 AS {a}' for a in ('ox', 'oy', 'oz', 'x', 'y', 'z', 'shares'))} FROM v CROSS JOIN unnest(['wide', 'back']) AS t(camera) LEFT JOIN rays ON rays.id = v.id AND camera = 'wide'""",
    "grounded_paths": f"""{_bezier_sql()}, ends2 AS (SELECT clip_id, max(frame) AS last FROM daily GROUP BY clip_id)
SELECT c.clip_id, k::INTEGER AS camera, c.frame, round(value + 3 * k, 4) + 0.0 AS x, round(value - 2 * k, 4) + 0.0 AS y, (c.clip_id % 7 - k)::DOUBLE AS z, 1.0::DOUBLE AS forward_x, -1.0::DOUBLE AS right_y FROM curve c JOIN ends2 USING (clip_id), unnest([0, 1]) AS t(k) WHERE c.frame <= last""",
    "slerped_poses": f"""WITH {records._POSES}, a AS (SELECT *, acos(least(greatest(pw * nw + pz * nz, -1), 1)) AS an FROM both_ends),
f AS (SELECT *, CASE WHEN sin(an) < 1e-9 THEN 1 - t ELSE sin((1 - t) * an) / greatest(sin(an), 1e-9) END AS ka, CASE WHEN sin(an) < 1e-9 THEN t ELSE sin(t * an) / greatest(sin(an), 1e-9) END AS kb FROM a),
q AS (SELECT clip_id, frame, px + (nx - px) * t AS x, py + (ny - py) * t AS y, ka * pw + kb * nw AS w, ka * pz + kb * nz AS z FROM f)
SELECT clip_id, frame, round(1 - 2 * z * z / (w * w + z * z), 4) + 0.0 AS cos, round(2 * w * z / (w * w + z * z), 4) + 0.0 AS sin, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM q""",
    "converted_scene": geo.ORACLE_SQL["pose_extrapolate"].rsplit("SELECT clip_id, frame::INTEGER", 1)[0]
    + """, t AS (FROM up UNION ALL FROM tail), c AS (SELECT clip_id, min(id)::DOUBLE AS fx, CASE WHEN count(*) = 1 THEN 1 ELSE count_if(r % 2 = 0) END::BIGINT AS n_lanes, ((max(r) - 1) * 3)::INTEGER AS last_label FROM v GROUP BY clip_id)
SELECT t.clip_id, 'front' AS camera, t.frame::INTEGER AS frame, round(cos(yaw), 4) + 0.0 AS cos, round(sin(yaw), 4) + 0.0 AS sin, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, fx, v.id AS micros, n_lanes, last_label
FROM t JOIN c USING (clip_id) LEFT JOIN v ON v.clip_id = t.clip_id AND (v.r - 1) * 3 = t.frame""",
    "rendered_chunks": f"""SELECT clip_id, chunk::INTEGER AS chunk, frame AS pos, u, v, r, g, b FROM ({geo._condition_sql(f"SELECT * REPLACE (f * {geo._FRAME} + clip_id AS clip_id) FROM v0, unnest(range(4)) AS frames(f)")}), unnest(range(3)) AS t(chunk) WHERE frame BETWEEN chunk AND chunk + 1""",
    "embedding_tables": "SELECT 'left' AS view, 'clip' || vec_id // 6 || '_' || vec_id % 6 AS name, label::VARCHAR AS text, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 AS total, label <> 3 AS done FROM embeddings WHERE vec_id % 2 = 0",
    "snake_names": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'part_key_of_the_road' ELSE 'part_key_lane_xy' END || p_partkey AS name FROM part",
}
