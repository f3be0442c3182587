"""Queries on points, boxes, cameras and rasters: vectors of the embeddings table are points and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import dense, geometry, points, raster

W, H = 64, 48
RGB = raster.RGB


#: Vectors in a row of which a label makes one clip, so that clips are bounded and their number grows.
BLOCK = 200


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id (a label's part of a block of vectors), id, r (rank in the clip), e0..e11 times 10."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    clip = F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / BLOCK)
    n = F.row_number().over(Window.partitionBy("clip_id").orderBy("vec_id"))
    return e.withColumn("clip_id", clip).select("clip_id", F.col("vec_id").alias("id"), n.alias("r"), *((F.col("embedding")[i].cast("double") * 10).alias(f"e{i}") for i in range(12)))


_V = f"e AS (SELECT label::BIGINT * 1000000 + vec_id // {BLOCK} AS clip_id, vec_id AS id, embedding FROM embeddings), v AS (SELECT clip_id, id, row_number() OVER (PARTITION BY clip_id ORDER BY id) AS r, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * 10 AS e{i}" for i in range(12)) + " FROM e)"


def _points(v: DataFrame) -> DataFrame:
    return v.select("clip_id", F.lit(0).alias("frame"), F.col("id").alias("point_id"), F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"))


def _boxes(v: DataFrame, at: int) -> DataFrame:
    """A box of every vector."""
    m = mat.pose(mat.yaw(F.col(f"e{at + 3}")), [F.col(f"e{at + i}") for i in range(3)])
    return v.select("clip_id", F.lit(0).alias("frame"), F.col("id").cast("string").alias("track_id"), F.lit("Car").alias("object_type"), F.lit(True).alias("is_moving"), F.array(*((F.abs(f"e{i}") + 1) * 2 for i in (9, 10, 11))).alias("lwh"), m.alias("m"))


_BOX = """box AS (
  SELECT clip_id, id::VARCHAR AS track_id, e0 AS bx, e1 AS b_y, e2 AS bz, cos(e3) AS c, sin(e3) AS s, (abs(e9) + 1) * 2 AS l, (abs(e10) + 1) * 2 AS w, (abs(e11) + 1) * 2 AS h,
    e4 AS tx, e5 AS ty, e6 AS tz, cos(e7) AS tc, sin(e7) AS ts FROM v)"""


def _held(scale: str) -> str:
    return f"""held AS (
  SELECT v.clip_id, v.id AS point_id, (e0 - bx) * c + (e1 - b_y) * s AS qx, (e1 - b_y) * c - (e0 - bx) * s AS qy, e2 - bz AS qz, b.track_id, b.tx, b.ty, b.tz, b.tc, b.ts FROM v JOIN box b ON v.clip_id = b.clip_id
  WHERE abs((e0 - bx) * c + (e1 - b_y) * s) <= l / 2 * {scale} + 1e-6 AND abs((e1 - b_y) * c - (e0 - bx) * s) <= w / 2 * {scale} + 1e-6 AND abs(e2 - bz) <= h / 2 * {scale} + 1e-6)"""


def points_in_boxes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return points.points_in_boxes(_points(v), _boxes(v, 0), scale=1.2, cell=2.0).select("clip_id", "point_id", "track_id")


def move_points(spark, sf_dir):
    """Points carried to their box's second place; one box of five has none."""
    v = _vectors(spark, sf_dir)
    out = points.moved_with_boxes(_points(v), _boxes(v, 0), _boxes(v.filter("id % 5 <> 3"), 4))
    return out.select("clip_id", "point_id", *(F.round(c, 4).alias(c) for c in "xyz"))


def move_points_masked(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    out = points.moved_with_boxes(_points(v), _boxes(v, 0), _boxes(v.filter("id % 5 <> 3"), 4), drop=False)
    return out.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if("mask").alias("n_valid"))


def move_points_strict(spark, sf_dir):
    """Points carried to their box's second place, which every box must have."""
    v = _vectors(spark, sf_dir)
    out = points.moved_with_boxes(_points(v), _boxes(v, 0), _boxes(v, 4), strict=True)
    return out.select("clip_id", "point_id", *(F.round(c, 4).alias(c) for c in "xyz"))


def near_points(spark, sf_dir):
    v = _points(_vectors(spark, sf_dir))
    return points.near_filtered(v, 1.0).groupBy("clip_id").agg(F.count("*").alias("n"))


def sweep_window(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    f = e.select(F.col("user_id").alias("clip_id"), (n - 1).alias("frame"))
    return points.sweep_window(f, f.filter("frame % 3 = 0"))


def bev_nearest(spark, sf_dir):
    """Ground height at each clip's first vector, and its bird's-eye pixel from the second one."""
    v = _vectors(spark, sf_dir)
    ego = v.filter("r = 1").select("clip_id", F.col("e0").alias("x"), F.col("e1").alias("y"))
    vertices = v.filter("r > 2").select("clip_id", F.col("id").alias("vertex_id"), F.col("e3").alias("x"), F.col("e4").alias("y"), F.col("e5").alias("z"))
    g = points.ground_height(ego, vertices)
    m = v.filter("r = 2").select("clip_id", mat.pose(mat.yaw(F.col("e3")), [F.col("e0"), F.col("e1"), mat.d(0)]).alias("m"))
    j = ego.join(g, "clip_id").join(m, "clip_id")
    u, w = geometry.bev_pixel("m", [F.col("x"), F.col("y"), mat.d(0)])
    return j.select("clip_id", F.round("height", 4).alias("height"), F.round(u, 4).alias("u"), F.round(w, 4).alias("v"))


def _projected(v: DataFrame) -> DataFrame:
    u, w = camera.pinhole_project(mat.d(20), mat.d(20), mat.d(32), mat.d(24), [F.col("e0"), F.col("e1"), F.col("e2")])
    return v.select("clip_id", "id", u.alias("u"), w.alias("v"), F.col("e2").alias("z"), F.lit(W).alias("w"), F.lit(H).alias("h"), *((F.col("id") * k % 256).cast("int").alias(c) for k, c in zip((1, 3, 7), RGB)))


def pinhole_zbuffer(spark, sf_dir):
    return raster.z_buffer(_projected(_vectors(spark, sf_dir)), ["clip_id"])


_P = f"p AS (SELECT clip_id, id, e0 * 20 / e2 + 32 AS u, e1 * 20 / e2 + 24 AS v, e2 AS z, (id % 256)::INTEGER AS r, (id * 3 % 256)::INTEGER AS g, (id * 7 % 256)::INTEGER AS b FROM v WHERE e2 > 0)"
_Z = f"""px AS (SELECT *, round_even(u, 0)::INTEGER AS pu, round_even(v, 0)::INTEGER AS pv FROM p WHERE abs(u) < 1e6 AND abs(v) < 1e6),
z AS (SELECT clip_id, pu AS u, pv AS v, arg_min(r, (z, id)) AS r, arg_min(g, (z, id)) AS g, arg_min(b, (z, id)) AS b FROM px WHERE pu >= 0 AND pu < {W} AND pv >= 0 AND pv < {H} GROUP BY ALL)"""


def dense_z_buffer(spark, sf_dir):
    """The same images, each filled by a kernel."""
    return dense.z_buffer(_projected(_vectors(spark, sf_dir)), W, H, ["clip_id"])


def cropped_images(spark, sf_dir):
    """The middle of each raster, and its pixels in an image of twice the size."""
    z = geometry.center_cropped(raster.z_buffer(_projected(_vectors(spark, sf_dir)), ["clip_id"]), W, H, 32, 24)
    u, v = geometry.resized(F.col("u"), F.col("v"), F.lit(32), F.lit(24), 64, 48)
    return z.select("clip_id", "u", "v", *RGB, u.cast("int").alias("big_u"), v.cast("int").alias("big_v"))


def ray_round_trip(spark, sf_dir):
    """Points projected by an f-theta camera, and the angle of their rays."""
    v = _vectors(spark, sf_dir)
    fw = F.array(*(mat.d(c) for c in (0, 20, 0, 1.5, 0, -0.2)))
    lin = F.array(mat.d(1.1), mat.d(0.02), mat.d(-0.01))
    u, w = camera.ftheta_project(fw, lin, mat.d(32), mat.d(24), mat.d(1.2), camera.horner(fw, mat.d(1.2)), camera.horner(camera.derivative(fw), mat.d(1.2)), [F.col("e0"), F.col("e1"), F.col("e2")])
    return v.select("clip_id", "id", F.round(u, 4).alias("u"), F.round(w, 4).alias("v"))


def forward_domain(spark, sf_dir):
    """How far polynomials rise; the coefficients come from vectors."""
    v = _vectors(spark, sf_dir)
    c = v.select("clip_id", F.col("id").alias("camera"), F.array(mat.d(0), mat.d(100), F.col("e0") * 5, -F.abs("e1") * 10).alias("fw"), mat.d(150).alias("border"))
    return camera.forward_domain(c).select("clip_id", "camera", F.round("max_angle", 6).alias("max_angle"))


def _splat_points(v: DataFrame) -> DataFrame:
    return v.filter("e2 > 0.05").select("clip_id", (F.col("e0") * 4 / F.col("e2") + 8).alias("pu"), (F.col("e1") * 4 / F.col("e2") + 8).alias("pv"), (F.col("e2") * 10).alias("depth"))


def _splat(kernel: str, splat, name: str):
    def run(spark, sf_dir):
        s = splat(_splat_points(_vectors(spark, sf_dir)), ["clip_id"], 16, 16, kernel)
        return s.select("clip_id", "u", "v", F.round("depth", 4).alias("depth"))

    run.__name__ = f"{name}_{kernel}"
    return run


_S = """sp AS (SELECT clip_id, e0 * 4 / e2 + 8 AS pu, e1 * 4 / e2 + 8 AS pv, e2 * 10 AS depth FROM v WHERE e2 > 0.05::DOUBLE),
top AS (SELECT clip_id, max(ln(1 + least(depth, 1000))) + 1e-7 AS top FROM sp GROUP BY clip_id),
f AS (SELECT sp.*, 1 / (exp(ln(1 + least(depth, 1000)) / top * 50) + 1e-7) AS f FROM sp JOIN top USING (clip_id))"""


def _splat_sql(kernel: str) -> str:
    base, offsets, share = {
        "nearest": ("round_even({}, 0)", "[0]", "1.0"),
        "bilinear": ("floor({})", "[0, 1]", "(1 - abs(pu - u)) * (1 - abs(pv - v))"),
        "gaussian": ("floor({})", "[-2, -1, 0, 1, 2]", "exp(-0.5::DOUBLE * (pow(pu - u - 0.5::DOUBLE, 2) + pow(pv - v - 0.5::DOUBLE, 2)))"),
    }[kernel]
    return f"""WITH {_V}, {_S}, o AS (
  SELECT f.*, {base.format('pu')}::INTEGER + a AS u, {base.format('pv')}::INTEGER + b AS v FROM f, unnest({offsets}) AS t(a), unnest({offsets}) AS q(b) WHERE abs(pu) < 1e6 AND abs(pv) < 1e6)
SELECT clip_id, u, v, round(sum(depth * f * {share}) / sum(f * {share}), 4) AS depth FROM o WHERE u BETWEEN 0 AND 15 AND v BETWEEN 0 AND 15 GROUP BY ALL HAVING sum(f * {share}) > 0"""


def layer_max(spark, sf_dir):
    """Two rasters merged, then thickened by 3 pixels."""
    v = _vectors(spark, sf_dir)
    a = raster.z_buffer(_projected(v.filter("id % 2 = 0")), ["clip_id"])
    b = raster.z_buffer(_projected(v.filter("id % 2 = 1")), ["clip_id"])
    return raster.thickened(raster.merged([a, b], ["clip_id"]), 3, W, H, keys=["clip_id"])


def overlay(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a = raster.thickened(raster.z_buffer(_projected(v.filter("id % 2 = 0")), ["clip_id"]), 5, W, H, keys=["clip_id"])
    return raster.overlay(a, raster.z_buffer(_projected(v), ["clip_id"]), ["clip_id"])


def dilated_mask(spark, sf_dir):
    z = raster.z_buffer(_projected(_vectors(spark, sf_dir)), ["clip_id"])
    d = points.dilated(z, ["clip_id"], 11, W, H)
    return d.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum(F.col("u") * 100 + F.col("v")).alias("checksum"))


def _segments(v: DataFrame) -> DataFrame:
    """Segments between the places of two coordinates."""
    at = lambda i, n: F.floor((F.col(f"e{i}") + 2) / 4 * (n - 1))
    return v.select("clip_id", F.col("id").alias("prim_id"), F.lit(0).alias("seg_id"), at(0, W).alias("u1"), at(1, H).alias("v1"), at(2, W).alias("u2"), at(3, H).alias("v2"), *((F.col("id") * k % 256).cast("int").alias(c) for k, c in zip((1, 3, 7), RGB)))


def line_raster(spark, sf_dir):
    """Segments of 5 pixels' width, cut to the image."""
    return raster.line_raster(_segments(_vectors(spark, sf_dir)), W, H, 5, ["clip_id"])


def dense_lines(spark, sf_dir):
    """The same images, each filled by a kernel."""
    return dense.line_raster(_segments(_vectors(spark, sf_dir)), W, H, 5, ["clip_id"])


def hull_raster(spark, sf_dir):
    """Hulls of each clip's vectors' places, eight at a time."""
    v = _vectors(spark, sf_dir)
    p = v.groupBy("clip_id", F.floor((F.col("r") - 1) / 8).alias("prim_id")).agg(F.array_sort(F.collect_list(F.struct(((F.col("e0") + 4) * 8).alias("u"), ((F.col("e1") + 4) * 6).alias("v")))).alias("px"))
    p = p.select("clip_id", "prim_id", raster.hull_ring("px").alias("ring"), *((F.col("prim_id") * 20 % 200 + 50).cast("int").alias(c) for c in RGB))
    return raster.hull_raster(p, W, H, ["clip_id"])


def removal_mask(spark, sf_dir):
    """Pixels removed because they lie in the rectangle of any box's points."""
    v = _vectors(spark, sf_dir)
    p = _points(v).withColumn("u", F.floor((F.col("x") + 4) * 8).cast("int")).withColumn("v", F.floor((F.col("y") + 4) * 6).cast("int")).filter("u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 47")
    r = points.footprints(p, _boxes(v, 0), ["clip_id"], W, H)
    out = points.removal_mask(p, r, ["clip_id"])
    return out.groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if("removed").alias("n_removed"))


def depth_colours(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    depth = F.abs("e2") * 60
    return v.select("id", *(geometry.depth_shade(depth, F.lit(c)).alias(n) for c, n in zip((98, 183, 249), RGB)), geometry.depth_grey(depth).alias("grey"))


def densified_lines(spark, sf_dir):
    """Points every 0.8 along each clip's line through its vectors."""
    v = _vectors(spark, sf_dir)
    f = v.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("r", F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z")))).alias("p"))
    f = f.select("clip_id", F.transform("p", lambda p: geometry.point(p["x"], p["y"], p["z"])).alias("vertices"))
    d = geometry.densified(f, 0.8)
    return d.groupBy("clip_id").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 4).alias(c) for c in "xyz"))


def video_grid(spark, sf_dir):
    """Six views, three in a row, each the raster of some vectors."""
    v = _vectors(spark, sf_dir)
    z = raster.z_buffer(_projected(v).withColumn("view", F.col("id") % 5), ["clip_id", "view"]).withColumn("frame", F.lit(0))
    views = spark.range(5).select(F.col("id").alias("view"), F.col("id").cast("int").alias("ord"))
    return raster.video_grid(z, views, W, H, 3).drop("frame")


_DEPTH_SPLATS = [_splat(k, f, n) for f, n in ((points.depth_splat, "depth_splat"), (dense.depth_splat, "dense_splat")) for k in ("nearest", "bilinear", "gaussian")]
QUERIES = {f.__name__: f for f in (points_in_boxes, move_points, move_points_masked, move_points_strict, near_points, sweep_window, bev_nearest, pinhole_zbuffer, dense_z_buffer, cropped_images, ray_round_trip, forward_domain, *_DEPTH_SPLATS, layer_max, overlay, dilated_mask, line_raster, dense_lines, hull_raster, removal_mask, depth_colours, densified_lines, video_grid)}

_MOVED = f"""WITH {_V}, {_BOX}, {_held('1.2::DOUBLE')},
one AS (SELECT clip_id, point_id, bool_or(track_id::BIGINT % 5 = 3) AS gone, arg_min(track_id, track_id) AS track_id FROM held GROUP BY ALL),
moved AS (
  SELECT v.clip_id, v.id AS point_id, coalesce(gone, false) AS gone, CASE WHEN h.track_id IS NULL THEN e0 ELSE tc * qx - ts * qy + tx END AS x,
    CASE WHEN h.track_id IS NULL THEN e1 ELSE ts * qx + tc * qy + ty END AS y, CASE WHEN h.track_id IS NULL THEN e2 ELSE qz + tz END AS z
  FROM v LEFT JOIN one ON one.clip_id = v.clip_id AND one.point_id = v.id LEFT JOIN held h ON h.clip_id = one.clip_id AND h.point_id = one.point_id AND h.track_id = one.track_id)"""


def cut_sql(w: int, h: int) -> str:
    """Segments s (clip_id, id, u1, v1, u2, v2) cut to the image by the parameters at which they enter and leave it."""
    return f"""sides AS (
  SELECT s.*, u2 - u1 AS du, v2 - v1 AS dv, p, q FROM s, LATERAL (SELECT unnest([u1 - u2, u2 - u1, v1 - v2, v2 - v1]) AS p, unnest([u1, {w - 1} - u1, v1, {h - 1} - v1]) AS q)),
span AS (
  SELECT clip_id, id, u1, v1, du, dv, greatest(0, coalesce(max(q / p) FILTER (p < 0), 0)) AS lo, least(1, coalesce(min(q / p) FILTER (p > 0), 1)) AS hi, bool_or(p = 0 AND q < 0) AS gone
  FROM sides GROUP BY clip_id, id, u1, v1, du, dv),
cut AS (SELECT clip_id, id, u1 + lo * du AS u1, v1 + lo * dv AS v1, u1 + hi * du AS u2, v1 + hi * dv AS v2 FROM span WHERE NOT gone AND lo <= hi)"""


_THICK = "SELECT clip_id, u + a AS u, v + b AS v, max(r) AS r, max(g) AS g, max(b_) AS b FROM (SELECT clip_id, u, v, r, g, b AS b_ FROM {z}), unnest(range(-{h}, {h} + 1)) AS t(a), unnest(range(-{h}, {h} + 1)) AS q(b) WHERE u + a BETWEEN 0 AND 63 AND v + b BETWEEN 0 AND 47 GROUP BY ALL"

ORACLE_SQL = {
    "points_in_boxes": f"WITH {_V}, {_BOX}, {_held('1.2::DOUBLE')} SELECT clip_id, point_id, track_id FROM held",
    "move_points": f"{_MOVED} SELECT clip_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM moved WHERE NOT gone",
    "move_points_masked": f"{_MOVED} SELECT clip_id, count(*) AS n, count_if(NOT gone)::BIGINT AS n_valid FROM moved GROUP BY clip_id",
    "move_points_strict": f"{_MOVED.replace('track_id::BIGINT % 5 = 3', 'false')} SELECT clip_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM moved",
    "near_points": f"WITH {_V} SELECT clip_id, count(*) AS n FROM v WHERE sqrt(e0 * e0 + e1 * e1 + e2 * e2) >= 1 GROUP BY clip_id",
    "sweep_window": """WITH f AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS frame FROM events),
g AS (SELECT * FROM f), e AS (SELECT clip_id, max(frame) AS last FROM g GROUP BY clip_id)
SELECT g.clip_id, g.frame, k::INTEGER AS "offset", least((round_even(least(greatest(g.frame + k, 0), last) / 3.0, 0) * 3)::INTEGER, last // 3 * 3)::INTEGER AS sweep
FROM g JOIN e USING (clip_id), unnest([-2, -1, 0, 1, 2]) AS t(k)""",
    "bev_nearest": f"""WITH {_V}, ego AS (SELECT clip_id, e0 AS x, e1 AS y FROM v WHERE r = 1),
g AS (SELECT v.clip_id, arg_min(e5, (pow(e3 - x, 2) + pow(e4 - y, 2), id)) AS height FROM v JOIN ego USING (clip_id) WHERE r > 2 GROUP BY v.clip_id),
m AS (SELECT clip_id, e0 AS tx, e1 AS ty, cos(e3) AS c, sin(e3) AS s FROM v WHERE r = 2)
SELECT clip_id, round(height, 4) AS height, round(200 - (c * (y - ty) - s * (x - tx)) * (400 / 60.0::DOUBLE), 4) AS u, round(200 - (c * (x - tx) + s * (y - ty)) * (400 / 60.0::DOUBLE), 4) AS v
FROM ego JOIN g USING (clip_id) JOIN m USING (clip_id)""",
    "pinhole_zbuffer": f"WITH {_V}, {_P}, {_Z} SELECT * FROM z",
    "cropped_images": f"WITH {_V}, {_P}, {_Z} SELECT clip_id, u - 16 AS u, v - 12 AS v, r, g, b, (u - 16) * 2 AS big_u, (v - 12) * 2 AS big_v FROM z WHERE u BETWEEN 16 AND 47 AND v BETWEEN 12 AND 35",
    "ray_round_trip": f"""WITH {_V}, a AS (SELECT clip_id, id, e0, e1, sqrt(e0 * e0 + e1 * e1) AS flat, acos(e2 / sqrt(e0 * e0 + e1 * e1 + e2 * e2)) AS a FROM v),
r AS (SELECT *, CASE WHEN a <= 1.2::DOUBLE THEN 20 * a + 1.5::DOUBLE * a * a * a - 0.2::DOUBLE * a * a * a * a * a
  ELSE 20 * 1.2::DOUBLE + 1.5::DOUBLE * pow(1.2::DOUBLE, 3) - 0.2::DOUBLE * pow(1.2::DOUBLE, 5) + (a - 1.2::DOUBLE) * (20 + 4.5::DOUBLE * pow(1.2::DOUBLE, 2) - pow(1.2::DOUBLE, 4)) END / flat AS k FROM a)
SELECT clip_id, id, round(1.1::DOUBLE * k * e0 + 0.02::DOUBLE * k * e1 + 32, 4) AS u, round(-0.01::DOUBLE * k * e0 + k * e1 + 24, 4) AS v FROM r""",
    "forward_domain": f"""WITH {_V}, c AS (SELECT clip_id, id, e0 * 5 AS q, -abs(e1) * 10 AS k FROM v),
s AS (SELECT clip_id, id, i, i * pi() / 2000 AS a, q, k FROM c, unnest(range(1, 2001)) AS t(i)),
h AS (SELECT clip_id, id, i, CASE WHEN 100 + 2 * q * a + 3 * k * a * a <= 0 THEN i - 1 WHEN 100 * a + q * a * a + k * a * a * a > 150 THEN i END AS stop FROM s)
SELECT clip_id, id AS camera, round(coalesce(arg_min(stop, i) FILTER (WHERE stop IS NOT NULL), 2000) * pi() / 2000, 6) AS max_angle FROM h GROUP BY ALL""",
    "depth_splat_nearest": _splat_sql("nearest"),
    "depth_splat_bilinear": _splat_sql("bilinear"),
    "depth_splat_gaussian": _splat_sql("gaussian"),
    "layer_max": f"""WITH {_V}, {_P}, px AS (SELECT *, round_even(u, 0)::INTEGER AS pu, round_even(v, 0)::INTEGER AS pv FROM p WHERE abs(u) < 1e6 AND abs(v) < 1e6),
z2 AS (SELECT clip_id, pu AS u, pv AS v, arg_min(r, (z, id)) AS r, arg_min(g, (z, id)) AS g, arg_min(b, (z, id)) AS b FROM px WHERE pu >= 0 AND pu < {W} AND pv >= 0 AND pv < {H} GROUP BY clip_id, pu, pv, id % 2)
SELECT clip_id, u::INTEGER AS u, v::INTEGER AS v, r, g, b FROM ({_THICK.format(z='z2', h=1)})""",
    "overlay": f"""WITH {_V}, {_P}, {_Z}, even AS (
  SELECT clip_id, round_even(u, 0)::INTEGER AS u, round_even(v, 0)::INTEGER AS v, arg_min(r, (z, id)) AS r, arg_min(g, (z, id)) AS g, arg_min(b, (z, id)) AS b FROM p
  WHERE id % 2 = 0 AND abs(u) < 1e6 AND abs(v) < 1e6 AND round_even(u, 0) BETWEEN 0 AND {W - 1} AND round_even(v, 0) BETWEEN 0 AND {H - 1} GROUP BY clip_id, round_even(u, 0), round_even(v, 0)),
thick AS ({_THICK.format(z='even', h=2)})
SELECT t.clip_id, t.u::INTEGER AS u, t.v::INTEGER AS v, """ + ", ".join(f"least(trunc(t.{c} + 0.8::DOUBLE * coalesce(z.{c}, 0)), 255)::INTEGER AS {c}" for c in RGB) + " FROM thick t LEFT JOIN z ON z.clip_id = t.clip_id AND z.u = t.u AND z.v = t.v",
    "dilated_mask": f"""WITH {_V}, {_P}, {_Z}, d AS (SELECT DISTINCT clip_id, u + a AS u, v + b_ AS v FROM z, unnest(range(-5, 6)) AS t(a), unnest(range(-5, 6)) AS q(b_) WHERE u + a BETWEEN 0 AND 63 AND v + b_ BETWEEN 0 AND 47)
SELECT clip_id, count(*) AS n, sum(u * 100 + v)::BIGINT AS checksum FROM d GROUP BY clip_id""",
    "line_raster": f"""WITH {_V}, s AS (
  SELECT clip_id, id, floor((e0 + 2) / 4 * 63) AS u1, floor((e1 + 2) / 4 * 47) AS v1, floor((e2 + 2) / 4 * 63) AS u2, floor((e3 + 2) / 4 * 47) AS v2 FROM v),
{cut_sql(W, H)},
t AS (SELECT c.*, u, v, pow(u2 - u1, 2) + pow(v2 - v1, 2) AS n2 FROM cut c, unnest(range(64)) AS a(u), unnest(range(48)) AS b(v)),
k AS (SELECT *, CASE WHEN n2 = 0 THEN 0 ELSE least(greatest(((u - u1) * (u2 - u1) + (v - v1) * (v2 - v1)) / n2, 0), 1) END AS k FROM t),
p AS (SELECT clip_id, u, v, max(id) AS id FROM k WHERE pow(u - u1 - k * (u2 - u1), 2) + pow(v - v1 - k * (v2 - v1), 2) <= 6.25 GROUP BY ALL)
SELECT clip_id, u::INTEGER AS u, v::INTEGER AS v, (id % 256)::INTEGER AS r, (id * 3 % 256)::INTEGER AS g, (id * 7 % 256)::INTEGER AS b FROM p""",
    "hull_raster": f"""WITH {_V}, q AS (SELECT clip_id, (r - 1) // 8 AS prim_id, (e0 + 4) * 8 AS u, (e1 + 4) * 6 AS v FROM v),
n AS (SELECT clip_id, prim_id FROM q GROUP BY ALL HAVING count(DISTINCT (u, v)) >= 3),
rows AS (SELECT y FROM unnest(range({H})) AS t(y)),
-- the hull's chord in a row of pixels lies between the extremes of all segments of two vertices that cross the row
x AS (
  SELECT a.clip_id, a.prim_id, y, CASE WHEN a.v = b.v THEN a.u ELSE a.u + (b.u - a.u) * ((y - a.v) / (b.v - a.v)) END AS x
  FROM q a JOIN q b ON a.clip_id = b.clip_id AND a.prim_id = b.prim_id JOIN n ON n.clip_id = a.clip_id AND n.prim_id = a.prim_id, rows WHERE a.v <= y AND b.v >= y),
chord AS (SELECT clip_id, prim_id, y, greatest(ceil(min(x) - 1e-9), 0)::INTEGER AS lo, least(floor(max(x) + 1e-9), {W - 1})::INTEGER AS hi FROM x GROUP BY ALL),
px AS (SELECT clip_id, u::INTEGER AS u, y::INTEGER AS v, max(prim_id) AS p FROM chord, unnest(range(lo, hi + 1)) AS t(u) GROUP BY ALL)
SELECT clip_id, u, v, (p * 20 % 200 + 50)::INTEGER AS r, (p * 20 % 200 + 50)::INTEGER AS g, (p * 20 % 200 + 50)::INTEGER AS b FROM px""",
    "removal_mask": f"""WITH {_V}, {_BOX}, {_held('1')}, px AS (
  SELECT clip_id, id, floor((e0 + 4) * 8)::INTEGER AS u, floor((e1 + 4) * 6)::INTEGER AS v FROM v WHERE floor((e0 + 4) * 8) BETWEEN 0 AND 63 AND floor((e1 + 4) * 6) BETWEEN 0 AND 47),
g AS (SELECT h.clip_id, h.track_id, min(u) AS a, max(u) AS b, min(v) AS c, max(v) AS e FROM held h JOIN px ON px.clip_id = h.clip_id AND px.id = h.point_id GROUP BY ALL),
q AS (SELECT clip_id, a AS u0, b AS u1, floor(greatest(c - (e - c + 1) * 0.4::DOUBLE / 2, 0)) AS v0, ceil(least(e + (e - c + 1) * 0.4::DOUBLE / 2, 47)) AS v1 FROM g)
SELECT clip_id, count(*) AS n, count_if(hit)::BIGINT AS n_removed FROM (
  SELECT px.clip_id, px.id, coalesce(bool_or(u BETWEEN u0 AND u1 AND v BETWEEN v0 AND v1), false) AS hit FROM px LEFT JOIN q USING (clip_id) GROUP BY px.clip_id, px.id) GROUP BY clip_id""",
    "depth_colours": f"""WITH {_V}, d AS (SELECT id, least(abs(e2) * 60, 122.5::DOUBLE) AS d, abs(e2) * 60 AS raw FROM v)
SELECT id, trunc(2 * (122.5::DOUBLE - d) / 255 * 98)::INTEGER AS r, trunc(2 * (122.5::DOUBLE - d) / 255 * 183)::INTEGER AS g, trunc(2 * (122.5::DOUBLE - d) / 255 * 249)::INTEGER AS b, trunc(least(raw, 75) / 75 * 255)::INTEGER AS grey FROM d""",
    "densified_lines": f"""WITH {_V}, s AS (SELECT a.clip_id, a.e0 AS x0, a.e1 AS y0, a.e2 AS z0, b.e0 AS x1, b.e1 AS y1, b.e2 AS z1 FROM v a JOIN v b ON a.clip_id = b.clip_id AND b.r = a.r + 1),
n AS (SELECT *, greatest(trunc(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)) / 0.8::DOUBLE)::BIGINT, 2) AS n FROM s),
p AS (SELECT clip_id, x0 + (x1 - x0) * k / (n - 1) AS x, y0 + (y1 - y0) * k / (n - 1) AS y, z0 + (z1 - z0) * k / (n - 1) AS z FROM n, unnest(range(n - 1)) AS t(k)
  UNION ALL SELECT clip_id, arg_max(e0, r), arg_max(e1, r), arg_max(e2, r) FROM v GROUP BY clip_id)
SELECT clip_id, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z FROM p GROUP BY clip_id""",
    "video_grid": f"""WITH {_V}, {_P}, px AS (SELECT *, round_even(u, 0)::INTEGER AS pu, round_even(v, 0)::INTEGER AS pv, id % 5 AS view FROM p WHERE abs(u) < 1e6 AND abs(v) < 1e6),
z AS (SELECT clip_id, view, pu AS u, pv AS v, arg_min(r, (z, id)) AS r, arg_min(g, (z, id)) AS g, arg_min(b, (z, id)) AS b FROM px WHERE pu >= 0 AND pu < {W} AND pv >= 0 AND pv < {H} GROUP BY ALL)
SELECT clip_id, (u + view % 3 * 66 + CASE WHEN view >= 3 THEN 33 ELSE 0 END)::INTEGER AS u, (v + view // 3 * 50)::INTEGER AS v, r, g, b FROM z""",
}
ORACLE_SQL |= {f"dense_{n}": ORACLE_SQL[of] for n, of in (("z_buffer", "pinhole_zbuffer"), ("lines", "line_raster"), *((f"splat_{k}", f"depth_splat_{k}") for k in ("nearest", "bilinear", "gaussian")))}
