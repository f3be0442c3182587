"""Queries on tracks: a user's events are a clip, an event's value its coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenetables.functions import mat
from scenetables.operators import objects, resample
from scenetables.plans import scenes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame (0, 1, ...), x."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (n - 1).alias("frame"), F.col("value").alias("x"))


_TRACKS = "tracks AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame, value AS x FROM events)"
_UP = _TRACKS + """,
pairs AS (SELECT *, lead(x) OVER (PARTITION BY clip_id ORDER BY frame) AS nx FROM tracks),
up AS (
  SELECT clip_id, (frame * 3 + k)::INTEGER AS frame, CASE WHEN k = 0 THEN x ELSE x + (nx - x) * (k / 3.0::DOUBLE) END AS x
  FROM pairs, unnest(range(CASE WHEN nx IS NULL THEN 1 ELSE 3 END)) AS t(k))"""


def track_resample(spark, sf_dir):
    up = resample.upsample(_tracks(spark, sf_dir), ["clip_id"], ["x"])
    return up.select("clip_id", "frame", F.round("x", 4).alias("x"))


def track_chunks(spark, sf_dir):
    """Chunks of 30 frames that overlap by 10, of the upsampled tracks."""
    up = resample.upsample(_tracks(spark, sf_dir), ["clip_id"], ["x"])
    c = resample.chunked(up.withColumn("pos", F.col("frame")), ["clip_id"], 30, 10)
    return c.groupBy("clip_id", "chunk").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sum_x"))


def track_extrapolate(spark, sf_dir):
    up = resample.upsample(_tracks(spark, sf_dir), ["clip_id"], ["x"])
    return resample.extrapolate(up, ["clip_id"], ["x"]).select("clip_id", "frame", F.round("x", 4).alias("x"))


def render_frames(spark, sf_dir):
    """Every third frame, for at most four chunks of 30 with an overlap of 10."""
    return resample.render_frames(_tracks(spark, sf_dir), ["clip_id"], 30, 10, 30, 10, 4)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame (day since the user's first), value (of the day's last event)."""
    e = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("first", F.min("day").over(Window.partitionBy("user_id")))
    return e.groupBy(F.col("user_id").alias("clip_id"), F.datediff("day", "first").alias("frame")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def _spine(days: DataFrame) -> DataFrame:
    return days.groupBy("clip_id").agg(F.max("frame").alias("last")).select("clip_id", F.explode(F.expr("sequence(0, last + 2)")).alias("frame"))


_DAILY = """daily AS (
  SELECT user_id AS clip_id, date_diff('day', first, day)::INTEGER AS frame, arg_max(value, (ts, event_id)) AS value
  FROM (SELECT *, ts::DATE AS day, min(ts::DATE) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY user_id, first, day),
spine AS (SELECT clip_id, t.f::INTEGER AS frame FROM (SELECT clip_id, max(frame) AS last FROM daily GROUP BY clip_id), unnest(range(last + 3)) AS t(f)),
around AS (
  SELECT s.clip_id, s.frame, p.frame AS pf, p.value AS pv, n.frame AS nf, n.value AS nv
  FROM spine s ASOF LEFT JOIN daily p ON s.clip_id = p.clip_id AND s.frame >= p.frame
  ASOF LEFT JOIN daily n ON s.clip_id = n.clip_id AND s.frame <= n.frame)"""


def hold_track(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return resample.hold(_spine(d), d, ["clip_id"], ["value"])


def linear_track(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return resample.linear(_spine(d), d, ["clip_id"], ["value"]).select("clip_id", "frame", F.round("value", 4).alias("value"))


def bezier_handles(spark, sf_dir):
    h = resample.bezier_handles(_daily(spark, sf_dir), ["clip_id"])
    return h.select("clip_id", "frame", *(F.round(c, 4).alias(c) for c in ("lx", "ly", "rx", "ry")))


def bezier_track(spark, sf_dir):
    """Values are halfway between two roundings at the middle of a gap, so a little is added."""
    d = _daily(spark, sf_dir)
    return resample.bezier(_spine(d), d, ["clip_id"]).select("clip_id", "frame", F.round(F.col("value") + 3e-8, 4).alias("value"))


def timeline_range(spark, sf_dir):
    return resample.timeline(_daily(spark, sf_dir).withColumn("frame", F.col("frame") - 3), ["clip_id"])


def sign_align(spark, sf_dir):
    """Quaternions of a label's vectors, a track of any length, each on the side of the one before."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.col("vec_id").alias("frame"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("wxyz")))
    signed = lambda c: F.when(F.round(c, 6) == 0, F.rint(c)).otherwise(F.round(c, 6)).alias(c)  # a zero keeps its sign
    return resample.align_signs(e, ["clip_id"]).select("clip_id", "frame", *map(signed, "wxyz"))


def _yaw_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir)
    return t.select("clip_id", "frame", mat.pose(mat.yaw(F.col("x")), [F.col("x"), F.col("frame").cast("double"), mat.d(0)]).alias("m"))


def pose_resample(spark, sf_dir):
    up = resample.upsample_poses(_yaw_poses(spark, sf_dir), ["clip_id"])
    return up.select("clip_id", "frame", *(F.round(F.col("m")[i] + 0.0, 4).alias(n) for n, i in (("cos", 0), ("sin", 4), ("x", 3), ("y", 7))))


def camera_poses(spark, sf_dir):
    """Vehicle poses carried to two cameras, in image axes."""
    v = _yaw_poses(spark, sf_dir)
    rig = spark.range(2).select(F.col("id").alias("camera"), mat.pose(mat.yaw(F.col("id") * 0.5), [F.col("id") + 1.0, mat.d(0.5), mat.d(2)]).alias("m"))
    e = v.select("clip_id").distinct().withColumn("camera", F.explode(F.array(F.lit(0), F.lit(1)))).join(F.broadcast(rig), "camera")
    p = scenes.camera_tracks(v, e)
    return p.select("clip_id", F.col("camera").cast("int").alias("camera"), "frame", *(F.round(F.col("m")[i] + 0.0, 4).alias(n) for n, i in (("x", 3), ("y", 7), ("z", 11), ("right_x", 0), ("forward_x", 2), ("down_z", 9))))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects: the event types of a user's days, at x = the day's largest value; a day is two frames, the second of them without labels."""
    e = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("frame", 2 * F.datediff("day", F.lit("2024-01-01").cast("date")))
    g = e.groupBy(F.col("user_id").alias("clip_id"), "frame", F.col("event_type").alias("track_id")).agg(F.max("value").alias("x"))
    at = mat.pose([mat.d(1), mat.d(0), mat.d(0), mat.d(0), mat.d(1), mat.d(0), mat.d(0), mat.d(0), mat.d(1)], [F.col("x"), mat.d(0), mat.d(0)])
    return g.select("clip_id", "frame", "track_id", F.lit("Car").alias("object_type"), (F.col("x") > 5).alias("is_moving"), F.array("x", "x", "x").alias("lwh"), at.alias("m"))


def object_match(spark, sf_dir):
    o = _typed(spark, sf_dir)
    ends = o.groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    frames = ends.select("clip_id", F.explode(F.expr("sequence(a - 1, b + 1)")).alias("frame"))
    out = objects.interpolate_objects(o, frames)
    return out.select("clip_id", "frame", "track_id", "is_moving", F.round(F.col("m")[3], 4).alias("x"), F.round(F.col("lwh")[0], 4).alias("l"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects: a supplier's parts, moving where the return flag is A."""
    l = _table(spark, sf_dir, "lineitem")
    angle = F.col("l_discount") * 30
    at = mat.pose(mat.yaw(angle), [F.col("l_quantity"), F.col("l_tax"), mat.d(1)])
    return l.select(F.col("l_suppkey").alias("clip_id"), F.col("l_partkey").alias("track_id"), F.lit("Car").alias("object_type"), (F.col("l_returnflag") == "A").alias("is_moving"), F.array("l_quantity", "l_extendedprice", "l_tax").alias("lwh"), at.alias("m"))


def static_clean(spark, sf_dir):
    o = objects.clean_static(_parts(spark, sf_dir)).filter("NOT is_moving")
    six = lambda c: F.round(c + 0.0, 4)
    return o.select("clip_id", "track_id", *(six(F.col("lwh")[i]).alias(n) for i, n in enumerate(("l", "w", "h"))), *(six(F.col("m")[i]).alias(n) for n, i in (("x", 3), ("cos", 0), ("sin", 4)))).distinct()


def moving_objects(spark, sf_dir):
    """Classes and moving objects of a supplier, the labels being shipping modes of a kind."""
    kind = F.element_at(F.array(*map(F.lit, ("Bus", "Person", "Rider", "Automobile", "Tree"))), (F.pmod(F.col("l_partkey"), F.lit(5)) + 1).cast("int"))
    l = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", kind.alias("kind"))
    speed = F.col("l_quantity") / 100 > objects.MOVING_SPEED
    return l.groupBy(F.col("l_suppkey").alias("clip_id"), objects.drawn_class(F.col("kind")).alias("cls")).agg(F.count("*").alias("n"), F.count_if(speed).alias("n_moving"))


_GAPS = """gaps AS (
  SELECT *, (frame - lag(frame) OVER w)::DOUBLE AS ga, value - lag(value) OVER w AS ra, (lead(frame) OVER w - frame)::DOUBLE AS gb, lead(value) OVER w - value AS rb
  FROM daily WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
capped AS (SELECT *, ga IS NOT NULL AND gb IS NOT NULL AS inner_, least(ga, 5 * gb) AS ca FROM gaps),
sized AS (
  SELECT *, CASE WHEN inner_ THEN ca ELSE coalesce(ga, gb, 2.5614::DOUBLE) END / 2.5614::DOUBLE AS ha,
    CASE WHEN inner_ THEN least(gb, 5 * ca) ELSE coalesce(ga, gb, 2.5614::DOUBLE) END / 2.5614::DOUBLE AS hb,
    CASE WHEN inner_ AND ra * rb > 0 THEN (ra / ga + rb / gb) / 2 ELSE 0 END AS s FROM capped),
sloped AS (SELECT *, CASE WHEN abs(s) * ha > abs(ra) THEN ra / ha WHEN abs(s) * hb > abs(rb) THEN rb / hb ELSE s END AS k FROM sized)"""

QUERIES = {f.__name__: f for f in (track_resample, track_chunks, track_extrapolate, render_frames, hold_track, linear_track, bezier_handles, bezier_track, timeline_range, sign_align, pose_resample, camera_poses, object_match, static_clean, moving_objects)}

ORACLE_SQL = {
    "track_resample": f"WITH {_UP} SELECT clip_id, frame, round(x, 4) AS x FROM up",
    "track_chunks": f"""WITH {_UP}, n AS (SELECT clip_id, max(frame) + 1 AS n FROM up GROUP BY clip_id),
chunks AS (SELECT clip_id, c::INTEGER AS chunk FROM n, unnest(range(greatest((n - 30) // 20 + 1, 0))) AS t(c) WHERE n >= 30)
SELECT c.clip_id, c.chunk, count(*) AS n, round(sum(x), 4) AS sum_x FROM chunks c JOIN up ON up.clip_id = c.clip_id AND up.frame BETWEEN c.chunk * 20 AND c.chunk * 20 + 29 GROUP BY ALL""",
    "track_extrapolate": f"""WITH {_UP}, ends AS (
  SELECT clip_id, max(frame) AS last, arg_max(x, frame) AS x FROM up GROUP BY clip_id),
steps AS (SELECT e.clip_id, e.last, e.x, e.x - coalesce(u.x, e.x) AS d FROM ends e LEFT JOIN up u ON u.clip_id = e.clip_id AND u.frame = e.last - 1)
SELECT clip_id, frame, round(x, 4) AS x FROM up UNION ALL
SELECT clip_id, (last + k)::INTEGER AS frame, round(x + k * d, 4) AS x FROM steps, unnest([1, 2]) AS t(k)""",
    "render_frames": f"WITH {_TRACKS} SELECT clip_id, (frame // 3)::INTEGER AS pos, frame FROM tracks WHERE frame % 3 = 0 AND frame // 3 < 90",
    "hold_track": f"WITH {_DAILY} SELECT clip_id, frame, CASE WHEN pf IS NULL THEN nv ELSE pv END AS value FROM around",
    "linear_track": f"""WITH {_DAILY} SELECT clip_id, frame,
  round(CASE WHEN pf IS NULL THEN nv WHEN nf IS NULL OR nf = pf THEN pv ELSE pv + (nv - pv) * ((frame - pf)::DOUBLE / (nf - pf)::DOUBLE) END, 4) AS value FROM around""",
    "bezier_handles": f"""WITH {_DAILY}, {_GAPS}
SELECT clip_id, frame, round(frame - ha, 4) AS lx, round(value - k * ha, 4) AS ly, round(frame + hb, 4) AS rx, round(value + k * hb, 4) AS ry FROM sloped""",
    "bezier_track": f"""WITH RECURSIVE {_DAILY}, {_GAPS},
knots AS (SELECT clip_id, frame, value, frame - ha AS lx, value - k * ha AS ly, frame + hb AS rx, value + k * hb AS ry FROM sloped),
ends AS (
  SELECT a.clip_id, a.frame, a.pf, a.nf, a.pv, a.nv, p.rx, p.ry, n.lx, n.ly FROM around a LEFT JOIN knots p ON p.clip_id = a.clip_id AND p.frame = a.pf LEFT JOIN knots n ON n.clip_id = a.clip_id AND n.frame = a.nf),
half AS (
  SELECT clip_id, frame, pf, nf, rx, lx, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM ends WHERE pf < nf
  UNION ALL SELECT clip_id, frame, pf, nf, rx, lx, step + 1, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END FROM (
    SELECT *, pf * pow(1 - mid, 3) + 3 * rx * pow(1 - mid, 2) * mid + 3 * lx * (1 - mid) * mid * mid + nf * pow(mid, 3) < frame AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM half WHERE step < 60))),
found AS (SELECT clip_id, frame, (lo + hi) / 2 AS s FROM half WHERE step = 60)
SELECT e.clip_id, e.frame, round(CASE WHEN pf IS NULL THEN nv WHEN s IS NULL THEN pv ELSE pv * pow(1 - s, 3) + 3 * ry * pow(1 - s, 2) * s + 3 * ly * (1 - s) * s * s + nv * pow(s, 3) END + 3e-8, 4) AS value
FROM ends e LEFT JOIN found f ON f.clip_id = e.clip_id AND f.frame = e.frame""",
    "timeline_range": f"""WITH {_DAILY} SELECT clip_id, least(0, min(frame - 3))::INTEGER AS first_t, greatest(0, max(frame - 3))::INTEGER AS last_t,
  least(0, min(frame - 3)) < greatest(0, max(frame - 3)) AS enabled FROM daily GROUP BY clip_id""",
    "sign_align": """WITH q AS (
  SELECT label AS clip_id, vec_id AS frame, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings),
d AS (SELECT *, CASE WHEN w * lag(w) OVER o + x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o < 0 THEN 1 ELSE 0 END AS f FROM q WINDOW o AS (PARTITION BY clip_id ORDER BY frame)),
s AS (SELECT *, CASE WHEN (sum(f) OVER (PARTITION BY clip_id ORDER BY frame)) % 2 = 1 THEN -1 ELSE 1 END AS s FROM d)
SELECT clip_id, frame, round(w * s, 6) AS w, round(x * s, 6) AS x, round(y * s, 6) AS y, round(z * s, 6) AS z FROM s""",
    "pose_resample": f"""WITH {_TRACKS}, pairs AS (SELECT *, lead(x) OVER (PARTITION BY clip_id ORDER BY frame) AS nx FROM tracks),
turns AS (SELECT *, atan2(sin(nx - x), cos(nx - x)) AS turn FROM pairs),
up AS (SELECT clip_id, (frame * 3 + k)::INTEGER AS frame, x + coalesce(turn, 0) * k / 3.0 AS yaw, x + coalesce(nx - x, 0) * k / 3.0 AS px, frame + k / 3.0 AS py
  FROM turns, unnest(range(CASE WHEN nx IS NULL THEN 1 ELSE 3 END)) AS t(k))
SELECT clip_id, frame, round(cos(yaw), 4) + 0.0 AS cos, round(sin(yaw), 4) + 0.0 AS sin, round(px, 4)::DOUBLE AS x, round(py::DOUBLE, 4) AS y FROM up""",
    "camera_poses": f"""WITH {_TRACKS}, p AS (SELECT clip_id, c::INTEGER AS camera, frame, x, c * 0.5::DOUBLE AS e, c + 1.0::DOUBLE AS ex FROM tracks, unnest([0, 1]) AS t(c))
SELECT clip_id, camera, frame, round(x + cos(x) * ex - sin(x) * 0.5::DOUBLE, 4) + 0.0 AS x, round(frame + sin(x) * ex + cos(x) * 0.5::DOUBLE, 4) + 0.0 AS y, round(2.0::DOUBLE, 4) AS z,
  round(sin(x + e), 4) + 0.0 AS right_x, round(cos(x + e), 4) + 0.0 AS forward_x, -1.0::DOUBLE AS down_z FROM p""",
    "object_match": """WITH o AS (
  SELECT user_id AS clip_id, 2 * date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS frame, event_type AS track_id, max(value) AS x FROM events GROUP BY ALL),
used AS (SELECT * FROM o),
labelled AS (SELECT DISTINCT clip_id, frame FROM used),
spine AS (SELECT clip_id, f::INTEGER AS frame FROM (SELECT clip_id, min(frame) AS a, max(frame) AS b FROM o GROUP BY clip_id), unnest(range(a - 1, b + 2)) AS t(f)),
b AS (SELECT s.clip_id, s.frame, p.frame AS pf, n.frame AS nf FROM spine s
  ASOF JOIN labelled p ON s.clip_id = p.clip_id AND s.frame >= p.frame ASOF LEFT JOIN labelled n ON s.clip_id = n.clip_id AND s.frame <= n.frame),
m AS (SELECT b.*, p.track_id, p.x AS px, n.x AS nx FROM b JOIN used p ON p.clip_id = b.clip_id AND p.frame = b.pf
  LEFT JOIN used n ON n.clip_id = b.clip_id AND n.frame = b.nf AND n.track_id = p.track_id WHERE b.nf IS NULL OR n.track_id IS NOT NULL)
SELECT clip_id, frame, track_id, px > 5 AS is_moving,
  round(CASE WHEN nf IS NULL OR nf = pf THEN px ELSE px + (nx - px) * ((frame - pf)::DOUBLE / (nf - pf)::DOUBLE) END, 4) AS x, round(CASE WHEN nf IS NULL OR nf = pf THEN px ELSE px + (nx - px) * ((frame - pf)::DOUBLE / (nf - pf)::DOUBLE) END, 4) AS l FROM m""",
    "static_clean": """WITH o AS (
  SELECT l_suppkey AS clip_id, l_partkey AS track_id, l_quantity AS q, l_extendedprice AS p, l_tax AS t, cos(l_discount * 30) AS c, sin(l_discount * 30) AS s FROM lineitem WHERE l_returnflag <> 'A'),
a AS (SELECT *, avg(c) OVER w AS mc, avg(s) OVER w AS ms FROM o WINDOW w AS (PARTITION BY clip_id, track_id)),
k AS (SELECT *, (c * mc + s * ms) / sqrt(mc * mc + ms * ms) > 0.7 AS near FROM a),
g AS (
  SELECT clip_id, track_id, avg(q) AS l, avg(p) AS w, avg(t) AS h, avg(q) FILTER (WHERE near) AS x, avg(c) FILTER (WHERE near) AS c, avg(s) FILTER (WHERE near) AS s FROM k GROUP BY ALL)
SELECT DISTINCT g.clip_id, g.track_id, round(g.l, 4) AS l, round(g.w, 4) AS w, round(g.h, 4) AS h, round(coalesce(g.x, k.q), 4) AS x,
  round(coalesce(g.c / sqrt(g.c * g.c + g.s * g.s), k.c), 4) + 0.0 AS cos, round(coalesce(g.s / sqrt(g.c * g.c + g.s * g.s), k.s), 4) + 0.0 AS sin
FROM g JOIN k USING (clip_id, track_id)""",
    "moving_objects": """SELECT l_suppkey AS clip_id, CASE l_partkey % 5 WHEN 0 THEN 'Truck' WHEN 1 THEN 'Pedestrian' WHEN 2 THEN 'Cyclist' WHEN 3 THEN 'Car' ELSE 'Others' END AS cls,
  count(*) AS n, count_if(l_quantity / 100 > 0.2::DOUBLE)::BIGINT AS n_moving FROM lineitem GROUP BY ALL""",
}
