"""Queries on pose tracks of every kind, on decoded records and on what jobs read and write, from events, orders, vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.functions import mat
from scenetables.operators import objects, raster, resample
from scenetables.plans import manifest, scenes
from scenetables.plans.scene_queries import _V, _boxes, _vectors
from scenetables.plans.task_queries import event_views
from scenetables.plans.track_queries import _DAILY, _daily, _spine, _table
from scenetables.sources import scene, sinks


def _r(c, n: int = 4):
    return F.round(c, n) + 0.0


def _keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key poses of a user's days: x is the value, y the day, and the yaw the value again."""
    d = _daily(spark, sf_dir)
    half = F.col("value") / 2
    return d.select("clip_id", "frame", F.col("value").alias("x"), F.col("frame").cast("double").alias("y"), mat.d(0).alias("z"), F.cos(half).alias("qw"), mat.d(0).alias("qx"), mat.d(0).alias("qy"), F.sin(half).alias("qz"))


_FLAT = (("cos", 0), ("sin", 4), ("x", 3), ("y", 7))


def pose_track(spark, sf_dir):
    """Straight positions and rotations by components."""
    k = _keyframes(spark, sf_dir)
    return resample.pose_track(_spine(k), k, ["clip_id"], "linear", "components").select("clip_id", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in _FLAT))


def novel_paths(spark, sf_dir):
    """A user's path between the first and the last day, carried to two cameras."""
    k = _keyframes(spark, sf_dir)
    last = k.groupBy("clip_id").agg(F.max("frame").alias("last"))
    rig = k.select("clip_id").distinct().withColumn("camera", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", mat.pose([mat.d(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [F.col("camera") * 2.0, F.col("camera") * 1.0, mat.d(0)]))
    out = resample.novel_trajectory(k, last, rig, "linear")
    return out.select("clip_id", "camera", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in _FLAT))


def spin_track(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return resample.spin_track(_spine(d), d, ["clip_id"], "z", (1, 2, 3)).select("clip_id", "frame", *(_r(F.col("m")[i]).alias(n) for n, i in (*_FLAT, ("z", 11))))


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (user), attr (type of event), frame (day), value (the day's largest)."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("track"), F.col("event_type").alias("attr"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame")).agg(F.max("value").alias("value"))


def all_tracks(spark, sf_dir):
    """Every attribute of every track at every day of the track, held."""
    k = _attributes(spark, sf_dir)
    spine = k.groupBy("track").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("track", F.explode(F.expr("sequence(a, b)")).alias("frame"))
    return resample.evaluate_tracks(spine, k, "hold").select("track", "attr", "frame", _r(F.col("value")).alias("value"))


def edited_keyframes(spark, sf_dir):
    """Keyframes with those of clicks doubled and those of purchases taken out."""
    k = _attributes(spark, sf_dir)
    first, last = k.agg(F.min("attr"), F.max("attr")).first()
    changed = resample.set_keyframes(k, k.filter(F.col("attr") == first).withColumn("value", F.col("value") * 2))
    return resample.remove_keyframes(changed, k.filter(F.col("attr") == last).select("track", "attr", "frame")).select("track", "attr", "frame", _r(F.col("value")).alias("value"))


def record_objects(spark, sf_dir):
    """Labels of order lines as objects: kinds, motion by the velocity's length, and poses in the vehicle's frame."""
    l = _table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("vehicle", "pedestrian", "cyclist", "sign"))), (F.pmod(F.col("l_partkey"), F.lit(4)) + 1).cast("int"))
    vehicle = mat.pose(mat.yaw(F.col("l_discount") * 10), [F.col("l_tax") * 100, mat.d(1), mat.d(0)])
    labels = l.select(
        F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("int").alias("frame"), F.col("l_partkey").cast("string").alias("track_id"), kind.alias("type"), (F.col("l_returnflag") != "R").alias("synced"),
        (F.col("l_quantity") / 10).alias("heading"), F.col("l_quantity").alias("cx"), mat.d(2).alias("cy"), mat.d(0.5).alias("cz"), mat.d(4).alias("l"), mat.d(2).alias("w"), mat.d(1.5).alias("h"),
        (F.col("l_discount") * 2).alias("vx"), F.col("l_tax").alias("vy"), mat.d(0).alias("vz"), vehicle.alias("vehicle_m"),
    )
    o = objects.record_objects(labels)
    return o.select("clip_id", "frame", "track_id", "object_type", "is_moving", *(_r(F.col("m")[i]).alias(n) for n, i in (*_FLAT, ("z", 11))))


def record_features(spark, sf_dir):
    """Map features of records: an order is a clip, its lines are frames; only the first frame's count."""
    l = _table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("lane", "road_line", "road_edge", "crosswalk", "driveway"))), (F.pmod(F.col("l_suppkey"), F.lit(5)) + 1).cast("int"))
    p = lambda k: F.array(F.struct((F.col("l_quantity") * k).alias("x"), mat.d(k).alias("y"), mat.d(0).alias("z")))
    records = l.select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("frame"), F.col("l_partkey").alias("feature_id"), kind.alias("kind"), p(1).alias("polyline"), p(2).alias("polygon"))
    out = scene.record_map_features(records)
    return out.select("clip_id", "layer", "feature_id", "geom_type", F.col("vertices")[0]["x"].alias("x"), F.col("vertices")[0]["y"].alias("y"))


def record_calibrations(spark, sf_dir):
    """Intrinsics of an order's first line, and times of all its lines on the finer index."""
    l = _table(spark, sf_dir, "lineitem")
    c = l.select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("frame"), F.concat(F.lit("Camera_"), F.col("l_returnflag")).alias("name"), F.col("l_quantity").alias("fx"), F.col("l_tax").alias("fy"), mat.d(10).alias("cx"), mat.d(20).alias("cy"), F.lit(64).alias("w"), F.lit(48).alias("h"))
    i = scene.record_intrinsics(c)
    t = scene.record_timestamps(l.select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("int").alias("frame"), (F.col("l_partkey") * 1_000_000).alias("micros")))
    n = t.groupBy("clip_id").agg(F.max("frame").alias("last"), F.max(F.unix_micros("ts")).alias("micros"))
    return i.join(n, "clip_id").select("clip_id", "camera", *(F.col("v")[k].alias(x) for k, x in enumerate(("fx", "fy", "cx", "cy", "w", "h"))), "last", "micros")


def default_intrinsics(spark, sf_dir):
    """Cameras (a supplier's parts) with their own intrinsics where the part is small, the default rig's under another name else."""
    p = _table(spark, sf_dir, "part")
    cams = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("clip_id"), F.concat(F.lit("c"), F.pmod("l_partkey", F.lit(40)).cast("string")).alias("camera")).distinct()
    own = cams.filter("cast(clip_id as int) % 3 = 0").withColumn("values", F.array(F.col("clip_id").cast("double"), mat.d(1)))
    names = p.select(F.concat(F.lit("c"), F.pmod("p_partkey", F.lit(40)).cast("string")).alias("camera"), F.concat(F.lit("rig"), F.pmod("p_partkey", F.lit(40)).cast("string")).alias("rig_camera")).distinct()
    rig = names.filter("camera <> 'c7'").select(F.col("rig_camera").alias("camera"), F.array(mat.d(-1), mat.d(2)).alias("values"))
    out = scene.with_default_intrinsics(cams, own, rig, names)
    return out.select("clip_id", "camera", F.col("values")[0].alias("first"), "is_default")


def tar_round_trip(spark, sf_dir):
    """Boxes written as JSON members of tar samples, a sample a clip, and read back."""
    v = _vectors(spark, sf_dir)
    o = _boxes(v, 0).withColumn("clip_id", F.col("clip_id").cast("string"))
    tars = sinks.sample_tars(sinks.object_members(o)).select(F.col("tar").alias("content"))
    back = scene.objects(scene.tar_members(tars))
    return back.select("clip_id", "frame", "track_id", "object_type", "is_moving", _r(F.col("m")[3]).alias("x"), _r(F.col("m")[4]).alias("sin"), _r(F.col("lwh")[2]).alias("h"))


def _total(axis: str):
    return F.aggregate("vertices", mat.d(0), lambda acc, p: acc + p[axis])


def pose_tars(spark, sf_dir):
    """Camera poses and intrinsics of both models written as array members of tar samples, and read back."""
    v = _vectors(spark, sf_dir)
    clip = F.col("clip_id").cast("string")
    poses = v.select(clip.alias("clip_id"), F.lit("front_wide").alias("camera"), (F.col("r") - 1).alias("frame"), mat.pose(mat.yaw(F.col("e3")), [F.col(f"e{i}") for i in range(3)]).alias("m"))
    first = v.filter("r = 1")
    of = lambda n: first.select(clip.alias("clip_id"), F.lit("front_wide").alias("camera"), F.array(*((F.col(f"e{i}") if i < 12 else mat.d(1)) for i in range(n))).alias("values"))
    members = sinks.pose_members(poses).unionByName(sinks.intrinsic_members(of(6), "pinhole")).unionByName(sinks.intrinsic_members(of(14), "ftheta"))
    back = scene.tar_members(sinks.sample_tars(members).select(F.col("tar").alias("content")))
    i = scene.pinhole_intrinsics(back).select("clip_id", "camera", "fx", "cy")
    f = scene.ftheta_intrinsics(back).select("clip_id", "camera", F.col("values")[10].alias("e10"), F.size("values").alias("n"))
    out = scene.camera_poses(back, "front_wide").join(i, ["clip_id", "camera"]).join(f, ["clip_id", "camera"])
    return out.select("clip_id", "camera", "frame", *(_r(F.col("m")[k]).alias(n) for n, k in (*_FLAT, ("z", 11))), *(_r(F.col(c)).alias(c) for c in ("fx", "cy", "e10")), "n")


def inferred(spark, sf_dir):
    """A model of the caller's over documents: the number of words, refused for every fifth document, and an error for one language."""

    def make():
        def model(rows):
            return [None if d % 5 == 0 else str(len(t.split(" "))) for d, t in zip(rows["doc_id"], rows["text"])]

        return model

    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return manifest.batch_infer(d, make, accept=lambda x: x != "1").select("doc_id", "response", "error")


def map_json(spark, sf_dir):
    """Lines, areas and raw cuboids of a clip as layer JSON, read as map features."""
    v = _vectors(spark, sf_dir)
    xyz = F.struct(*(F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")))
    flat = F.array(F.array("e0", "e1", "e2"), F.array("e3", "e4", "e5"))
    none = lambda c, k: F.when(F.col("id") % 3 == k, c)
    cuboid = F.struct(xyz.alias("center"), F.struct(*(mat.d(0).alias(a) for a in "xyz")).alias("orientation"), F.struct(*(mat.d(2 * (i + 1)).alias(a) for i, a in enumerate("xyz"))).alias("dimensions"))
    shape = F.struct(none(F.struct(flat.alias("vertices")), 0).alias("polyline3d"), none(F.struct(flat.alias("vertices")), 1).alias("surface"), none(cuboid, 2).alias("cuboid3d"))
    label = F.struct(F.struct(shape.alias("shape3d")).alias("labelData"))
    layers = v.groupBy(F.col("clip_id").cast("string").alias("clip_id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("r", label.alias("l")))), lambda x: x["l"]).alias("labels"))).alias("json")).withColumn("layer", F.lit("poles"))
    f = scene.map_features(layers)
    return f.select("clip_id", "layer", "feature_id", "geom_type", F.size("vertices").alias("n"), *(_r(_total(a)).alias(a) for a in "xyz"))


def layer_colours(spark, sf_dir):
    """Features (pages) with their layer's geometry and colour."""
    names = F.array(*(F.lit(x[0]) for x in raster.LAYERS))
    p = _table(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.pmod("page_id", F.lit(len(raster.LAYERS))) + 1).cast("int")).alias("layer"))
    return raster.with_layers(p).select("page_id", "layer", "geom_type", *raster.RGB)


def multiview_captions(spark, sf_dir):
    """Captions of conversations, keyed by clip and view in one JSON object each; a view's name may end with another's."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, "left").otherwise("cross_left"), F.col("turn").cast("string"), "role").alias("k"), F.length("text").cast("string").alias("v")))).alias("e"))
    texts = c.select(F.to_json(F.map_from_entries("e")).alias("json"))
    seen = _table(spark, sf_dir, "conversations").select("turn", "role").distinct()
    views = seen.select(F.explode(F.array(*(F.concat(F.lit(f"{s}_"), F.col("turn").cast("string"), F.lit("_"), F.col("role")) for s in ("left", "cross_left")))).alias("view"))
    return scene.multiview_captions(texts, views)


def clip_selection(spark, sf_dir):
    """Orders of the clips (customers) that have a pose file."""
    listing = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.when(F.col("c_custkey") % 3 == 0, "pose").otherwise("lidar").alias("folder"), F.when(F.col("c_custkey") % 2 == 0, "tar").otherwise("npy").alias("ext"))
    o = _table(spark, sf_dir, "orders")
    return o.join(scene.clip_list(spark, listing=listing), o["o_custkey"] == F.col("clip_id"), "left_semi").select("o_orderkey", "o_custkey")


def paired_files(spark, sf_dir):
    """Videos and conditions with the same name and number of frames."""
    p = _table(spark, sf_dir, "part")
    of = lambda kind: p.select(F.concat_ws("_", F.lit("clip"), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws("/", F.lit(kind), F.col("p_partkey").cast("string")).alias("path"), F.pmod("p_partkey", F.lit(50)).alias("n_frames"))
    return manifest.paired_by_name(of("rgb"), of("hdmap"))


def video_chunks(spark, sf_dir):
    """Chunks of customers' videos at a third of the rate, two at most."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.lit("front").alias("camera"), (F.pmod("c_custkey", F.lit(400)) + 1).cast("int").alias("n_frames"))
    s = sinks.settings('{"INPUT_POSE_FPS": 30, "POST_TRAINING": {"TARGET_RENDER_FPS": 10, "TARGET_CHUNK_FRAME": 40, "OVERLAP_FRAME": 10, "MAX_CHUNK": 2}}', post_training=True)
    return scenes.video_chunks(c, s).select("clip_id", "chunk", "pos", "frame")


def chats(spark, sf_dir):
    """Rewriting prompts for documents and the turns of a change of colours; a document without an answer gets the turns alone."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("response"), F.col("source").alias("places"))
    t = d.join(manifest.variation_tasks(d, ("Night", "Rainy")).select("clip_id", "variation"), "clip_id")
    c = manifest.colour_turns(manifest.chat_prompts(t, "You rewrite captions.", "Caption: %s Kind: %s"))
    said = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"])), "#")
    return c.select("clip_id", "variation", F.size("messages").alias("n"), F.md5(said).alias("digest"))


def rewritten(spark, sf_dir):
    """New captions from answers of three shapes; those without the marker are left out."""
    shape = F.col("doc_id") % 3
    text = F.when(shape == 0, F.concat(F.lit(manifest.THINKING + "New caption: first New caption:"), "text")).when(shape == 1, F.concat(F.lit("New caption:"), "lang")).otherwise(F.col("text"))
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("variation"), text.alias("response"))
    return manifest.rewritten(d).select("clip_id", "variation", F.md5("text").alias("digest"))


def caption_tasks(spark, sf_dir):
    """Kinds of rewriting still to do: for documents without a label."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("text"))
    return manifest.caption_tasks(d, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip_id")))


def embedding_cut(spark, sf_dir):
    """Answers of an encoder, cut to their mask: a thousandfold in single precision, without its fraction. Components that are missing add nothing."""
    e = _table(spark, sf_dir, "embeddings")
    # a product with an integer would be of double precision; from 2^23 on a float has no fraction
    whole = lambda x: F.when(F.abs(x) < 2.0**23, x - x % 1).otherwise(x).cast("float")
    row = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(whole((F.get("embedding", i) * F.lit(1000)).cast("float"))))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.col("vec_id") % 8, 1).otherwise(0))
    said = e.select("vec_id", F.when(F.col("vec_id") % 11 != 0, F.to_json(F.struct(row.alias("embedding"), mask.alias("mask")))).alias("response"), F.lit(None).cast("string").alias("error"))
    out = manifest.embedded(said)
    return out.select("vec_id", "n_tokens", F.size("embedding").alias("n_rows"), F.aggregate("embedding", mat.d(0), lambda acc, x: acc + F.coalesce(x[0].cast("double"), mat.d(0))).alias("total"))


def embedding_tasks(spark, sf_dir):
    """Captions of views still to be embedded, with their video."""
    views = list(manifest.PREFIXES)
    at = F.element_at(F.array(*map(F.lit, views)), (F.pmod("doc_id", F.lit(len(views))) + 1).cast("int"))
    d = _table(spark, sf_dir, "documents").select(at.alias("view"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("text"), "doc_id")
    v = d.filter("doc_id % 4 <> 3").select("view", F.concat(F.col("key"), F.lit("_0")).alias("stem"), F.concat(F.lit("v/"), F.col("key")).alias("path"))
    done = d.filter("doc_id % 7 = 0").select("view", "key")
    return manifest.embedding_tasks(d.drop("doc_id"), v, done)


def multiview_tasks(spark, sf_dir):
    """Captions of clips (users) that have all views, which are all types of events, and an input, not done yet."""
    e = _table(spark, sf_dir, "events")
    clip = F.col("user_id").cast("string")
    listing = e.select(clip.alias("clip_id"), F.lit("hdmap").alias("kind"), F.col("event_type").alias("view"), F.format_string("%09d", "event_id").alias("path"))
    captions = e.select(clip.alias("clip_id"), F.lit("Night").alias("variation"), F.lit("t").alias("text")).distinct()
    inputs = e.filter("value > 95").select(clip.alias("clip_id"))
    done = e.filter("user_id % 5 = 0").select(F.concat(clip, F.lit("_Night")).alias("output"))
    out = manifest.multiview_tasks(captions, listing, event_views(e), inputs, done)
    return out.select("clip_id", "output", F.array_join(F.col("paths")["hdmap"], ",").alias("paths"))


QUERIES = {f.__name__: f for f in (pose_track, novel_paths, spin_track, all_tracks, edited_keyframes, record_objects, record_features, record_calibrations, default_intrinsics, tar_round_trip, pose_tars, inferred, map_json, layer_colours, multiview_captions, clip_selection, paired_files, video_chunks, chats, rewritten, caption_tasks, embedding_cut, embedding_tasks, multiview_tasks)}

#: Key poses at the frames of the spine: straight lines of x and of the quaternion (w, z), aligned along the track.
_POSES = f"""{_DAILY},
kq AS (SELECT clip_id, frame, value, cos(value / 2) AS w, sin(value / 2) AS z FROM daily),
kd AS (SELECT *, w * lag(w) OVER o + z * lag(z) OVER o AS d FROM kq WINDOW o AS (PARTITION BY clip_id ORDER BY frame)),
ks AS (SELECT clip_id, frame, value, w * s AS w, z * s AS z FROM (SELECT *, CASE WHEN (sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame)) % 2 = 1 THEN -1 ELSE 1 END AS s FROM kd)),
both_ends AS (
  SELECT a.clip_id, a.frame, CASE WHEN nf IS NULL OR nf = pf THEN 0 ELSE (a.frame - pf)::DOUBLE / (nf - pf)::DOUBLE END AS t, p.value AS px, p.frame AS py, p.w AS pw, p.z AS pz,
    coalesce(n.value, p.value) AS nx, coalesce(n.frame, p.frame) AS ny, coalesce(n.w, p.w) AS nw, coalesce(n.z, p.z) AS nz
  FROM around a JOIN ks p ON p.clip_id = a.clip_id AND p.frame = a.pf LEFT JOIN ks n ON n.clip_id = a.clip_id AND n.frame = a.nf),
mixed AS (SELECT clip_id, frame, px + (nx - px) * t AS x, py + (ny - py) * t AS y, pw + (nw - pw) * t AS w, pz + (nz - pz) * t AS z FROM both_ends),
posed AS (SELECT clip_id, frame, x, y, 1 - 2 * pow(z / n, 2) AS c, 2 * (w / n) * (z / n) AS s FROM (SELECT *, sqrt(w * w + z * z) + 1e-6 AS n FROM mixed))"""
_LAYERS = "(VALUES " + ", ".join(f"({k}, '{n}', '{t}', {r}, {g}, {b})" for k, (n, t, r, g, b) in enumerate(raster.LAYERS)) + ") AS y(k, layer, geom_type, r, g, b)"
_KINDS = "(SELECT list_sort(list(DISTINCT event_type)) AS kinds FROM events)"
_VIEWS = "[" + ", ".join(f"'{v}'" for v in manifest.PREFIXES) + "]"
_TURN1, _TURN2 = (t.replace("'", "''") for t in manifest.COLOUR_TURNS)
_CLEAN = "replace(replace(replace({}, 'Rewritten Caption: ', ''), chr(10), ' '), '  ', ' ')"

ORACLE_SQL = {
    "pose_track": f"WITH {_POSES} SELECT clip_id, frame, round(c, 4) + 0.0 AS cos, round(s, 4) + 0.0 AS sin, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM posed",
    "novel_paths": f"""WITH {_POSES}, ends AS (SELECT clip_id, max(frame) AS last FROM daily GROUP BY clip_id)
SELECT p.clip_id, k::INTEGER AS camera, frame, round(c, 4) + 0.0 AS cos, round(s, 4) + 0.0 AS sin, round(c * 2 * k - s * k + x, 4) + 0.0 AS x, round(s * 2 * k + c * k + y, 4) + 0.0 AS y
FROM posed p JOIN ends USING (clip_id), unnest([0, 1]) AS t(k) WHERE frame <= last""",
    "spin_track": f"""WITH {_DAILY}, v AS (SELECT clip_id, frame, CASE WHEN pf IS NULL THEN nv WHEN nf IS NULL OR nf = pf THEN pv ELSE pv + (nv - pv) * ((frame - pf)::DOUBLE / (nf - pf)::DOUBLE) END AS a FROM around)
SELECT clip_id, frame, round(cos(a), 4) + 0.0 AS cos, round(sin(a), 4) + 0.0 AS sin, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, 3.0::DOUBLE AS z FROM v""",
    "all_tracks": """WITH k AS (SELECT user_id AS track, event_type AS attr, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS frame, max(value) AS value FROM events GROUP BY ALL),
s AS (SELECT track, attr, f::INTEGER AS frame FROM (SELECT track, min(frame) AS a, max(frame) AS b FROM k GROUP BY track) JOIN (SELECT DISTINCT track, attr FROM k) USING (track), unnest(range(a, b + 1)) AS t(f))
SELECT s.track, s.attr, s.frame, round(coalesce(p.value, n.value), 4) + 0.0 AS value FROM s ASOF LEFT JOIN k p ON p.track = s.track AND p.attr = s.attr AND s.frame >= p.frame ASOF LEFT JOIN k n ON n.track = s.track AND n.attr = s.attr AND s.frame <= n.frame""",
    "edited_keyframes": f"""WITH k AS (SELECT user_id AS track, event_type AS attr, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS frame, max(value) AS value FROM events GROUP BY ALL)
SELECT track, attr, frame, round(CASE WHEN attr = kinds[1] THEN value * 2 ELSE value END, 4) + 0.0 AS value FROM k, {_KINDS} WHERE attr <> kinds[-1]""",
    "record_objects": """SELECT l_orderkey AS clip_id, (l_linenumber * 3)::INTEGER AS frame, l_partkey::VARCHAR AS track_id, (['Car', 'Pedestrian', 'Cyclist'])[l_partkey % 4 + 1] AS object_type, sqrt(pow(l_discount * 2, 2) + pow(l_tax, 2)) > 0.2::DOUBLE AS is_moving,
  round(cos(l_discount * 10 + l_quantity / 10), 4) + 0.0 AS cos, round(sin(l_discount * 10 + l_quantity / 10), 4) + 0.0 AS sin, round(cos(l_discount * 10) * l_quantity - sin(l_discount * 10) * 2 + l_tax * 100, 4) + 0.0 AS x,
  round(sin(l_discount * 10) * l_quantity + cos(l_discount * 10) * 2 + 1, 4) + 0.0 AS y, 0.5::DOUBLE AS z FROM lineitem WHERE l_partkey % 4 <> 3 AND l_returnflag <> 'R'""",
    "record_features": """WITH f AS (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM lineitem)
SELECT l_orderkey AS clip_id, (['lanes', 'lanelines', 'road_boundaries', 'crosswalks'])[l_suppkey % 5 + 1] AS layer, l_partkey AS feature_id, CASE WHEN l_suppkey % 5 = 3 THEN 'polygon' ELSE 'polyline' END AS geom_type,
  l_quantity * CASE WHEN l_suppkey % 5 = 3 THEN 2 ELSE 1 END AS x, CASE WHEN l_suppkey % 5 = 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM f WHERE l_linenumber = first AND l_suppkey % 5 <> 4""",
    "record_calibrations": """WITH n AS (SELECT l_orderkey, min(l_linenumber) AS first, (max(l_linenumber) * 3)::INTEGER AS last, max(l_partkey) * 1000000 AS micros FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS clip_id, 'camera_' || lower(l_returnflag) AS camera, l_quantity AS fx, l_tax AS fy, 10.0::DOUBLE AS cx, 20.0::DOUBLE AS cy, 64.0::DOUBLE AS w, 48.0::DOUBLE AS h, last, micros FROM lineitem JOIN n USING (l_orderkey) WHERE l_linenumber = first""",
    "default_intrinsics": """WITH c AS (SELECT DISTINCT l_suppkey, l_partkey % 40 AS k FROM lineitem), n AS (SELECT DISTINCT p_partkey % 40 AS k FROM part)
SELECT l_suppkey::VARCHAR AS clip_id, 'c' || c.k AS camera, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey::DOUBLE WHEN n.k IS NOT NULL AND n.k <> 7 THEN -1.0::DOUBLE END AS first, l_suppkey % 3 <> 0 AND n.k IS NOT NULL AND n.k <> 7 AS is_default FROM c LEFT JOIN n USING (k)""",
    "tar_round_trip": f"WITH {_V} SELECT clip_id::VARCHAR AS clip_id, 0 AS frame, id::VARCHAR AS track_id, 'Car' AS object_type, true AS is_moving, round(e0, 4) + 0.0 AS x, round(sin(e3), 4) + 0.0 AS sin, round((abs(e11) + 1) * 2, 4) + 0.0 AS h FROM v",
    "pose_tars": f"""WITH {_V}, f AS (SELECT clip_id, e0, e3, e10 FROM v WHERE r = 1)
SELECT v.clip_id::VARCHAR AS clip_id, 'front_wide' AS camera, (r - 1)::INTEGER AS frame, round(cos(v.e3), 4) + 0.0 AS cos, round(sin(v.e3), 4) + 0.0 AS sin, round(v.e0, 4) + 0.0 AS x, round(v.e1, 4) + 0.0 AS y, round(v.e2, 4) + 0.0 AS z,
  round(f.e0, 4) + 0.0 AS fx, round(f.e3, 4) + 0.0 AS cy, round(f.e10, 4) + 0.0 AS e10, 14 AS n FROM v JOIN f USING (clip_id)""",
    "inferred": """WITH n AS (SELECT doc_id, doc_id % 5 = 0 OR len(string_split(text, ' ')) = 1 AS bad, len(string_split(text, ' '))::VARCHAR AS n FROM documents)
SELECT doc_id, CASE WHEN NOT bad THEN n END AS response, CASE WHEN bad THEN 'not accepted' END AS error FROM n""",
    "map_json": f"""WITH {_V} SELECT clip_id::VARCHAR AS clip_id, 'poles' AS layer, (r - 1)::INTEGER AS feature_id, (['polyline', 'polygon', 'cuboid3d'])[id % 3 + 1] AS geom_type, CASE WHEN id % 3 = 2 THEN 8 ELSE 2 END AS n,
  {', '.join(f'round(CASE WHEN id % 3 = 2 THEN 8 * e{i} ELSE e{i} + e{i + 3} END, 4) + 0.0 AS {a}' for i, a in enumerate('xyz'))} FROM v""",
    "layer_colours": f"SELECT page_id, layer, geom_type, r, g, b FROM pages JOIN {_LAYERS} ON page_id % {len(raster.LAYERS)} = k",
    "multiview_captions": """WITH c AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'left' ELSE 'cross_left' END || '_' || turn || '_' || role AS view, length(text)::VARCHAR AS text, turn, role FROM conversations)
SELECT conv_id::VARCHAR AS clip_id, view, text FROM c""",
    "clip_selection": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0)",
    "paired_files": "SELECT 'clip_' || p_partkey AS name, 'rgb/' || p_partkey AS rgb_path, 'hdmap/' || p_partkey AS condition_path FROM part",
    "video_chunks": """WITH n AS (SELECT c_custkey, least((c_custkey % 400) // 3 + 1, 70) AS n FROM customer), c AS (SELECT *, c AS chunk FROM n, unnest(range(CASE WHEN n < 40 THEN 0 ELSE (n - 40) // 30 + 1 END)) AS t(c))
SELECT c_custkey AS clip_id, chunk::INTEGER AS chunk, p::INTEGER AS pos, (p * 3)::INTEGER AS frame FROM c, unnest(range(chunk * 30, chunk * 30 + 40)) AS t(p)""",
    "chats": f"""SELECT doc_id AS clip_id, k AS variation, CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 5 END AS n,
  md5('system|You rewrite captions.#user|Caption: ' || coalesce(text, '') || ' Kind: ' || k || CASE WHEN doc_id % 2 = 0 THEN '#assistant|' || lang ELSE '' END || '#user|{_TURN1}#assistant|' || source || '#user|' || replace('{_TURN2}', '%s', coalesce(text, ''))) AS digest
FROM documents, unnest(['Night', 'Rainy']) AS t(k)""",
    "rewritten": f"SELECT doc_id AS clip_id, lang AS variation, md5({_CLEAN.format('CASE WHEN doc_id % 3 = 0 THEN text ELSE lang END')}) AS digest FROM documents WHERE doc_id % 3 < 2 OR contains(text, 'New caption:')",
    "caption_tasks": f"SELECT doc_id AS clip_id, k AS variation, lang AS text FROM documents, unnest([{', '.join(f"'{k}'" for k in manifest.REWRITES)}]) AS t(k) WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "embedding_cut": """SELECT vec_id, (vec_id % 8)::INTEGER AS n_tokens, (vec_id % 8)::INTEGER AS n_rows, coalesce(list_sum(list_transform(embedding[1:vec_id % 8], lambda x: trunc((x * 1000)::FLOAT)::DOUBLE)), 0.0)::DOUBLE AS total FROM embeddings WHERE vec_id % 11 <> 0""",
    "embedding_tasks": f"""SELECT ({_VIEWS})[doc_id % 5 + 1] AS view, 'd' || doc_id AS key, '_0' AS chunk, CASE doc_id % 5 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(manifest.PREFIXES.values()))} END || ' ' || lang AS prompt, 'v/d' || doc_id AS path
FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 7 <> 0""",
    "multiview_tasks": """WITH f AS (SELECT user_id::VARCHAR AS clip_id, event_type, printf('%09d', min(event_id)) AS path FROM events GROUP BY ALL),
g AS (SELECT clip_id, string_agg(path, ',' ORDER BY event_type) AS paths FROM f GROUP BY clip_id HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events))
SELECT clip_id, clip_id || '_Night' AS output, paths FROM g WHERE clip_id IN (SELECT user_id::VARCHAR FROM events WHERE value > 95) AND clip_id::BIGINT % 5 <> 0""",
}
