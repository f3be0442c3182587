"""Resampling, interpolation and chunking of tracks.

Windows run inside one track or clip, never over the whole table, and along tracks inside a block of frames (scans).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetables.functions import mat
from scenetables.operators import scans

#: Divisor of a handle's slope, and how many times its length it may be long.
HANDLE_SCALE = 2.5614
HANDLE_CAP = 5.0
BISECTIONS = 60


def render_frames(poses: DataFrame, keys: Sequence[str], pose_fps: int, target_fps: int, chunk: int = 0, overlap: int = 0, max_chunk: int = -1) -> DataFrame:
    """(keys, frame, pos): every (pose_fps // target_fps)-th frame from 0 to the last one of each track, and at most as many
    as max_chunk chunks need (all of them if max_chunk <= 0)."""
    step = pose_fps // target_fps
    n = poses.groupBy(*keys).agg(F.max("frame").alias("last"))
    out = n.select(*keys, F.posexplode(F.expr(f"sequence(0, last, {step})")).alias("pos", "frame"))
    return out.filter(F.col("pos") < chunk + (chunk - overlap) * (max_chunk - 1)) if max_chunk > 0 else out


def chunked(frames: DataFrame, keys: Sequence[str], chunk: int, overlap: int = 0) -> DataFrame:
    """Adds `chunk` to rows with a 0-based `pos`: chunks of `chunk` rows start every chunk - overlap rows, and a row may be in
    several. An incomplete tail is dropped."""
    step = chunk - overlap
    n = frames.groupBy(*keys).agg((F.max("pos") + 1).alias("__n"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("pos") - chunk + 1) / step)).cast("int"), F.floor(F.col("pos") / step).cast("int")
    f = frames.join(n, list(keys)).withColumn("__last", F.least(last, F.floor((F.col("__n") - chunk) / step).cast("int"))).withColumn("__first", first)
    return f.filter("__first <= __last").withColumn("chunk", F.explode(F.sequence("__first", "__last"))).drop("__n", "__first", "__last")


def upsample(tracks: DataFrame, keys: Sequence[str], values: Sequence[str], factor: int = 3) -> DataFrame:
    """Numbers between consecutive rows of a track by straight lines; frame numbers are multiplied. The last row stays alone."""
    t = scans.with_neighbour(tracks.select(*keys, "frame", *values), keys, values, "__n")
    t = t.withColumn("__k", F.explode(F.when(F.col("__n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))))
    at = F.col("__k") / factor
    return t.select(*keys, (F.col("frame") * factor + F.col("__k")).alias("frame"), *(F.when(F.col("__k") == 0, F.col(v)).otherwise(mat.lerp(F.col(v), F.col("__n")[v], at)).alias(v) for v in values))


def upsample_poses(poses: DataFrame, keys: Sequence[str], factor: int = 3) -> DataFrame:
    """Poses between consecutive frames: translation by lerp, rotation by slerp. Source frames stay as they are."""
    t = scans.with_neighbour(poses.select(*keys, "frame", "m"), keys, ["m"], "__n").select(*keys, "frame", "m", F.col("__n.m").alias("__m"))
    t = t.withColumn("__k", F.explode(F.when(F.col("__m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))))
    t = mat.with_interpolated_pose(t, "m", "__m", F.col("__k") / factor, "__between")
    return t.select(*keys, (F.col("frame") * factor + F.col("__k")).alias("frame"), F.when(F.col("__k") == 0, F.col("m")).otherwise(F.col("__between")).alias("m"))


def extrapolate(tracks: DataFrame, keys: Sequence[str], values: Sequence[str], extra: int = 2) -> DataFrame:
    """Adds `extra` frames at the end of each track, each by the difference of its last two frames. A track of one frame is
    held."""
    t = scans.with_neighbour(tracks.select(*keys, "frame", *values), keys, values, "__p", ahead=False)
    t = t.groupBy(*keys).agg(F.max_by(F.struct("frame", *values, "__p"), "frame").alias("__e")).select(*keys, "__e.*")
    t = t.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(extra))))
    tail = t.select(*keys, (F.col("frame") + F.col("__k")).alias("frame"), *((F.col(v) + F.col("__k") * (F.col(v) - F.coalesce(F.col("__p")[v], F.col(v)))).alias(v) for v in values))
    return tracks.select(*keys, "frame", *values).unionByName(tail)


def extrapolate_poses(poses: DataFrame, keys: Sequence[str], extra: int = 2) -> DataFrame:
    """The translation goes on by its last step; the rotation is held."""
    p = poses.select(*keys, "frame", *(c.alias(f"t{i}") for i, c in enumerate(mat.shift("m"))), "m")
    last = p.groupBy(*keys).agg(F.max("frame").alias("__frame"), F.max_by("m", "frame").alias("__m"))
    moved = extrapolate(p, keys, ["t0", "t1", "t2"], extra).join(last, list(keys)).filter("frame > __frame")
    tail = moved.select(*keys, "frame", mat.pose(mat.rot("__m"), [F.col("t0"), F.col("t1"), F.col("t2")]).alias("m"))
    return poses.select(*keys, "frame", "m").unionByName(tail)


def bracket(spine: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spine(keys, frame) with prev and next: the nearest labelled frames at or before and at or after it, or null.

    One window over the union of both, by clip and block of frames, in either direction: each row adds to a running value, so the time follows the number of frames, and a
    clip of any length is spread over tasks. Of a spine row and a label at the same frame, the label comes first in its direction. Tracks are joined afterwards, so a track that is missing at one of the
    bracketing frames is not bridged."""
    s = spine.select(*keys, "frame", F.lit(None).cast("int").alias("__label"))
    both = s.unionByName(labels.select(*keys, "frame", F.col("frame").cast("int").alias("__label")).distinct())
    out = scans.with_labels_around(both, keys, "__label")
    return out.filter("__label IS NULL").drop("__label")


def _around(spine: DataFrame, frames: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """spine with prev, next and each value at both (p_<value>, n_<value>). A keyframe's values go along with it, so frames is not joined again; a track has one
    keyframe at a frame."""
    label = F.struct(F.col("frame").cast("int").alias("__at"), *values)
    k = frames.select(*keys, "frame", label.alias("__label"))
    s = spine.select("*", F.lit(None).cast(k.schema["__label"].dataType).alias("__label"))
    out = scans.with_labels_around(s.unionByName(k, allowMissingColumns=True), keys, "__label").filter("__label IS NULL")
    at = lambda side, p: (F.col(f"{side}.{v}").alias(f"{p}_{v}") for v in values)
    return out.select(*spine.columns, F.col("prev.__at").alias("prev"), F.col("next.__at").alias("next"), *at("prev", "p"), *at("next", "n"))


def hold(spine: DataFrame, keyframes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The value of the last keyframe at or before a frame; before the first, that of the first."""
    a = _around(spine, keyframes, keys, values)
    return a.select(*keys, "frame", *(F.when(F.col("prev").isNotNull(), F.col(f"p_{v}")).otherwise(F.col(f"n_{v}")).alias(v) for v in values))


def _fraction() -> Column:
    return F.try_divide((F.col("frame") - F.col("prev")).cast("double"), (F.col("next") - F.col("prev")).cast("double"))


def linear(spine: DataFrame, keyframes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Straight lines between keyframes; the first and last values are held outside."""
    a = _around(spine, keyframes, keys, values)

    def at(v: str) -> Column:
        p, n = F.col(f"p_{v}"), F.col(f"n_{v}")
        return F.when(F.col("prev").isNull(), n).when(F.col("next").isNull() | (F.col("prev") == F.col("next")), p).otherwise(mat.lerp(p, n, _fraction())).alias(v)

    return a.select(*keys, "frame", *map(at, values))


def bezier_handles(keyframes: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keyframes with the auto-clamped handles of each: (lx, ly) towards the one before, (rx, ry) towards the one after.

    A handle is the gap to its neighbour over HANDLE_SCALE long, the gaps being capped at HANDLE_CAP times each other, and
    follows the mean of the slopes on both sides. It is flat at the ends and at extrema. Where it would pass its neighbour's
    value, the slope that just reaches it holds for both handles; the left side goes first."""
    return _handles(keyframes, keys, [value]).withColumnsRenamed({f"ly_{value}": "ly", f"ry_{value}": "ry"})


def _handles(keyframes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The handles of several columns: keys, frame, values, lx, rx, and ly_<value>, ry_<value> of each. Lengths follow the frames, so lx and rx are those of all columns."""
    w = Window.partitionBy(*keys).orderBy("frame")
    x = F.col("frame").cast("double")
    rises = [c for v in values for c in ((F.col(v).cast("double") - F.lag(F.col(v).cast("double")).over(w)).alias(f"ra_{v}"), (F.lead(F.col(v).cast("double")).over(w) - F.col(v).cast("double")).alias(f"rb_{v}"))]
    k = keyframes.select(*keys, "frame", *values, (x - F.lag(x).over(w)).alias("ga"), (F.lead(x).over(w) - x).alias("gb"), *rises)
    inner = F.col("ga").isNotNull() & F.col("gb").isNotNull()
    k = k.withColumn("ha", F.when(inner, F.least(F.col("ga"), HANDLE_CAP * F.col("gb"))))
    k = k.withColumn("hb", F.when(inner, F.least(F.col("gb"), HANDLE_CAP * F.col("ha"))))
    # an end takes its only gap for both sides, a lone keyframe one frame
    end = F.coalesce("ga", "gb", F.lit(HANDLE_SCALE))
    k = k.withColumn("ha", F.coalesce("ha", end) / HANDLE_SCALE).withColumn("hb", F.coalesce("hb", end) / HANDLE_SCALE)
    slope = lambda v: F.when(inner & (F.col(f"ra_{v}") * F.col(f"rb_{v}") > 0), (F.col(f"ra_{v}") / F.col("ga") + F.col(f"rb_{v}") / F.col("gb")) / 2).otherwise(mat.d(0))
    k = k.withColumns({f"slope_{v}": slope(v) for v in values})
    steep = lambda v, h, r: F.abs(F.col(f"slope_{v}")) * F.col(h) > F.abs(F.col(f"{r}_{v}"))
    clamped = lambda v: F.when(steep(v, "ha", "ra"), F.col(f"ra_{v}") / F.col("ha")).when(steep(v, "hb", "rb"), F.col(f"rb_{v}") / F.col("hb")).otherwise(F.col(f"slope_{v}"))
    k = k.withColumns({f"slope_{v}": clamped(v) for v in values})
    ends = [c for v in values for c in ((F.col(v).cast("double") - F.col(f"slope_{v}") * F.col("ha")).alias(f"ly_{v}"), (F.col(v).cast("double") + F.col(f"slope_{v}") * F.col("hb")).alias(f"ry_{v}"))]
    return k.select(*keys, "frame", *values, (x - F.col("ha")).alias("lx"), (x + F.col("hb")).alias("rx"), *ends)


def _cubic(a: Column, b: Column, c: Column, e: Column, s: Column) -> Column:
    q = 1 - s
    return a * q * q * q + 3 * b * q * q * s + 3 * c * q * s * s + e * s * s * s


def bezier(spine: DataFrame, keyframes: DataFrame, keys: Sequence[str], values: str | Sequence[str] = "value") -> DataFrame:
    """Auto-clamped Bezier curves of one or more columns between keyframes, held outside. The curve's abscissa rises, so bisection finds the frame, once for all columns."""
    values = [values] if isinstance(values, str) else list(values)
    h = _handles(keyframes, keys, values)
    a = _around(spine, h, keys, ["lx", "rx", *values, *(f"{e}_{v}" for v in values for e in ("ly", "ry"))])
    x0, x1, t = F.col("prev").cast("double"), F.col("next").cast("double"), F.col("frame").cast("double")

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = _cubic(x0, F.col("p_rx"), F.col("n_lx"), x1, mid) < t
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(mat.d(0).alias("lo"), mat.d(1).alias("hi")), halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    # a generator, so that the bisection is not copied into each column
    a = a.withColumn("__s", F.explode(F.array(F.when(F.col("prev") < F.col("next"), found))))

    def at(v: str) -> Column:
        p, n = F.col(f"p_{v}"), F.col(f"n_{v}")
        y = F.when(F.col("prev").isNull(), n).when(F.col("__s").isNull(), p).otherwise(_cubic(p.cast("double"), F.col(f"p_ry_{v}"), F.col(f"n_ly_{v}"), n.cast("double"), F.col("__s")))
        return y.cast("double").alias(v)

    return a.select(*keys, "frame", *map(at, values))


def align_signs(quats: DataFrame, keys: Sequence[str], items: Sequence[str] = ("w", "x", "y", "z")) -> DataFrame:
    """Flips quaternions along a track so that each is on the side of the one before. The sign is the parity of the negative
    products so far; a product of exactly zero starts anew with the sign as given."""
    q = scans.with_neighbour(quats, keys, items, "__p", ahead=False)
    q = q.withColumn("__dot", mat.dot([F.col(c) for c in items], [F.col("__p")[c] for c in items])).drop("__p")
    q = scans.with_parity(q, keys, F.col("__dot") < 0, F.col("__dot") == 0, "__odd")
    sign = F.when(F.col("__odd"), mat.d(-1)).otherwise(mat.d(1))
    return q.select(*(((F.col(c) * sign).alias(c) if c in items else F.col(c)) for c in quats.columns))


def _q(prefix: str) -> Column:
    return mat.quat(*(F.col(f"{prefix}{c}") for c in "wxyz"))


def slerp_track(spine: DataFrame, quats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quaternions w, x, y, z at the frames of the spine: aligned, then slerp; held outside."""
    a = _around(spine, align_signs(quats, keys), keys, list("wxyz")).withColumn("__p", _q("p_")).withColumn("__n", _q("n_"))
    a = mat.with_slerp(a, "__p", "__n", _fraction(), "__q", align=False)
    q = F.when(F.col("prev").isNull(), F.col("__n")).when(F.col("next").isNull() | (F.col("prev") == F.col("next")), F.col("__p")).otherwise(F.col("__q"))
    return a.select(*keys, "frame", q.alias("q")).select(*keys, "frame", "q.*")


def squad_track(spine: DataFrame, quats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spherical quadrangle spline: slerp of the chord and of the tangents' chord at 2 a (1 - a). A tangent is
    q exp(-(log(q* q before) + log(q* q after)) / 4); the ends take themselves as their neighbours."""
    w = Window.partitionBy(*keys).orderBy("frame")
    q = align_signs(quats, keys).select(*keys, "frame", *"wxyz", *(F.coalesce(f(c).over(w), c).alias(f"{p}{c}") for f, p in ((F.lag, "b"), (F.lead, "a")) for c in "wxyz"))
    me = [F.col(c) for c in "wxyz"]
    conj = [me[0], *(-c for c in me[1:])]
    to = lambda p: mat.q_log(mat.q_mul(conj, [F.col(f"{p}{c}") for c in "wxyz"]))
    q = q.select(*keys, "frame", *"wxyz", F.array(*to("b")).alias("__b"), F.array(*to("a")).alias("__a"))
    tangent = mat.q_mul(me, mat.q_exp([-(F.col("__b")[i] + F.col("__a")[i]) / 4 for i in range(3)]))
    q = q.select(*keys, "frame", *"wxyz", *(c.alias(f"t{n}") for c, n in zip(tangent, "wxyz")))
    a = _around(spine, q, keys, [*"wxyz", *(f"t{c}" for c in "wxyz")]).withColumn("__t", _fraction())
    a = a.withColumns({"__p": _q("p_"), "__n": _q("n_"), "__pt": _q("p_t"), "__nt": _q("n_t"), "__f": F.col("__t")})
    a = mat.with_slerp(a, "__p", "__n", F.col("__f"), "__c", align=False)
    a = mat.with_slerp(a, "__pt", "__nt", F.col("__f"), "__i", align=False)
    a = mat.with_slerp(a, "__c", "__i", 2 * F.col("__f") * (1 - F.col("__f")), "__q", align=False)
    out = F.when(F.col("prev").isNull(), F.col("__n")).when(F.col("next").isNull() | (F.col("prev") == F.col("next")), F.col("__p")).otherwise(F.col("__q"))
    return a.select(*keys, "frame", out.alias("q")).select(*keys, "frame", "q.*")


def pose_track(spine: DataFrame, keyframes: DataFrame, keys: Sequence[str], position: str = "bezier", rotation: str = "components") -> DataFrame:
    """(keys, frame, m) from keyframes (x, y, z, qw, qx, qy, qz). position: "linear" or "bezier"; rotation: "components" (the
    four items in the same way, renormalised), "slerp" or "squad"."""
    if position not in ("linear", "bezier") or rotation not in ("components", "slerp", "squad"):
        raise ValueError("unknown interpolation")
    names = ["x", "y", "z"]
    source = keyframes.select(*keys, "frame", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "qw", "qx", "qy", "qz")))
    if rotation == "components":
        names += ["qw", "qx", "qy", "qz"]
        source = align_signs(source, keys, names[3:])
    # one pass for all columns of a track: they share their keyframes, and so the frames around each
    wide = linear(spine, source, keys, names) if position == "linear" else bezier(spine, source, keys, names)
    if rotation == "components":
        n = F.sqrt(F.col("qw") ** 2 + F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2) + 1e-6
        wide = wide.withColumns({f"q{c}": F.col(f"q{c}") / n for c in "wxyz"})
    else:
        q = keyframes.select(*keys, "frame", *(F.col(f"q{c}").alias(c) for c in "wxyz"))
        track = (slerp_track if rotation == "slerp" else squad_track)(spine, q, keys)
        wide = wide.join(track.select(*keys, "frame", *(F.col(c).alias(f"q{c}") for c in "wxyz")), [*keys, "frame"])
    return wide.select(*keys, "frame", mat.pose(mat.q_rotation(_q("q")), [F.col("x"), F.col("y"), F.col("z")]).alias("m"))


def spin_track(spine: DataFrame, keyframes: DataFrame, keys: Sequence[str], axis: str, centre: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """(keys, frame, m): a rotation about an axis by the linearly interpolated angle `value`."""
    t = linear(spine, keyframes, keys, ["value"])
    return t.select(*keys, "frame", mat.axis_angle(F.col("value"), F.lit(axis), [mat.d(c) for c in centre]).alias("m"))


def timeline(keyframes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """first_t, last_t (both folded with 0) and enabled (first_t < last_t) of each group, or of all keyframes."""
    first, last = F.least(F.lit(0), F.min("frame")), F.greatest(F.lit(0), F.max("frame"))
    return keyframes.groupBy(*keys).agg(first.alias("first_t"), last.alias("last_t"), (first < last).alias("enabled"))


def evaluate_tracks(spine: DataFrame, keyframes: DataFrame, way: str = "linear") -> DataFrame:
    """(track, attr, frame, value) of every track and attribute at every frame of spine(track, frame). Tracks without
    keyframes do not appear. way: hold, linear or bezier."""
    keys = ["track", "attr"]
    every = spine.join(keyframes.select(*keys).distinct(), "track").select(*keys, "frame")
    if way == "bezier":
        return bezier(every, keyframes, keys)
    return {"hold": hold, "linear": linear}[way](every, keyframes, keys, ["value"])


def set_keyframes(keyframes: DataFrame, changes: DataFrame, keys: Sequence[str] = ("track", "attr")) -> DataFrame:
    """Keyframes with changes added; a change replaces the key at its frame."""
    return keyframes.join(changes, [*keys, "frame"], "left_anti").unionByName(changes.select(keyframes.columns))


def remove_keyframes(keyframes: DataFrame, gone: DataFrame, keys: Sequence[str] = ("track", "attr")) -> DataFrame:
    return keyframes.join(gone, [*keys, "frame"], "left_anti")


def novel_trajectory(keyframes: DataFrame, last_frames: DataFrame, rig: DataFrame, position: str = "bezier", heights: DataFrame | None = None) -> DataFrame:
    """(clip_id, camera, frame, m): poses of all cameras along a new path.

    keyframes: clip_id, frame, x, y, z, qw..qz of the front camera, with keys at 0 and at the clip's last frame, else it is
    an error; last_frames: clip_id, last; rig: clip_id, camera, m (front camera to that camera); heights (clip_id, height):
    the path's poses are laid flat at that height."""
    spine = last_frames.select("clip_id", F.explode(F.expr("sequence(0, last)")).alias("frame"))
    ends = keyframes.groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).join(last_frames, "clip_id")
    ok = F.when((F.col("a") == 0) & (F.col("b") == F.col("last")), True).otherwise(F.raise_error(F.lit("a path needs keys at its first and last frame")).cast("boolean"))
    checked = keyframes.join(ends.select("clip_id", ok.alias("__ok")), "clip_id").filter("__ok").drop("__ok")
    path = pose_track(spine, checked, ["clip_id"], position)
    if heights is not None:
        path = path.join(heights, "clip_id").select("clip_id", "frame", mat.grounded("m", F.col("height"), "opencv").alias("m"))
    r = rig.select("clip_id", "camera", F.col("m").alias("rm"))
    return path.join(r, "clip_id").select("clip_id", "camera", "frame", mat.mat_mul("m", "rm").alias("m"))


def expand_rig(front: DataFrame, camera_poses: DataFrame, front_camera: str) -> DataFrame:
    """(clip_id, camera, frame, m): a front-camera track carried to the other cameras by their relative pose at frame 0."""
    zero = camera_poses.filter("frame = 0")
    base = zero.filter(F.col("camera") == front_camera).select("clip_id", mat.affine_inv("m").alias("inv"))
    rel = zero.join(base, "clip_id").select("clip_id", "camera", mat.mat_mul("inv", "m").alias("rel"))
    return front.select("clip_id", "frame", "m").join(rel, "clip_id").select("clip_id", "camera", "frame", mat.mat_mul("m", "rel").alias("m"))
