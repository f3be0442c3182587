"""LiDAR points: boxes they lie in, motion with boxes, sweep windows, masks and depth splatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators.geometry import depth_grey, kept

SLACK = 1e-6
CELL = 8.0  # metres of a grid cell
NEAR = 3.0
MOVE_SCALE = 1.2
SATURATION, FAR = 50.0, 1000.0  # of splats: how fast weights fall with depth, and the depth at which they stay
#: Pixels outside the image from which a kernel may still reach in.
SIZE_MARGIN = 4


def near_filtered(points: DataFrame, least: float = NEAR) -> DataFrame:
    """Points at a distance of `least` or more in the sweep's own frame."""
    return points.filter(mat.norm([F.col(c) for c in "xyz"]) >= least)


def merged_returns(first: DataFrame, second: DataFrame, sensor: str = "TOP") -> DataFrame:
    """All returns of one sensor; equal points are kept."""
    return first.unionByName(second).filter(F.col("sensor") == sensor)


def to_world(points: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Points of (clip_id, frame) carried into the world by the sweep's pose."""
    moved = mat.apply("m", [F.col(c) for c in "xyz"])
    keep = [c for c in points.columns if c not in "xyz"]
    return points.join(sweeps, ["clip_id", "frame"]).select(*keep, *(c.alias(n) for c, n in zip(moved, "xyz")))


def nearest_sweep(frame: Column, step: int) -> Column:
    """frame rounded to a multiple of step, halves to the even multiple."""
    return (F.bround(frame / step) * step).cast("int")


def sweep_window(frames: DataFrame, sweeps: DataFrame, k: int = 2, step: int = 3) -> DataFrame:
    """(clip_id, frame, offset, sweep): for each render frame the sweeps of the frames from k before to k after it.

    Each is clamped to the clip's render frames, rounded to a sweep, and clamped to the last sweep that is not after the last
    render frame. Clamping may name a sweep several times: all are kept."""
    ends = frames.groupBy("clip_id").agg(F.max("frame").alias("__end"))
    last = sweeps.join(ends, "clip_id").filter("frame <= __end").groupBy("clip_id").agg(F.max("frame").alias("__sweep"))
    f = frames.select("clip_id", "frame").join(ends, "clip_id").join(last, "clip_id")
    f = f.withColumn("offset", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    at = F.least(F.greatest(F.col("frame") + F.col("offset"), F.lit(0)), F.col("__end"))
    return f.select("clip_id", "frame", "offset", F.least(nearest_sweep(at, step), F.col("__sweep")).cast("int").alias("sweep"))


def ground_height(egos: DataFrame, vertices: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """(keys, height): z of the vertex nearest to each ego in x and y; the smaller vertex_id in ties. One ego for each key, so
    the work is one pass over the vertices."""
    e = egos.select(*keys, F.col("x").alias("ex"), F.col("y").alias("ey"))
    d2 = (F.col("x") - F.col("ex")) ** 2 + (F.col("y") - F.col("ey")) ** 2
    return vertices.join(e, list(keys)).groupBy(*keys).agg(F.min_by("z", F.struct(d2.alias("d"), "vertex_id")).alias("height"))


def _inside(scale: float) -> Column:
    local = mat.inv_apply("bm", [F.col(c) for c in "xyz"])
    out = F.lit(True)
    for i, c in enumerate(local):
        out = out & (F.abs(c) <= F.col("lwh")[i] / 2 * scale + SLACK)
    return out


def _bounds(scale: float, cell: float) -> Column:
    """Struct of a box's place on the ground (at), half the sides of the square around it (reach), and the level whose cells are as wide as that; null
    where one of them is no number."""
    r = mat.rot("bm")
    reach = [sum((F.abs(r[3 * i + j]) * F.col("lwh")[j] for j in range(3)), mat.d(0)) / 2 * scale + SLACK for i in range(2)]
    at = mat.shift("bm")[:2]
    level = F.greatest(F.ceil(F.log2(2 * F.greatest(*reach) / cell)), F.lit(0)).cast("int")
    sound = F.greatest(*(F.abs(x) for x in (*reach, *at))) < 1e15  # false for what is no number
    return F.when(sound, F.struct(F.array(*at).alias("at"), F.array(*reach).alias("reach"), level.alias("level")))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("clip_id", "frame"), scale: float = 1.0, moving_only: bool = False, cell: float = CELL) -> DataFrame:
    """Columns of points and the track_id, lwh and bm (pose) of every box of the same keys that holds them.

    A box lies at the level of a grid of several levels whose cells are as wide as its bounding square, so it is sent to four cells at most, whatever its size; a point
    probes its cell at each level that boxes lie at. The join has an equi key, and its work follows the points near boxes, not the pairs of a frame. Boxes whose
    place or size is no number hold no point."""
    b = boxes.filter("is_moving") if moving_only else boxes
    b = kept(b.select(*keys, "track_id", "lwh", F.col("m").alias("bm")), "__box", _bounds(scale, cell))
    # as many levels as powers of two between the smallest and the largest box: a few
    levels = sorted(r[0] for r in b.select("__box.level").distinct().collect())
    side = lambda level: F.pow(mat.d(2), level.cast("double")) * cell
    own = side(F.col("__box.level"))
    span = lambda i: F.sequence(F.floor((F.col("__box.at")[i] - F.col("__box.reach")[i]) / own), F.floor((F.col("__box.at")[i] + F.col("__box.reach")[i]) / own))
    b = b.withColumn("__cx", F.explode(span(0))).withColumn("__cy", F.explode(span(1))).withColumn("__level", F.col("__box.level")).drop("__box")
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("__cx", F.floor(F.col("x") / side(F.col("__level")))).withColumn("__cy", F.floor(F.col("y") / side(F.col("__level"))))
    return p.join(b, [*keys, "__level", "__cx", "__cy"]).filter(_inside(scale)).drop("__level", "__cx", "__cy")


def moved_with_boxes(points: DataFrame, source: DataFrame, target: DataFrame, scale: float = MOVE_SCALE, moving_only: bool = True, keys: Sequence[str] = ("clip_id", "frame"), drop: bool = True, strict: bool = False) -> DataFrame:
    """points carried from the boxes that hold them in `source` to the same tracks in `target` (both keyed alike).

    The columns of points stay, point_id naming a point within its keys. A point outside all boxes stays where it is. One
    in a box moves by M_target M_source^-1 of the smallest track_id. If any box that holds it is missing from target it is
    dropped; with drop=False it stays in place, and a column mask says whether it is valid. strict=True makes a missing
    box an error."""
    held = points_in_boxes(points.select(*keys, "point_id", *"xyz"), source, keys, scale, moving_only)
    t = target.select(*keys, "track_id", F.col("m").alias("tm"))
    held = held.join(t, [*keys, "track_id"], "left")
    if strict:
        held = held.withColumn("tm", F.coalesce("tm", F.raise_error(F.lit("a box is missing from the target")).cast("array<double>")))
    one = held.groupBy(*keys, "point_id").agg(F.min_by(F.struct("bm", "tm"), "track_id").alias("move"), F.bool_or(F.col("tm").isNull()).alias("gone"))
    p = points.join(one, [*keys, "point_id"], "left")
    local = mat.inv_apply(F.col("move.bm"), [F.col(c) for c in "xyz"])
    p = p.withColumn("__local", F.when(F.col("move.tm").isNotNull() & ~F.col("gone"), F.array(*local)))
    world = mat.apply(F.col("move.tm"), mat.vec("__local"))
    keep = [c for c in points.columns if c not in "xyz"]
    out = p.select(*keep, *(F.coalesce(w, F.col(c)).alias(c) for w, c in zip(world, "xyz")), (~F.coalesce("gone", F.lit(False))).alias("mask"))
    return out.filter("mask").drop("mask") if drop else out


def dilated(pixels: DataFrame, keys: Sequence[str], size: int, w: int, h: int) -> DataFrame:
    """Pixels within a square of `size` around a pixel, inside the image."""
    half = size // 2
    offsets = F.sequence(F.lit(-half), F.lit(size - 1 - half))
    p = pixels.withColumn("__du", F.explode(offsets)).withColumn("__dv", F.explode(offsets))
    p = p.select(*keys, (F.col("u") + F.col("__du")).alias("u"), (F.col("v") + F.col("__dv")).alias("v"))
    return p.filter(F.col("u").between(0, w - 1) & F.col("v").between(0, h - 1)).distinct()


def footprints(pixels: DataFrame, boxes: DataFrame, image: Sequence[str], w: int, h: int, x_scale: float = 1.0, y_scale: float = 1.4, keys: Sequence[str] = ("clip_id", "frame")) -> DataFrame:
    """(image, track_id, u0, v0, u1, v1): the rectangle of the pixels whose points (x, y, z) lie in a box, widened and held
    in the image."""
    held = points_in_boxes(pixels, boxes, keys)
    g = held.groupBy(*image, "track_id").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.min("v").alias("c"), F.max("v").alias("e"))
    du, dv = (F.col("b") - F.col("a") + 1) * (x_scale - 1) / 2, (F.col("e") - F.col("c") + 1) * (y_scale - 1) / 2
    held_in = lambda c, n: F.least(F.greatest(c, mat.d(0)), mat.d(n - 1))
    return g.select(*image, "track_id", *((f(held_in(c, n))).cast("int").alias(name) for f, c, n, name in ((F.floor, F.col("a") - du, w, "u0"), (F.floor, F.col("c") - dv, h, "v0"), (F.ceil, F.col("b") + du, w, "u1"), (F.ceil, F.col("e") + dv, h, "v1"))))


def removal_mask(pixels: DataFrame, rectangles: DataFrame, image: Sequence[str], combine: str = "any") -> DataFrame:
    """Adds `removed` to pixels(u, v): inside any rectangle of the image, or inside all of them."""
    if combine not in ("any", "all"):
        raise ValueError(f"unknown combination {combine!r}")
    r = rectangles.groupBy(*image).agg(F.collect_list(F.struct("u0", "v0", "u1", "v1")).alias("__r"))  # one for each object of an image
    hit = lambda x: (F.col("u") >= x["u0"]) & (F.col("u") <= x["u1"]) & (F.col("v") >= x["v0"]) & (F.col("v") <= x["v1"])
    removed = F.exists("__r", hit) if combine == "any" else F.forall("__r", hit)
    return pixels.join(r, list(image), "left").withColumn("removed", F.coalesce(removed, F.lit(False))).drop("__r")


def project_for_splat(points: DataFrame, cameras: DataFrame, keys: Sequence[str] = ("clip_id", "camera", "frame")) -> DataFrame:
    """(keys, pu, pv, depth) of world points in front of the camera. cameras: keys, m (camera to world), and fx, fy, cx, cy,
    or for f-theta also fw, max_angle, edge_r and edge_dr (fw null for pinhole; the linear part is left out)."""
    p = kept(points.join(cameras, list(keys)), "__c", F.array(*mat.inv_apply("m", [F.col(c) for c in "xyz"])))
    c = mat.vec("__c")
    pin = camera.pinhole_project(F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), c)
    if "fw" in cameras.columns:
        lin = F.array(mat.d(1), mat.d(0), mat.d(0))
        wide = camera.ftheta_project(F.col("fw"), lin, F.col("cx"), F.col("cy"), F.col("max_angle"), F.col("edge_r"), F.col("edge_dr"), c)
        pin = tuple(F.when(F.col("fw").isNull(), a).otherwise(b) for a, b in zip(pin, wide))
    p = kept(p.select(*keys, *(x for x in ("fx", "fy", "cx", "cy", *camera.FTHETA_MODEL) if x in p.columns), "__c"), "__p", F.when(c[2] > 0, F.struct(pin[0].alias("pu"), pin[1].alias("pv"), c[2].alias("depth"))))
    return p.select(*keys, "__p.*")


def kernel_offsets(kind: str, size: int) -> list[tuple[int, int]]:
    if kind == "nearest":
        return [(0, 0)]
    if kind == "bilinear":
        return [(a, b) for a in (0, 1) for b in (0, 1)]
    if kind == "gaussian":
        return [(a, b) for b in range(-(size // 2), size // 2 + 1) for a in range(-(size // 2), size // 2 + 1)]
    raise ValueError(f"unknown kernel {kind!r}")


def depth_splat(projected: DataFrame, keys: Sequence[str], w: int, h: int, kernel: str = "bilinear", size: int = 4, sigma: float = 1.0) -> DataFrame:
    """(keys, u, v, depth, weight): weighted mean depth of the points (pu, pv, depth) around each pixel.

    A point's weight is its kernel's share times 1 / exp(50 log1p(depth) / the image's largest log1p), so near points win.
    The kernel is a table of offsets; the points are summed before the shuffle."""
    top = projected.groupBy(*keys).agg((F.max(F.log1p(F.least("depth", mat.d(FAR)))) + 1e-7).alias("__top"))
    p = projected.join(top, list(keys))
    p = p.withColumn("__f", 1 / (F.exp(F.log1p(F.least("depth", mat.d(FAR))) / F.col("__top") * SATURATION) + 1e-7))
    base = F.bround if kernel == "nearest" else F.floor
    p = p.withColumn("__u", base("pu").cast("int")).withColumn("__v", base("pv").cast("int"))
    table = F.array(*(F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in kernel_offsets(kernel, size)))
    p = p.withColumn("__o", F.explode(table)).withColumn("u", F.col("__u") + F.col("__o.du")).withColumn("v", F.col("__v") + F.col("__o.dv"))
    p = p.filter(F.col("u").between(0, w - 1) & F.col("v").between(0, h - 1))
    share = {
        "nearest": lambda: mat.d(1),
        "bilinear": lambda: (1 - F.abs(F.col("pu") - F.col("u"))) * (1 - F.abs(F.col("pv") - F.col("v"))),
        "gaussian": lambda: F.exp(-0.5 * ((F.col("pu") - F.col("u") - 0.5) ** 2 + (F.col("pv") - F.col("v") - 0.5) ** 2) / sigma**2),
    }[kernel]()
    weight = share * F.col("__f")
    g = p.groupBy(*keys, "u", "v").agg(F.sum(F.col("depth") * weight).alias("__d"), F.sum(weight).alias("weight"))
    return g.filter("weight > 0").select(*keys, "u", "v", (F.col("__d") / F.col("weight")).alias("depth"), "weight")


def lidar_condition(points: DataFrame, sweeps: DataFrame, objects: DataFrame, frames: DataFrame, cameras: DataFrame, w: int, h: int, k: int = 2, step: int = 3, kernel: str = "gaussian", scale: float = MOVE_SCALE) -> DataFrame:
    """(clip_id, camera, frame, u, v, grey): depth images of LiDAR accumulated over a window of sweeps.

    Moving objects' points follow their boxes from the sweep's frame to the render frame (objects are given at every
    frame). Boxes are tested once on the sweeps, before these fan out over the window."""
    world = to_world(near_filtered(points), sweeps).withColumnRenamed("frame", "sweep")
    moving = objects.filter("is_moving").select("clip_id", F.col("frame").alias("sweep"), "track_id", "lwh", "m", "is_moving")
    held = points_in_boxes(world, moving, ("clip_id", "sweep"), scale).select("clip_id", "sweep", "point_id", "track_id", "bm")
    window = sweep_window(frames, sweeps, k, step)
    fanned = window.join(world, ["clip_id", "sweep"])
    at = objects.select("clip_id", "frame", "track_id", F.col("m").alias("tm"))
    hits = window.join(held, ["clip_id", "sweep"]).join(at, ["clip_id", "frame", "track_id"], "left")
    one = hits.groupBy("clip_id", "frame", "offset", "sweep", "point_id").agg(F.min_by(F.struct("bm", "tm"), "track_id").alias("move"), F.bool_or(F.col("tm").isNull()).alias("gone"))
    p = fanned.join(one, ["clip_id", "frame", "offset", "sweep", "point_id"], "left").filter("gone IS NULL OR NOT gone")
    local = F.when(F.col("move").isNotNull(), F.array(*mat.inv_apply(F.col("move.bm"), [F.col(c) for c in "xyz"])))
    p = p.withColumn("__l", F.explode(F.array(local)))  # computed once, null where a point does not move
    p = kept(p, "__at", F.array(*(F.coalesce(c, F.col(n)) for c, n in zip(mat.apply(F.col("move.tm"), mat.vec("__l")), "xyz"))))
    p = p.select("clip_id", "frame", *(F.col("__at")[i].alias(n) for i, n in enumerate("xyz")))
    keys = ["clip_id", "camera", "frame"]
    of = cameras.select("clip_id", "camera", "frame").distinct()
    seen = project_for_splat(p.join(of, ["clip_id", "frame"]), cameras, keys)
    seen = seen.filter(F.col("pu").between(-SIZE_MARGIN, w + SIZE_MARGIN) & F.col("pv").between(-SIZE_MARGIN, h + SIZE_MARGIN))
    return depth_splat(seen, keys, w, h, kernel).select(*keys, "u", "v", depth_grey(F.col("depth")).alias("grey"))
