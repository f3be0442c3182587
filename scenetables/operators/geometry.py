"""Vertices, edges and boxes: building, densifying, clipping, culling, and image coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.functions import mat

#: Signs of the half sizes (length, width, height) of a box's corners, upper face first.
CORNERS = ((1, 1, 1), (1, -1, 1), (-1, -1, 1), (-1, 1, 1), (1, 1, -1), (1, -1, -1), (-1, -1, -1), (-1, 1, -1))
#: The same for the vertices of a raw cuboid, lower face first.
CUBOID_CORNERS = ((-1, -1, -1), (-1, 1, -1), (1, 1, -1), (1, -1, -1), (-1, -1, 1), (-1, 1, 1), (1, 1, 1), (1, -1, 1))
#: Corner order of a box drawn as one line.
BOX_LINE = (0, 1, 2, 3, 0, 4, 5, 6, 7, 4, 5, 1, 2, 6, 7, 3)
BOX_OUTLINE = (0, 1, 2, 3, 0, 4, 5, 6, 7, 4, 5, 1)
#: Keys of an image, and its channels.
IMAGE, RGB = ("clip_id", "camera", "frame"), ("r", "g", "b")
DENSE_INTERVAL = 0.025
MAX_DEPTH = 122.5
BEV_PIXELS, BEV_METRES = 400, 60.0


def kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column, without the rows where it is null. A filter would be pushed below and take a copy of the value with it
    for each place that names it; a generator computes the value once."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def corners(lwh: Column | str, m: Column | str) -> Column:
    """The 8 corners of a box in the world."""
    half = [c / 2 for c in mat.vec(lwh)]
    return F.array(*(point(*mat.apply(m, [half[i] * s for i, s in enumerate(signs)])) for signs in CORNERS))


def gather(vertices: Column | str, order: Sequence[int]) -> Column:
    """Vertices in another order; an index that is not there gives null. Name a column that is there, as each vertex names it."""
    v = F.col(vertices) if isinstance(vertices, str) else vertices
    return F.array(*(F.get(v, F.lit(i)) for i in order))


def box_polyline(vertices: Column | str) -> Column:
    """8 corners as a line of 16 vertices that passes every edge."""
    return gather(vertices, BOX_LINE)


def box_outline(forward: Column, left: Column, up: Column, centre: Column, lwh: Column) -> Column:
    """Line of 12 vertices from direction vectors, a centre and a size (arrays of 3)."""
    f, s, u, c, n = (mat.vec(x) for x in (forward, left, up, centre, lwh))
    at = lambda a: point(*(c[i] + (f[i] * n[0] * a[0] + s[i] * n[1] * a[1] + u[i] * n[2] * a[2]) / 2 for i in range(3)))
    return gather(F.array(*(at(signs) for signs in CORNERS)), BOX_OUTLINE)


def cuboid_vertices(centre: Column, orientation: Column, dimensions: Column) -> Column:
    """8 vertices of a raw cuboid: structs x, y, z; the orientation's x is yaw, y pitch and z roll, intrinsic ZYX."""
    r = mat.euler_zyx(orientation["x"], orientation["y"], orientation["z"])
    half = [dimensions[a] / 2 for a in "xyz"]
    c = [centre[a] for a in "xyz"]
    rows = F.array(*r)
    made = lambda q: F.array(*(point(*(mat.dot([q[3 * i + j] for j in range(3)], [half[j] * s for j, s in enumerate(signs)]) + c[i] for i in range(3))) for signs in CUBOID_CORNERS))
    return F.transform(F.array(rows), made)[0]


def closed(vertices: Column | str) -> Column:
    """A ring: the first vertex again at the end; empty stays empty."""
    v = F.col(vertices) if isinstance(vertices, str) else vertices
    return F.concat(v, F.slice(v, 1, 1))


def segments(features: DataFrame, vertices: str = "vertices") -> DataFrame:
    """One row for each pair of consecutive vertices: seg_id, p0 and p1 instead of the vertices."""
    n = F.size(vertices)
    pairs = F.when(n > 1, F.arrays_zip(F.slice(vertices, 1, n - 1).alias("a"), F.slice(vertices, 2, n - 1).alias("b")))
    keep = [c for c in features.columns if c != vertices]
    return features.select(*keep, F.posexplode(pairs).alias("seg_id", "__s")).select(*keep, "seg_id", F.col("__s.a").alias("p0"), F.col("__s.b").alias("p1"))


def densified(features: DataFrame, interval: float = DENSE_INTERVAL, vertices: str = "vertices") -> DataFrame:
    """Points along polylines (ord, x, y, z): each edge gives max(int(length / interval), 2) evenly spaced points without its
    last, and the line's last vertex ends it. Single vertices are their own line."""
    keep = [c for c in features.columns if c != vertices]
    s = segments(features, vertices)
    length = mat.norm([F.col("p1")[a] - F.col("p0")[a] for a in "xyz"])
    s = s.withColumn("__n", F.greatest((length / interval).cast("int"), F.lit(2))).withColumn("__k", F.explode(F.expr("sequence(0, __n - 2)")))
    t = F.col("__k") / (F.col("__n") - 1)
    on = s.select(*keep, F.col("seg_id").alias("__seg"), "__k", *(mat.lerp(F.col("p0")[c], F.col("p1")[c], t).alias(c) for c in "xyz"))
    end = features.filter(F.size(vertices) > 0).select(*keep, F.size(vertices).alias("__seg"), F.lit(0).alias("__k"), *(F.element_at(vertices, -1)[c].alias(c) for c in "xyz"))
    return on.unionByName(end).select(*keep, F.struct("__seg", "__k").alias("ord"), *"xyz")


def near_plane_clipped(vertices: Column | str, eps: float = 0.05) -> Column:
    """A camera-space polyline cut where it goes behind the camera (z < 0).

    Of each edge the start stays if it is in front; an edge that crosses adds a point `eps` of its length past the plane,
    on the visible side; an edge wholly behind goes. The last vertex stays if it is in front."""
    v = F.col(vertices) if isinstance(vertices, str) else vertices
    n = F.size(v)

    def edge(i: Column) -> Column:
        a, b = F.get(v, i), F.get(v, i + 1)
        front_a, front_b = a["z"] >= 0, b["z"] >= 0
        s = F.try_divide(a["z"], a["z"] - b["z"])
        s = F.when(front_a, s - eps).otherwise(s + eps)
        cut = point(*(mat.lerp(a[c], b[c], s) for c in "xyz"))
        return F.when(front_a & front_b, F.array(a)).when(front_a, F.array(a, cut)).when(front_b, F.array(cut)).otherwise(F.slice(F.array(a), 1, 0))

    body = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), edge))
    last = F.filter(F.slice(v, -1, 1), lambda p: p["z"] >= 0)
    return F.when(n > 1, F.concat(body, last)).when(n == 1, last).otherwise(v)


def segment_near_clip(a: Sequence[Column], b: Sequence[Column], eps: float = 0.2) -> tuple[list[Column], list[Column]]:
    """Ends of a camera-space segment; one behind the camera moves to `eps` of the segment's length past the plane, on the
    visible side. Nulls if both are behind."""
    cut_b = a[2] > 0
    t = F.try_divide(a[2], a[2] - b[2])
    crosses = a[2] * b[2] < 0
    at = lambda s: [mat.lerp(x, y, s) for x, y in zip(a, b)]
    seen = (a[2] >= 0) | (b[2] >= 0)
    new_a, new_b = at(t + eps), at(t - eps)
    return [F.when(seen, F.when(crosses & ~cut_b, c).otherwise(x)) for x, c in zip(a, new_a)], [F.when(seen, F.when(crosses & cut_b, c).otherwise(x)) for x, c in zip(b, new_b)]


def clipped_to_image(u1: Column, v1: Column, u2: Column, v2: Column, w: Column, h: Column) -> Column:
    """Struct (u1, v1, u2, v2) of the part of a segment inside 0..w-1, 0..h-1 (Liang-Barsky), null if there is none."""
    du, dv = u2 - u1, v2 - v1
    low, high, ok = mat.d(0), mat.d(1), F.lit(True)
    for p, q in ((-du, u1), (du, w - 1 - u1), (-dv, v1), (dv, h - 1 - v1)):
        r = F.try_divide(q, p)
        ok = ok & ~((p == 0) & (q < 0))
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).otherwise(high)
    at = lambda s: (u1 + s * du, v1 + s * dv)
    a, b = at(low), at(high)
    return F.when(ok & (low <= high), F.struct(a[0].alias("u1"), a[1].alias("v1"), b[0].alias("u2"), b[1].alias("v2")))


def worth_drawing(px: str, w: Column, h: Column, least: int, hull: bool = False) -> Column:
    """Whether a primitive is worth drawing, from its projected vertices (array of u, v, z).

    A line needs a vertex in front and one inside the image, a hull one vertex that is both; the nearest vertex is within
    MAX_DEPTH, and there are at least `least` vertices."""
    front = lambda p: p["z"] > 0
    seen = lambda p: F.coalesce((F.bround(p["u"]) >= 0) & (F.bround(p["u"]) < w) & (F.bround(p["v"]) >= 0) & (F.bround(p["v"]) < h), F.lit(False))
    both = F.exists(px, lambda p: front(p) & seen(p)) if hull else F.exists(px, front) & F.exists(px, seen)
    return (F.size(px) >= least) & both & (F.array_min(F.transform(px, lambda p: p["z"])) <= MAX_DEPTH)


def visible(points: DataFrame, prim: Sequence[str], least: int, hull: bool = False) -> DataFrame:
    """Primitives worth drawing by worth_drawing(), from rows of projected vertices (prim keys, u, v, z, w, h)."""
    g = points.groupBy(*prim).agg(F.collect_list(F.struct("u", "v", "z")).alias("__px"), F.first("w").alias("__w"), F.first("h").alias("__h"))
    return g.filter(worth_drawing("__px", F.col("__w"), F.col("__h"), least, hull)).select(*prim)


def bev_pixel(ego: Column | str, p: Sequence[Column], pixels: int = BEV_PIXELS, metres: float = BEV_METRES) -> tuple[Column, Column]:
    """Bird's-eye pixel of a world point: the vehicle is at the centre, its x axis points up and its y axis left."""
    q = mat.inv_apply(ego, p)
    k = pixels / metres
    return pixels / 2 - q[1] * k, pixels / 2 - q[0] * k


def resized(u: Column, v: Column, w: Column, h: Column, new_w: int, new_h: int) -> tuple[Column, Column]:
    return u * new_w / w, v * new_h / h


def center_cropped(pixels: DataFrame, w: int, h: int, new_w: int, new_h: int) -> DataFrame:
    """Pixels of the middle part of an image, in its coordinates."""
    p = pixels.withColumn("u", F.col("u") - (w - new_w) // 2).withColumn("v", F.col("v") - (h - new_h) // 2)
    return p.filter(F.col("u").between(0, new_w - 1) & F.col("v").between(0, new_h - 1))


def depth_shade(depth: Column, channel: Column) -> Column:
    """Colour channel that fades with depth, cut to whole numbers; depth is held within 0 and MAX_DEPTH."""
    held = F.least(F.greatest(depth, mat.d(0)), mat.d(MAX_DEPTH))
    return (2 * (MAX_DEPTH - held) / 255 * channel).cast("int")


def depth_grey(depth: Column, far: float = 75.0) -> Column:
    return (F.least(F.greatest(depth, mat.d(0)), mat.d(far)) / far * 255).cast("int")
