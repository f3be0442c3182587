"""Sparse rasters: rows of (image keys, u, v, r, g, b) with black left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators import dense, geometry, objects as obj, tiles
from scenetables.operators.geometry import IMAGE, RGB

MAP_WIDTH, BOX_WIDTH = 8, 5
#: Layer, geometry and colour.
LAYERS = (
    ("lanelines", "polyline", 98, 183, 249),
    ("lanes", "polyline", 56, 103, 221),
    ("poles", "polyline", 66, 40, 144),
    ("road_boundaries", "polyline", 200, 36, 35),
    ("wait_lines", "polyline", 185, 63, 34),
    ("crosswalks", "polygon", 206, 131, 63),
    ("road_markings", "polygon", 126, 204, 205),
    ("traffic_signs", "cuboid3d", 131, 175, 155),
    ("traffic_lights", "cuboid3d", 252, 157, 155),
)
#: Colours of the object classes.
CLASS_COLOURS = {
    "Car": (255, 0, 0),
    "Truck": (0, 0, 255),
    "Pedestrian": (0, 255, 0),
    "Cyclist": (255, 255, 0),
    "Others": (255, 255, 255),
}
#: Of bird's-eye images: colour of the ego's segment, and radii of the discs at the ego and along its path.
EGO, CENTRE, DOT = (255, 0, 0), 3, 1
DENSE_LAYERS, DENSE_STEP = ("lanelines", "road_boundaries"), 0.8


def z_buffer(points: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The colour of the nearest point of each pixel. points: keys, id, u, v (not rounded), z, w, h, r, g, b; those behind the
    camera or outside the image, or without a place, are left out, and the smaller id wins at equal depths."""
    p = points.filter("z > 0 AND abs(u) < 1e9 AND abs(v) < 1e9").withColumn("u", F.bround("u").cast("int")).withColumn("v", F.bround("v").cast("int"))
    p = p.filter(camera.inside(F.col("u"), F.col("v"), F.col("w"), F.col("h")))
    return p.groupBy(*keys, "u", "v").agg(F.min_by(F.struct(*RGB), F.struct("z", "id")).alias("c")).select(*keys, "u", "v", "c.*")


def thickened(pixels: DataFrame, radius: int, w: int, h: int, disc: bool = False, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels spread over shifts from -(radius // 2) to radius // 2, the largest of each channel winning; disc: over the shifts
    within the radius. Nothing wraps at the border."""
    half = radius if disc else radius // 2
    shifts = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if not disc or a * a + b * b <= radius * radius]
    p = pixels.withColumn("__s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in shifts))))
    p = p.withColumn("u", F.col("u") + F.col("__s.a")).withColumn("v", F.col("v") + F.col("__s.b")).filter(F.col("u").between(0, w - 1) & F.col("v").between(0, h - 1))
    return merged([p.select(*keys, "u", "v", *RGB)], keys)


def merged(layers: Sequence[DataFrame], keys: Sequence[str] = IMAGE) -> DataFrame:
    """Layers over each other: the largest value of each channel."""
    every = layers[0]
    for x in layers[1:]:
        every = every.unionByName(x)
    return every.groupBy(*keys, "u", "v").agg(*(F.max(c).alias(c) for c in RGB))


def overlay(image: DataFrame, condition: DataFrame, keys: Sequence[str] = IMAGE, weight: float = 0.8) -> DataFrame:
    """image plus weight times condition, held at 255 and cut to whole numbers; a pixel without condition stays."""
    c = condition.select(*keys, "u", "v", *(F.col(x).alias(f"__{x}") for x in RGB))
    both = image.join(c, [*keys, "u", "v"], "left")
    return both.select(*keys, "u", "v", *(F.least(F.col(x) + weight * F.coalesce(f"__{x}", F.lit(0)), F.lit(255)).cast("int").alias(x) for x in RGB))


def line_raster(segments: DataFrame, w: int, h: int, width: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels within width / 2 of a segment. segments: keys, prim_id, seg_id, u1, v1, u2, v2, r, g, b; the later primitive
    wins. A segment is cut to the image first, so its pixels are bounded by the image."""
    s = geometry.kept(segments, "c", geometry.clipped_to_image(*(F.col(x).cast("double") for x in ("u1", "v1", "u2", "v2")), F.lit(w), F.lit(h)))
    s = s.select(*keys, "prim_id", "seg_id", *RGB, "c.*")
    pad = width / 2
    low = lambda a, b, n: F.greatest(F.floor(F.least(a, b) - pad), F.lit(0)).cast("int")
    high = lambda a, b, n: F.least(F.ceil(F.greatest(a, b) + pad), F.lit(n - 1)).cast("int")
    s = s.withColumn("v", F.explode(F.sequence(low("v1", "v2", h), high("v1", "v2", h))))
    # of a long slanted line only the columns near it in this row
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    n2 = du * du + dv * dv
    reach = pad * F.sqrt(n2) / F.greatest(F.abs(dv), mat.d(1e-9))
    mid = F.col("u1") + F.try_divide(du * (F.col("v") - F.col("v1")), dv)
    from_u = F.when(F.abs(dv) > 1e-6, F.greatest(low("u1", "u2", w), F.floor(mid - reach).cast("int"))).otherwise(low("u1", "u2", w))
    to_u = F.when(F.abs(dv) > 1e-6, F.least(high("u1", "u2", w), F.ceil(mid + reach).cast("int"))).otherwise(high("u1", "u2", w))
    s = s.withColumn("__a", from_u).withColumn("__b", to_u).filter("__a <= __b").withColumn("u", F.explode(F.expr("sequence(__a, __b)")))
    t = F.least(F.greatest(F.coalesce(F.try_divide((F.col("u") - F.col("u1")) * du + (F.col("v") - F.col("v1")) * dv, n2), mat.d(0)), mat.d(0)), mat.d(1))
    d2 = (F.col("u") - F.col("u1") - t * du) ** 2 + (F.col("v") - F.col("v1") - t * dv) ** 2
    s = s.filter(d2 <= pad * pad)
    return s.groupBy(*keys, "u", "v").agg(F.max_by(F.struct(*RGB), F.struct("prim_id", "seg_id")).alias("c")).select(*keys, "u", "v", "c.*")


def hull_ring(ring: Column | str) -> Column:
    """Convex hull of vertices (structs u, v), counter-clockwise from the leftmost one: from each vertex of the hull goes on the one that has all others on its
    left, the farthest of those in line. Fewer than three vertices come back where there is no area."""
    kind = "struct<u:double,v:double>"
    ps = F.array_distinct(F.filter(F.col(ring) if isinstance(ring, str) else ring, lambda p: p["u"].isNotNull() & p["v"].isNotNull())).cast(f"array<{kind}>")

    def wrapped(ps: Column) -> Column:
        start = F.array_min(ps)

        def after(p: Column) -> Column:
            def better(b: Column, r: Column) -> Column:
                side = (b["u"] - p["u"]) * (r["v"] - p["v"]) - (b["v"] - p["v"]) * (r["u"] - p["u"])
                away = lambda x: (x["u"] - p["u"]) ** 2 + (x["v"] - p["v"]) ** 2
                return F.when((away(b) == 0) | (side < 0) | ((side == 0) & (away(r) > away(b))), r).otherwise(b)

            return F.aggregate(ps, p, better)

        step = lambda acc: F.transform(F.array(after(acc["p"])), lambda q: F.struct(q.alias("p"), F.when(q == start, acc["ring"]).otherwise(F.concat(acc["ring"], F.array(q))).alias("ring"), (q == start).alias("done")))[0]
        first = F.struct(start.alias("p"), F.array(start).alias("ring"), F.lit(False).alias("done"))
        state = f"struct<p:{kind},ring:array<{kind}>,done:boolean>"
        return F.aggregate(F.sequence(F.lit(1), F.size(ps)), first.cast(state), lambda acc, _: F.when(acc["done"], acc).otherwise(step(acc)).cast(state))["ring"]

    return F.transform(F.array(ps), lambda ps: F.when(F.size(ps) > 2, wrapped(ps)).otherwise(ps))[0]


def hull_raster(polygons: DataFrame, w: int, h: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels inside convex rings. polygons: keys, prim_id, ring (hull_ring), r, g, b; the later primitive wins. Rows of the image
    are filled between the leftmost and rightmost crossing of the ring."""
    p = polygons.filter(F.size("ring") >= 3)
    vs = F.transform("ring", lambda q: q["v"])
    low, high = F.greatest(F.ceil(F.array_min(vs)), F.lit(0)).cast("int"), F.least(F.floor(F.array_max(vs)), F.lit(h - 1)).cast("int")
    p = p.withColumn("__lo", low).withColumn("__hi", high).filter("__lo <= __hi").withColumn("v", F.explode(F.expr("sequence(__lo, __hi)")))

    def crossing(i: Column) -> Column:
        a, b = F.get("ring", i), F.get("ring", (i + 1) % F.size("ring"))
        t = F.try_divide(F.col("v") - a["v"], b["v"] - a["v"])
        flat = F.when(a["v"] == F.col("v"), F.array(a["u"], b["u"])).otherwise(F.array().cast("array<double>"))
        return F.when(a["v"] == b["v"], flat).when((t >= 0) & (t <= 1), F.array(mat.lerp(a["u"], b["u"], t))).otherwise(F.array().cast("array<double>"))

    p = p.withColumn("__x", F.flatten(F.transform(F.sequence(F.lit(0), F.size("ring") - 1), crossing))).filter("size(__x) > 0")
    p = p.withColumn("__a", F.greatest(F.ceil(F.array_min("__x") - 1e-9), F.lit(0)).cast("int")).withColumn("__b", F.least(F.floor(F.array_max("__x") + 1e-9), F.lit(w - 1)).cast("int"))
    p = p.filter("__a <= __b").withColumn("u", F.explode(F.expr("sequence(__a, __b)")))
    return p.groupBy(*keys, "u", "v").agg(F.max_by(F.struct(*RGB), "prim_id").alias("c")).select(*keys, "u", "v", "c.*")


def prepared(cameras: DataFrame, w: int, h: int) -> DataFrame:
    """cameras with what drawing needs of them, once for all that is drawn: inverse poses and views."""
    return cameras if "__view" in cameras.columns else tiles.camera_view(geometry.kept(cameras, "__inv", mat.affine_inv("m")), w, h)


def _in_camera(features: DataFrame, cameras: DataFrame, w: int, h: int, keys: Sequence[str]) -> DataFrame:
    """features (clip_id, [frame,] prim_id, colour, vertices) that each camera may see: vertices in camera space. cameras: keys, m, and a
    model as in camera.project. Features of a clip meet cameras by visibility tiles, those of a frame by their frame."""
    on = [k for k in keys if k in features.columns and k in cameras.columns]
    cams = prepared(cameras, w, h)
    f = tiles.with_place(features)
    met = f.join(cams, on) if "frame" in on else tiles.meeting(f, cams, on)
    seen = tiles.in_view(met).drop("__at", "__view")
    return geometry.kept(seen, "vertices", mat.apply_vertices("__inv", F.col("vertices")))


def _at(p: Column, model: list[str]) -> Column:
    """u, v and z of a vertex in camera space."""
    u, v = camera.project(model, p)
    return F.struct(u.alias("u"), v.alias("v"), p["z"].alias("z"))


def draw_lines(features: DataFrame, cameras: DataFrame, w: int, h: int, width: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Polylines (clip_id, prim_id, vertices, r, g, b) drawn with depth shading, by cameras of either model; the culls of geometry.worth_drawing
    go by the whole line. Under distortion a line is drawn between its vertices: densify it first where that matters. Images are filled by kernels, as they are many and
hold a bounded number of lines each."""
    f = _in_camera(features, cameras, w, h, keys)
    model = camera.model_columns(cameras)
    f = geometry.kept(f, "__px", F.transform("vertices", lambda p: _at(p, model)))
    s = geometry.segments(f.filter(geometry.worth_drawing("__px", F.lit(w), F.lit(h), 2)).select(*keys, "prim_id", *RGB, *model, "vertices"))
    a, b = geometry.segment_near_clip([F.col("p0")[c] for c in "xyz"], [F.col("p1")[c] for c in "xyz"])
    depth = (F.col("p0.z") + F.col("p1.z")) / 2
    s = geometry.kept(s, "__e", F.when((a[2] > 0) & (b[2] > 0), F.struct(geometry.point(*a).alias("a"), geometry.point(*b).alias("b"))))
    (u1, v1), (u2, v2) = (camera.project(model, F.col(e)) for e in ("__e.a", "__e.b"))
    s = s.select(*keys, "prim_id", "seg_id", u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"), *(geometry.depth_shade(depth, F.col(c)).alias(c) for c in RGB))
    return dense.line_raster(s, w, h, width, keys)


def draw_hulls(features: DataFrame, cameras: DataFrame, w: int, h: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Convex areas (clip_id, prim_id, vertices, r, g, b) filled with the shade of their mean depth, by cameras of either model."""
    f = _in_camera(features, cameras, w, h, keys)
    model = camera.model_columns(cameras)
    f = geometry.kept(f, "__px", F.transform("vertices", lambda p: _at(p, model)))
    f = f.filter(geometry.worth_drawing("__px", F.lit(w), F.lit(h), 3, hull=True))
    f = geometry.kept(f, "vertices", F.filter(geometry.near_plane_clipped("vertices"), lambda p: p["z"] > 1e-6))
    px = F.transform("vertices", lambda p: F.struct(*(F.when(F.abs(c) < 1e7, c).cast("int").cast("double").alias(n) for c, n in zip(camera.project(model, p), "uv"))))
    z = F.transform("vertices", lambda p: p["z"])
    f = geometry.kept(f, "__h", F.when(F.size("vertices") >= 3, F.struct(px.alias("px"), z.alias("z"))))
    f = f.withColumn("__mean", F.aggregate("__h.z", mat.d(0), lambda acc, x: acc + x) / F.size("__h.z"))
    f = f.select(*keys, "prim_id", F.filter("__h.px", lambda p: p["u"].isNotNull() & p["v"].isNotNull()).alias("px"), *(geometry.depth_shade(F.col("__mean"), F.col(c)).alias(c) for c in RGB))
    return dense.hull_raster(geometry.kept(f, "ring", hull_ring("px")), w, h, keys)


def layer_table(spark) -> DataFrame:
    """layer, geom_type, r, g, b."""
    rows = F.array(*(F.struct(F.lit(n).alias("layer"), F.lit(t).alias("geom_type"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for n, t, r, g, b in LAYERS))
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def with_layers(features: DataFrame) -> DataFrame:
    """Map features with their layer's geometry and colour; an unknown layer is an error."""
    f = features.drop("geom_type").join(F.broadcast(layer_table(features.sparkSession)), "layer", "left")
    known = F.when(F.col("geom_type").isNotNull(), F.col("geom_type")).otherwise(F.raise_error(F.concat(F.lit("unknown layer "), F.col("layer"))).cast("string"))
    return f.withColumn("geom_type", known)


def _cameras(cameras: DataFrame, w: int, h: int) -> DataFrame:
    return prepared(cameras, w, h).select(*IMAGE, "__inv", "__view", *camera.model_columns(cameras))


def _map_layers(features: DataFrame, cameras: DataFrame, w: int, h: int) -> list[DataFrame]:
    """What draw_map() merges."""
    f = with_layers(features).withColumn("prim_id", F.col("feature_id"))
    lines = f.filter("geom_type = 'polyline'")
    fine = lines.filter(F.col("layer").isin(*DENSE_LAYERS))
    points = geometry.densified(fine.select("clip_id", "layer", "prim_id", *RGB, "vertices"), DENSE_STEP)
    fine = points.groupBy("clip_id", "layer", "prim_id", *RGB).agg(F.sort_array(F.collect_list(F.struct("ord", *"xyz"))).alias("p"))
    fine = fine.withColumn("vertices", F.transform("p", lambda p: geometry.point(p["x"], p["y"], p["z"]))).drop("p")
    cols = ["clip_id", "layer", "prim_id", *RGB, "vertices"]
    lines = lines.filter(~F.col("layer").isin(*DENSE_LAYERS)).select(*cols).unionByName(fine.select(*cols))
    keys = [*IMAGE, "layer"]
    cams = _cameras(cameras, w, h)
    drawn = [draw_lines(lines, cams, w, h, MAP_WIDTH, keys), draw_hulls(f.filter("geom_type <> 'polyline'").select(*cols), cams, w, h, keys)]
    return [d.drop("layer") for d in drawn]


def draw_map(features: DataFrame, cameras: DataFrame, w: int, h: int) -> DataFrame:
    """All layers of map_features (clip_id, layer, feature_id, vertices) in each camera image: areas and cuboids as hulls, the
    others as lines, two layers of them densified; the layers are merged by channel."""
    return merged(_map_layers(features, cameras, w, h))


def _box_layers(objects: DataFrame, cameras: DataFrame, w: int, h: int) -> DataFrame:
    """What draw_boxes() merges."""
    o = objects.withColumn("cls", obj.drawn_class(F.col("object_type"))).withColumn("__c", geometry.corners("lwh", "m")).withColumn("vertices", geometry.box_polyline("__c"))
    for i, c in enumerate(RGB):
        pick = F
        for name, rgb in CLASS_COLOURS.items():
            pick = pick.when(F.col("cls") == name, F.lit(rgb[i]))
        o = o.withColumn(c, pick)
    o = o.select("clip_id", "frame", F.col("track_id").alias("prim_id"), "cls", *RGB, "vertices")
    cams = _cameras(cameras, w, h)
    return draw_lines(o, cams, w, h, BOX_WIDTH, [*IMAGE, "cls"]).drop("cls")


def draw_boxes(objects: DataFrame, cameras: DataFrame, w: int, h: int) -> DataFrame:
    """Boxes of objects (clip_id, frame, track_id, object_type, lwh, m) as lines in their class's colour; of a class the later
    track in string order is on top, and the classes are merged by channel."""
    return merged([_box_layers(objects, cameras, w, h)])


def hdmap_condition(features: DataFrame, objects: DataFrame, cameras: DataFrame, w: int, h: int) -> DataFrame:
    """The map and the boxes of each camera image, merged once. cameras: clip_id, camera, frame, m and a model as in camera.project, pinhole and f-theta mixed
    if wanted (camera.camera_models)."""
    cams = prepared(cameras, w, h)
    return merged([*_map_layers(features, cams, w, h), _box_layers(objects, cams, w, h)])


def _around(rows: DataFrame, ends: list[Column], egos: DataFrame, metres: float) -> DataFrame:
    """rows (clip_id, [frame,] ...) with the egos around which one of their ends may lie within a square of `metres`, once for each such ego. Rows
    of a clip meet egos by visibility tiles, those of a frame by their frame."""
    if "frame" in rows.columns:
        return rows.join(egos, ["clip_id", "frame"])
    r = mat.rot("m")
    flat = F.abs(r[2]) + F.abs(r[5]) <= 1e-9  # else height moves a place on the ground
    reach = F.when(flat, mat.norm([F.abs(r[i]) + F.abs(r[i + 1]) for i in (0, 3)]) * metres / 2 + 1e-6)
    view = F.struct(*(c.alias(a) for c, a in zip(mat.shift("m"), "xy")), reach.alias("base"), mat.d(0).alias("grow"))
    e = rows.select("*", F.posexplode(F.array(*(F.struct(*(p[a].alias(a) for a in "xyz"), mat.d(0).alias("size")) for p in ends))).alias("__end", "__at"))
    met = tiles.meeting(e, egos.withColumn("__view", view), ["clip_id"], metres / 2)
    if len(ends) > 1:  # the second end speaks where the first one is not there
        there = lambda p: F.coalesce(mat.norm([p[a] - F.col(f"__view.{a}") for a in "xy"]) <= F.col("__view.base"), F.lit(True))
        met = met.filter(F.when(F.col("__end") == 0, there(ends[0])).otherwise(there(ends[1]) & ~there(ends[0])))
    return met.drop("__end", "__at", "__view")


def bev_map(segments: DataFrame, egos: DataFrame, pixels: int = geometry.BEV_PIXELS, metres: float = geometry.BEV_METRES, width: int = 2, path: DataFrame | None = None) -> DataFrame:
    """Bird's-eye images (clip_id, frame, u, v, r, g, b) of world segments (clip_id, [frame,] prim_id, seg_id, p0, p1, colour) around
    each ego pose; a segment with neither end inside is left out. A segment of 2 m along the ego's axis is added in EGO's colour. The ground of these
    images is white, so black pixels are rows too: with a path (clip_id, x, y, z), a disc of CENTRE pixels at the ego and one of DOT pixels at each place of
    the clip's path lie over the lines."""
    s = _around(segments, [F.col("p0"), F.col("p1")], egos, metres).select("clip_id", "frame", "prim_id", "seg_id", "p0", "p1", *RGB, "m")
    x, t = [mat.rot("m")[i] for i in (0, 3, 6)], mat.shift("m")
    end = lambda k: geometry.point(*(b + k * a for a, b in zip(x, t)))
    me = egos.select("clip_id", "frame", F.lit("~ego").alias("prim_id"), F.lit(0).alias("seg_id"), end(-1).alias("p0"), end(1).alias("p1"), *(F.lit(x).alias(c) for x, c in zip(EGO, RGB)), "m")
    s = s.withColumn("prim_id", F.col("prim_id").cast("string")).unionByName(me)
    (u1, v1), (u2, v2) = (geometry.bev_pixel("m", [F.col(e)[c] for c in "xyz"], pixels, metres) for e in ("p0", "p1"))
    s = s.select("clip_id", "frame", "prim_id", "seg_id", *RGB, u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"))
    n = F.lit(pixels)
    s = s.filter(camera.inside(F.col("u1"), F.col("v1"), n, n) | camera.inside(F.col("u2"), F.col("v2"), n, n))
    keys = ["clip_id", "frame"]
    s = s.withColumn("pad", mat.d(width / 2))
    if path is not None:
        u, v = geometry.bev_pixel("m", [F.col(c) for c in "xyz"], pixels, metres)
        dots = _around(path, [F.struct(*"xyz")], egos, metres).select(*keys, u.cast("int").alias("u"), v.cast("int").alias("v"), F.lit(DOT).alias("radius"))
        dots = dots.filter((u >= 0) & (v >= 0)).unionByName(egos.select(*keys, *(F.lit(pixels // 2).alias(c) for c in "uv"), F.lit(CENTRE).alias("radius")))
        # a disc is a segment without length; names of dots come after all names of lines, whose order stays
        dots = dots.filter(camera.inside(F.col("u"), F.col("v"), n, n)).select(
            *keys, F.lit("1").alias("prim_id"), F.lit(0).alias("seg_id"), *(F.lit(0).alias(c) for c in RGB), *(F.col(a).cast("double").alias(f"{a}{k}") for k in "12" for a in "uv"), F.col("radius").cast("double").alias("pad")
        )
        s = s.withColumn("prim_id", F.coalesce(F.concat(F.lit("0"), "prim_id"), F.lit(""))).unionByName(dots)
    return dense.line_raster(s, pixels, pixels, width, keys)


def object_segments(objects: DataFrame) -> DataFrame:
    """(clip_id, frame, prim_id, seg_id, p0, p1) of the box lines of objects; a frame without objects has no rows."""
    o = objects.withColumn("__c", geometry.corners("lwh", "m"))
    o = o.select("clip_id", "frame", F.col("track_id").alias("prim_id"), geometry.box_polyline("__c").alias("vertices"))
    return geometry.segments(o)


def video_grid(pixels: DataFrame, views: DataFrame, w: int, h: int, columns: int, padding: int = 2) -> DataFrame:
    """Views (view, ord) side by side, `columns` in a row; a last row that is not full is centred. pixels: clip_id, frame, view."""
    v = views.withColumn("__row", F.floor(F.col("ord") / columns)).withColumn("__col", F.col("ord") % columns)
    rows = v.groupBy("__row").agg(F.count("*").alias("__n"))
    v = v.join(rows, "__row").withColumn("__left", ((columns - F.col("__n")) * (w + padding) / 2).cast("int"))
    p = pixels.join(F.broadcast(v), "view")
    u = F.col("u") + F.col("__col") * (w + padding) + F.col("__left")
    return p.select("clip_id", "frame", u.cast("int").alias("u"), (F.col("v") + F.col("__row") * (h + padding)).cast("int").alias("v"), *RGB)
