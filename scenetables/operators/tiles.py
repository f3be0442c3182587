"""Visibility tiles: features meet only the viewers that may see them, by equi-joins.

A viewer stands in a cell of a square grid. The cells that a clip's viewers stand in are few, however many frames there are. A feature lies, by its centre, in one
tile of the level of its size; each cell names the tiles that its viewers reach, so features and cells meet by tile, and what they form meets the viewers by
cell. Reach is a bound: whoever sees a feature reaches its tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.functions import camera, mat
from scenetables.operators.geometry import MAX_DEPTH, kept

TILE = 64.0
#: Half the diagonal of a cell, as its share.
_HALF = 0.7072
#: Cameras that see beyond this angle see everything, as depths say little about distances there.
WIDEST = 1.4
_SLACK = 1e-5
_EVERYWHERE = -(1 << 62)


def with_place(features: DataFrame, vertices: str = "vertices") -> DataFrame:
    """features with __at: centre x, y, z of the box around their vertices, and its diagonal, size. Features without vertices, or whose box is not finite, are left out."""
    side = lambda f, a: f(F.transform(vertices, lambda p: p[a]))
    lows, highs = ([side(f, a) for a in "xyz"] for f in (F.array_min, F.array_max))
    box = F.when(F.size(vertices) > 0, F.struct(*((low + high) / 2 for low, high in zip(lows, highs)), mat.norm([high - low for low, high in zip(lows, highs)])))
    named = kept(features, "__at", box.cast("struct<x:double,y:double,z:double,size:double>"))
    return named.filter(F.col("__at.size") < float("inf"))


def _stretch(r: Sequence[Column]) -> Column:
    """How much longer a rotation part makes a vector, at most: nearly nothing where it is orthonormal."""
    columns = [r[0::3], r[1::3], r[2::3]]
    off = [F.abs(mat.dot(columns[i], columns[j]) - float(i == j)) for i in range(3) for j in range(i, 3)]
    return F.when(F.greatest(*off) <= 1e-6, mat.d(1 + _SLACK)).otherwise(mat.norm(r))


def camera_view(cameras: DataFrame, w: int, h: int) -> DataFrame:
    """cameras (m, __inv, and a model as in camera.project) with __view: place x, y; base and grow, whose sum base + grow * size is how far from the camera the
    centre of a feature of that size lies at most if it is worth drawing; tu and tv, the tangents of what the image holds; and shrink, how much
    longer a vector gets in camera space at most. base is null where no bound is known."""
    far = lambda c, n: F.greatest(F.abs(c + 0.5), F.abs(n - 0.5 - c))
    tu, tv = (F.try_divide(far(F.col(c), n), F.abs(F.col(f))) for c, n, f in (("cx", w, "fx"), ("cy", h, "fy")))
    if "fw" in cameras.columns:
        c, d, e = (F.col("lin")[i] for i in range(3))
        corners = [(mat.d(u) - F.col("cx"), mat.d(v) - F.col("cy")) for u in (-0.5, w - 0.5) for v in (-0.5, h - 0.5)]
        r = F.greatest(*(F.sqrt((x - d * y) ** 2 + (c * y - e * x) ** 2) for x, y in corners)) / F.abs(c - d * e)
        angle = F.col("max_angle") + F.when(F.col("edge_dr") > 0, F.greatest(r - F.col("edge_r"), mat.d(0)) / F.col("edge_dr"))
        wide = F.when(angle < WIDEST, F.tan(angle))
        tu, tv = (F.when(F.col("fw").isNull(), t).otherwise(wide) for t in (tu, tv))
    t = kept(cameras, "__t", F.struct(tu.alias("tu"), tv.alias("tv"), _stretch(mat.rot("m")).alias("out"), _stretch(mat.rot("__inv")).alias("shrink"), *(c.alias(a) for c, a in zip(mat.shift("m"), "xyz"))))
    t_ = lambda n: F.col(f"__t.{n}")
    slope = F.sqrt(1 + t_("tu") ** 2 + t_("tv") ** 2) * t_("out")
    base, grow = slope * MAX_DEPTH, slope * t_("shrink") + 0.5
    view = F.struct(t_("x").alias("x"), t_("y").alias("y"), base.alias("base"), grow.alias("grow"), t_("tu").alias("tu"), t_("tv").alias("tv"), t_("shrink").alias("shrink"))
    return t.withColumn("__view", view).drop("__t")


def in_view(joined: DataFrame) -> DataFrame:
    """Rows of features (__at) and cameras (__inv, __view) whose bounding sphere may be worth drawing: it reaches in front of the camera, within MAX_DEPTH, and into
    the cone of the image, or its mirror image behind the camera. One place is transformed for this, not the vertices."""
    j = kept(joined, "__q", F.array(*mat.apply("__inv", [F.col(f"__at.{a}") for a in "xyz"])))
    x, y, z = mat.vec("__q")
    radius = F.col("__at.size") / 2 * F.col("__view.shrink") + _SLACK
    side = lambda c, t: F.coalesce(F.abs(c) - radius <= F.col(f"__view.{t}") * (F.abs(z) + radius), F.lit(True))
    near = F.coalesce((z + radius > 0) & (z - radius <= MAX_DEPTH), F.lit(True))
    return j.filter(near & side(x, "tu") & side(y, "tv")).drop("__q")


def meeting(features: DataFrame, viewers: DataFrame, on: Sequence[str] = ("clip_id",), tile: float = TILE) -> DataFrame:
    """Every row of features (on, __at: struct of x, y, size) with every viewer (on, __view: struct of x, y, base, grow) of equal `on` that lies within base + grow * size
    of it; a viewer whose base is null meets all features. A few rows more, within a cell's diagonal, may meet."""
    on = list(on)
    cell = [F.when(F.col("__view.base").isNull(), F.lit(_EVERYWHERE)).otherwise(F.floor(F.col(f"__view.{a}") / tile)).cast("long").alias(f"__c{a}") for a in "xy"]
    v = viewers.select("*", *cell)
    cells = v.groupBy(*on, "__cx", "__cy").agg(F.max("__view.base").alias("__base"), F.max("__view.grow").alias("__grow"))
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("__at.size"), mat.d(tile)) / tile)), F.lit(0)).cast("int")
    side = F.pow(mat.d(2), F.col("__level")) * tile
    f = features.withColumn("__level", level)
    f = f.withColumns({f"__t{a}": F.floor(F.col(f"__at.{a}") / side) for a in "xy"})
    middle = lambda a: (F.col(f"__c{a}") + 0.5) * tile
    reach = lambda size: F.col("__base") + F.col("__grow") * size + tile * _HALF
    c = cells.filter("__base IS NOT NULL").join(f.select(*on, "__level").distinct(), on)
    for a in "xy":
        c = c.withColumn(f"__t{a}", F.explode(F.sequence(F.floor((middle(a) - reach(side)) / side), F.floor((middle(a) + reach(side)) / side))))
    near = f.join(c, [*on, "__level", "__tx", "__ty"])
    near = near.filter(mat.norm([F.col(f"__at.{a}") - middle(a) for a in "xy"]) <= reach(F.col("__at.size")))
    columns = [*features.columns, "__cx", "__cy"]
    met = near.select(*columns).unionByName(features.join(cells.filter("__base IS NULL"), on).select(*columns))
    return met.join(v, [*on, "__cx", "__cy"]).drop("__cx", "__cy")
