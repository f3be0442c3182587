"""Pinhole and f-theta cameras as Spark columns.

Polynomials are arrays of doubles, lowest order first. The linear part of an f-theta camera is A = [[c, d], [e, 1]].
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetables.functions.mat import Vec, d, norm

DOMAIN_STEPS, DOMAIN_BLOCK = 2000, 40
FIT_SAMPLES = 500
SUPPORTED_DEGREES = (4, 5)


def horner(poly: Column, x: Column) -> Column:
    return F.aggregate(F.reverse(poly), d(0), lambda acc, c: acc * x + c)


def derivative(poly: Column) -> Column:
    """Coefficients of the derivative."""
    return F.slice(F.transform(poly, lambda c, i: c * i), 2, F.greatest(F.size(poly) - 1, F.lit(0)))


# Pinhole -----------------------------------------------------------------------------------------------------


def pinhole_project(fx: Column, fy: Column, cx: Column, cy: Column, p: Vec) -> tuple[Column, Column]:
    """Pixel of a camera point; null in the camera's own plane. Points behind the camera project too: mask them by z."""
    return F.try_divide(fx * p[0], p[2]) + cx, F.try_divide(fy * p[1], p[2]) + cy


def pinhole_unproject(fx: Column, fy: Column, cx: Column, cy: Column, u: Column, v: Column) -> list[Column]:
    """Ray through a pixel, at z = 1."""
    return [(u - cx) / fx, (v - cy) / fy, d(1)]


def pinhole_rescale(fx: Column, fy: Column, cx: Column, cy: Column, w: Column, h: Column, rx: Column, ry: Column) -> list[Column]:
    """Intrinsics of the image resized by rx and ry; sizes are cut to whole pixels."""
    return [fx * rx, fy * ry, cx * rx, cy * ry, (w * rx).cast("int"), (h * ry).cast("int")]


def pinhole_fov(fx: Column, fy: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return 2 * F.atan(w / (2 * fx)), 2 * F.atan(h / (2 * fy))


def pinhole_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return F.array(fx, d(0), cx, d(0), fy, cy, d(0), d(0), d(1))


def pinhole_inverse_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return F.array(1 / fx, d(0), -cx / fx, d(0), 1 / fy, -cy / fy, d(0), d(0), d(1))


def uv(u: Column, v: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Normalised pixel."""
    return u / w, v / h


def inside(u: Column, v: Column, w: Column, h: Column) -> Column:
    return (u >= 0) & (u < w) & (v >= 0) & (v < h)


#: Columns of the models; an f-theta camera has a null fx, a pinhole one a null fw.
PINHOLE_MODEL, FTHETA_MODEL = ("fx", "fy", "cx", "cy"), ("fw", "lin", "max_angle", "edge_r", "edge_dr")


def model_columns(cameras: DataFrame) -> list[str]:
    """The columns of cameras that project() needs: those of pinhole, and those of f-theta where cameras have them."""
    return [*PINHOLE_MODEL, *(FTHETA_MODEL if "fw" in cameras.columns else ())]


def project(model: list[str], p: Column) -> tuple[Column, Column]:
    """Pixel of a camera-space struct x, y, z by the row's model: fx, fy, cx, cy, or where fw is not null the f-theta columns."""
    xyz = [p[c] for c in "xyz"]
    pin = pinhole_project(*(F.col(c) for c in PINHOLE_MODEL), xyz)
    if "fw" not in model:
        return pin
    wide = ftheta_project(F.col("fw"), F.col("lin"), F.col("cx"), F.col("cy"), F.col("max_angle"), F.col("edge_r"), F.col("edge_dr"), xyz)
    return tuple(F.when(F.col("fw").isNull(), a).otherwise(b) for a, b in zip(pin, wide))


def camera_models(pinhole: DataFrame, ftheta: DataFrame) -> DataFrame:
    """(clip_id, camera, w, h and the columns of project()) of pinhole cameras and calibrated f-theta cameras together."""
    names = ["clip_id", "camera", "w", "h", *PINHOLE_MODEL, *FTHETA_MODEL]
    of = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names))
    a, b = of(pinhole), of(ftheta)
    kinds = {c: next(t for d in (pinhole, ftheta) for n, t in d.dtypes if n == c) for c in names}
    return a.select(*(F.col(c).cast(kinds[c]) for c in names)).unionByName(b.select(*(F.col(c).cast(kinds[c]) for c in names)))


# f-theta -----------------------------------------------------------------------------------------------------


def ftheta_project(fw: Column, lin: Column, cx: Column, cy: Column, max_angle: Column, edge_r: Column, edge_dr: Column, p: Vec) -> tuple[Column, Column]:
    """Pixel of a camera ray. Beyond max_angle the radius goes on in a straight line; a ray on the axis meets the centre."""
    flat = norm(p[:2])
    angle = F.acos(F.least(F.greatest(F.try_divide(p[2], norm(p)), d(-1)), d(1)))
    r = F.when(angle <= max_angle, horner(fw, angle)).otherwise(edge_r + (angle - max_angle) * edge_dr)
    k = F.when(flat > 0, F.try_divide(r, flat)).otherwise(d(0))
    x, y = k * p[0], k * p[1]
    return lin[0] * x + lin[1] * y + cx, lin[2] * x + y + cy


def ftheta_unproject(bw: Column, lin: Column, cx: Column, cy: Column, u: Column, v: Column) -> tuple[list[Column], Column]:
    """Unit ray through a pixel, and whether its direction is defined (false at the centre, where it is 0, 0, 1)."""
    det = lin[0] - lin[1] * lin[2]
    x, y = u - cx, v - cy
    x, y = (x - lin[1] * y) / det, (lin[0] * y - lin[2] * x) / det
    r = F.sqrt(x * x + y * y)
    angle = horner(bw, r)
    valid = r > 0
    k = F.when(valid, F.sin(angle) / F.greatest(r, d(1e-300))).otherwise(d(0))
    return [k * x, k * y, F.when(valid, F.cos(angle)).otherwise(d(1))], valid


def ftheta_rescale(poly: Column, is_bw: Column, cx: Column, cy: Column, w: Column, h: Column, rx: Column, ry: Column) -> list[Column]:
    """poly, cx, cy, w, h of the resized image. The ratios must agree to 0.02, for a radius has but one scale."""
    ok = F.abs(rx - ry) < 0.02
    scaled = F.when(is_bw, F.transform(poly, lambda c, i: c * F.pow(1 / rx, i))).otherwise(F.transform(poly, lambda c: c * rx))
    checked = F.when(ok, scaled).otherwise(F.raise_error(F.lit("f-theta cameras keep their aspect ratio")).cast("array<double>"))
    return [checked, cx * rx, cy * ry, (w * rx).cast("int"), (h * ry).cast("int")]


def ftheta_fov(bw: Column, lin: Column, cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """h, v: angles of opposite edge middles, summed; max_angle: the largest over the corners. Radians."""
    def angle(u: Column, v: Column) -> Column:
        ray, _ = ftheta_unproject(bw, lin, cx, cy, u, v)
        return F.acos(F.least(F.greatest(ray[2], d(-1)), d(1)))

    zero, right, low = d(0), (w - 1).cast("double"), (h - 1).cast("double")
    return {
        "h": angle(zero, cy) + angle(right, cy),
        "v": angle(cx, zero) + angle(cx, low),
        "max_angle": F.greatest(angle(zero, zero), angle(right, zero), angle(zero, low), angle(right, low)),
    }


def inside_fov(p: Vec, max_angle: Column) -> Column:
    return F.acos(F.least(F.greatest(F.try_divide(p[2], norm(p)), d(-1)), d(1))) <= max_angle


def border_radius(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Distance of the principal point from the farthest image corner."""
    return F.sqrt(F.pow(F.greatest(cx, w - cx), d(2)) + F.pow(F.greatest(cy, h - cy), d(2)))


def parse_ftheta(v: Column) -> Column:
    """Struct from a vector of 11 or 14 floats: cx, cy, w, h, six coefficients, is_bw, and the linear part (1, 0, 0 if absent)."""
    ok = F.size(v).isin(11, 14)
    item = lambda i: F.get(v, F.lit(i))
    lin = F.when(F.size(v) == 14, F.slice(v, 12, 3)).otherwise(F.array(d(1), d(0), d(0)))
    checked = F.when(ok, item(0)).otherwise(F.raise_error(F.lit("an f-theta vector has 11 or 14 floats")).cast("double"))
    return F.struct(checked.alias("cx"), item(1).alias("cy"), item(2).cast("int").alias("w"), item(3).cast("int").alias("h"), F.slice(v, 5, 6).alias("poly"), (item(10) > 0).alias("is_bw"), lin.alias("lin"))


def ftheta_vector(s: Column) -> Column:
    """The 14 floats of a struct of parse_ftheta()."""
    return F.concat(F.array(s["cx"], s["cy"], s["w"].cast("double"), s["h"].cast("double")), s["poly"], F.array(s["is_bw"].cast("double")), s["lin"])


_RIG = "rig struct<sensors: array<struct<name:string, properties: struct<Model:string, `bw-poly`:string, polynomial:string, `polynomial-type`:string, cx:string, cy:string, width:string, height:string, `linear-c`:string, `linear-d`:string, `linear-e`:string>>>>"


def rig_cameras(rigs: DataFrame, json_col: str = "json") -> DataFrame:
    """(clip_id, camera, cx, cy, w, h, poly, is_bw, lin) from rig JSON: one row per f-theta sensor; other models are left out.

    bw-poly is a backward polynomial; polynomial is one of the type that polynomial-type names."""
    s = rigs.select("clip_id", F.explode(F.from_json(F.col(json_col), _RIG)["rig"]["sensors"]).alias("s")).select("clip_id", F.col("s.name").alias("camera"), F.col("s.properties").alias("p"))
    s = s.filter("p.Model = 'ftheta'")
    bw = F.col("p")["bw-poly"]
    num = lambda name: F.col("p")[name].cast("double")
    poly = F.transform(F.filter(F.split(F.trim(F.coalesce(bw, F.col("p.polynomial"))), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return s.select(
        "clip_id", "camera", num("cx").alias("cx"), num("cy").alias("cy"), num("width").cast("int").alias("w"), num("height").cast("int").alias("h"), poly.alias("poly"),
        (bw.isNotNull() | (F.col("p")["polynomial-type"] == "pixeldistance-to-angle")).alias("is_bw"),
        F.array(F.coalesce(num("linear-c"), d(1)), F.coalesce(num("linear-d"), d(0)), F.coalesce(num("linear-e"), d(0))).alias("lin"),
    )


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are computed once for a row, though lambdas name them again and again: a generator is not copied into what follows it."""
    for name, value in values.items():
        df = df.withColumn(name, F.explode(F.array(value)))
    return df


def _solve(n: int):
    """Gauss elimination of an n x (n + 1) system, as an aggregate over array rows, on the JVM."""
    def run(system: Column) -> Column:
        def eliminate(m: Column, k: Column) -> Column:
            pivot = F.get(m, k)
            scaled = F.transform(pivot, lambda x: F.try_divide(x, F.get(pivot, k)))
            return F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - F.get(row, k) * b)))

        done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), system, eliminate)
        return F.transform(done, lambda row: F.get(row, F.lit(n)))

    return run


def fit_inverse(cameras: DataFrame, degree: int = 5) -> DataFrame:
    """Adds `inverse`: the polynomial without intercept that maps the values of `poly` over [0, domain] back, by least
    squares on FIT_SAMPLES samples. cameras: poly and domain; each row is solved by itself.

    Samples are scaled to [0, 1] first: in pixels the normal equations of degree 5 are too ill-conditioned to solve."""
    if degree not in SUPPORTED_DEGREES:
        raise ValueError(f"degree must be one of {SUPPORTED_DEGREES}")
    c = _once(cameras, __rev=F.reverse("poly")).withColumn("__top", F.col("domain").cast("double"))
    value = lambda y: F.aggregate("__rev", d(0), lambda acc, k: acc * y + k)
    steps = F.sequence(F.lit(0), F.lit(FIT_SAMPLES - 1))
    c = _once(c, __x=F.transform(steps, lambda i: value(F.col("__top") * i / (FIT_SAMPLES - 1))))
    c = _once(c, __scale=F.array_max("__x"))
    samples = F.zip_with("__x", steps, lambda x, i: F.struct(F.try_divide(x, F.col("__scale")).alias("x"), F.try_divide(F.col("__top") * i / (FIT_SAMPLES - 1), F.col("__top")).alias("y")))
    c = _once(c, __samples=samples)
    total = lambda of: F.aggregate("__samples", d(0), lambda acc, s: acc + of(s))
    powers = [total(lambda s, k=k: F.pow(s["x"], d(k))) for k in range(1, 2 * degree + 1)]
    c = _once(c, __s=F.array(*powers, *(total(lambda s, k=k: F.pow(s["x"], d(k)) * s["y"]) for k in range(1, degree + 1))))
    at = lambda k: F.col("__s")[k - 1]
    system = F.array(*(F.array(*(at(i + j) for j in range(1, degree + 1)), F.col("__s")[2 * degree + i - 1]) for i in range(1, degree + 1)))
    c = _once(c, __c=_solve(degree)(system))
    inverse = F.concat(F.array(d(0)), F.transform("__c", lambda k, i: k * F.col("__top") / F.pow(F.col("__scale"), (i + 1).cast("double"))))
    return c.withColumn("inverse", inverse).select(*cameras.columns, "inverse")


def forward_domain(cameras: DataFrame) -> DataFrame:
    """Adds max_angle, scanned in steps of pi / DOMAIN_STEPS: the last angle before the forward polynomial `fw` stops rising,
    or the first at which it passes `border`; pi if neither happens. Each row is solved by itself.

    Blocks of DOMAIN_BLOCK steps are passed over where the value and the slope in the middle are farther from their limits than they can
    change in half a block; the others are scanned, up to the first block whose middle is beyond a limit."""
    step = math.pi / DOMAIN_STEPS
    c = _once(cameras, __rev=F.reverse("fw"), __slope=F.reverse(derivative(F.col("fw"))))
    most = lambda k: F.aggregate(F.transform("fw", lambda a, i: F.abs(a) * (i if k == 1 else i * (i - 1)) * F.pow(d(math.pi), F.greatest(i - k, F.lit(0)).cast("double"))), d(0), lambda acc, x: acc + x)
    reach = DOMAIN_BLOCK / 2 * step
    c = _once(c, __m1=most(1) * reach, __m2=most(2) * reach)
    value = lambda poly, i: F.aggregate(poly, d(0), lambda acc, k: acc * (i * F.pi() / DOMAIN_STEPS) + k)
    middle = lambda b: b * DOMAIN_BLOCK + DOMAIN_BLOCK / 2
    blocks = F.transform(F.sequence(F.lit(0), F.lit(DOMAIN_STEPS // DOMAIN_BLOCK - 1)), lambda b: F.struct(b.alias("b"), value("__slope", middle(b)).alias("s"), value("__rev", middle(b)).alias("v")))
    c = _once(c, __blocks=blocks)
    over = lambda x, by: (x["s"] <= by * F.col("__m2")) | (x["v"] > F.col("border") - by * F.col("__m1"))
    c = _once(c, __end=F.coalesce(F.array_min(F.transform(F.filter("__blocks", lambda x: over(x, F.lit(0))), lambda x: x["b"])), F.lit(DOMAIN_STEPS)))
    near = F.filter("__blocks", lambda x: (x["b"] <= F.col("__end")) & over(x, F.lit(1.000001)))

    def scanned(x: Column) -> Column:
        steps = F.sequence(x["b"] * DOMAIN_BLOCK + 1, (x["b"] + 1) * DOMAIN_BLOCK)
        stops = F.transform(steps, lambda i: F.when(value("__slope", i) <= 0, F.struct(i.alias("i"), (i - 1).alias("stop"))).when(value("__rev", i) > F.col("border"), F.struct(i.alias("i"), i.alias("stop"))))
        return F.array_min(stops)

    hit = F.array_min(F.transform(near, scanned))
    return c.withColumn("max_angle", F.coalesce(hit["stop"], F.lit(DOMAIN_STEPS)) * F.pi() / DOMAIN_STEPS).select(*cameras.columns, "max_angle")


def calibrate_ftheta(cameras: DataFrame) -> DataFrame:
    """Adds bw, fw, max_angle, edge_r and edge_dr to f-theta cameras (poly, is_bw, lin, cx, cy, w, h).

    The missing direction is fitted over the image's radius. A slope that is not positive at the edge is an error."""
    c = cameras.withColumn("border", border_radius(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))
    back = fit_inverse(c.filter("is_bw").withColumn("domain", F.col("border"))).withColumns({"bw": F.col("poly"), "fw": F.col("inverse")})
    ahead = c.filter("NOT is_bw").withColumn("fw", F.col("poly"))
    ahead = forward_domain(ahead).withColumnRenamed("max_angle", "domain")
    ahead = fit_inverse(ahead).withColumn("bw", F.col("inverse"))
    both = back.unionByName(ahead).drop("domain", "inverse")
    both = both.withColumn("max_angle", ftheta_fov(F.col("bw"), F.col("lin"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))["max_angle"])
    both = both.withColumn("edge_r", horner(F.col("fw"), F.col("max_angle"))).withColumn("edge_dr", horner(derivative(F.col("fw")), F.col("max_angle")))
    slope = F.when(F.col("edge_dr") > 0, F.col("edge_dr")).otherwise(F.raise_error(F.lit("the forward polynomial falls at the image's edge")).cast("double"))
    return both.withColumn("edge_dr", slope).drop("border")


def ftheta_models(intrinsics: DataFrame, w: int | None = None, h: int | None = None, key: tuple[str, ...] = ("clip_id", "camera")) -> DataFrame:
    """Calibrated f-theta cameras from vectors of 11 or 14 floats (key, values), resized to w x h where these are given. Rows
    without values are left out: report them from with_default_intrinsics()."""
    c = intrinsics.filter("values IS NOT NULL").select(*key, parse_ftheta(F.col("values")).alias("s")).select(*key, "s.*")
    if w and h:
        new = ftheta_rescale(F.col("poly"), F.col("is_bw"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), w / F.col("w"), h / F.col("h"))
        c = c.select(*key, "lin", "is_bw", *(x.alias(n) for x, n in zip(new, ("poly", "cx", "cy", "w", "h"))))
    return calibrate_ftheta(c)


def ray_grid(intrinsics: DataFrame) -> DataFrame:
    """(clip_id, camera, u, v, x, y, z): the unit ray of the middle of every pixel of pinhole cameras (fx, fy, cx, cy, w, h)."""
    g = intrinsics.withColumn("v", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("u", F.explode(F.expr("sequence(0, w - 1)")))
    ray = pinhole_unproject(F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), F.col("u") + 0.5, F.col("v") + 0.5)
    g = g.select("clip_id", "camera", "u", "v", F.array(*ray).alias("ray"))
    n = norm([F.col("ray")[i] for i in range(3)])
    return g.select("clip_id", "camera", "u", "v", *((F.col("ray")[i] / n).alias(a) for i, a in enumerate("xyz")))


def posed_rays(grid: DataFrame, poses: DataFrame) -> DataFrame:
    """World origin (ox, oy, oz) and direction (x, y, z) of every ray in every pose of its camera."""
    from scenetables.functions.mat import shift, turn

    r = grid.join(poses, ["clip_id", "camera"])
    way = turn("m", [F.col(a) for a in "xyz"])
    return r.select("clip_id", "camera", "frame", "u", "v", *(c.alias(f"o{a}") for c, a in zip(shift("m"), "xyz")), *(c.alias(a) for c, a in zip(way, "xyz")))
