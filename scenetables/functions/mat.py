"""Matrices, vectors and rotations as Spark columns.

A pose is an array of 16 doubles, row by row; a vector is an array of 3; a quaternion is a struct (w, x, y, z).
Everything is built-in arithmetic, so plans stay in generated code. Materialise deep results with a select before
using them several times: an expression is evaluated wherever it stands.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = Sequence[Column]
IDENTITY = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def d(x: float) -> Column:
    return F.lit(float(x))


def vec(c: Column | str, n: int = 3) -> list[Column]:
    """The items of an array column."""
    c = F.col(c) if isinstance(c, str) else c
    return [c[i] for i in range(n)]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vec) -> list[Column]:
    """a at length 1; nulls for a zero vector."""
    n = norm(a)
    return [F.try_divide(x, n) for x in a]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def rot(m: Column | str) -> list[Column]:
    """The nine items of a pose's rotation, row by row."""
    m = F.col(m) if isinstance(m, str) else m
    return [m[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]


def shift(m: Column | str) -> list[Column]:
    """A pose's translation."""
    m = F.col(m) if isinstance(m, str) else m
    return [m[i] for i in (3, 7, 11)]


def pose(r: Vec, t: Vec) -> Column:
    """A pose from nine rotation items and a translation."""
    return F.array(r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], d(0), d(0), d(0), d(1))


def from_axes(x: Vec, y: Vec, z: Vec, t: Vec) -> Column:
    """A pose whose rotation has the columns x, y, z."""
    return pose([x[0], y[0], z[0], x[1], y[1], z[1], x[2], y[2], z[2]], t)


def mul3(a: Vec, b: Vec) -> list[Column]:
    return [dot(a[3 * i : 3 * i + 3], b[j::3]) for i in range(3) for j in range(3)]


def mat_mul(a: Column | str, b: Column | str) -> Column:
    """4x4 product of two poses (last rows are 0 0 0 1)."""
    ra, rb, ta, tb = rot(a), rot(b), shift(a), shift(b)
    return pose(mul3(ra, rb), [dot(ra[3 * i : 3 * i + 3], tb) + ta[i] for i in range(3)])


def turn(m: Column | str, p: Vec) -> list[Column]:
    """Rotation only."""
    r = rot(m)
    return [dot(r[3 * i : 3 * i + 3], p) for i in range(3)]


def apply(m: Column | str, p: Vec) -> list[Column]:
    """Rotation and translation of a point."""
    return [x + t for x, t in zip(turn(m, p), shift(m))]


def apply_vertices(m: Column | str, vertices: Column | str) -> Column:
    """Every (x, y, z) of an array of structs transformed; an empty array stays empty."""
    out = lambda v: F.struct(*(c.alias(n) for c, n in zip(apply(m, [v["x"], v["y"], v["z"]]), "xyz")))
    return F.transform(vertices, out)


def inv3(r: Vec) -> list[Column]:
    """Inverse by cofactors; nulls for a singular matrix."""
    c = [r[4] * r[8] - r[5] * r[7], r[2] * r[7] - r[1] * r[8], r[1] * r[5] - r[2] * r[4], r[5] * r[6] - r[3] * r[8], r[0] * r[8] - r[2] * r[6], r[2] * r[3] - r[0] * r[5], r[3] * r[7] - r[4] * r[6], r[1] * r[6] - r[0] * r[7], r[0] * r[4] - r[1] * r[3]]
    det = r[0] * c[0] + r[1] * c[3] + r[2] * c[6]
    return [F.try_divide(x, det) for x in c]


def affine_inv(m: Column | str) -> Column:
    """General inverse: averaged poses need not be orthonormal, so a transpose would not do."""
    i, t = inv3(rot(m)), shift(m)
    return pose(i, [-dot(i[3 * k : 3 * k + 3], t) for k in range(3)])


def inv_apply(m: Column | str, p: Vec) -> list[Column]:
    """The inverse of m applied to a point."""
    i, t = inv3(rot(m)), shift(m)
    q = [x - y for x, y in zip(p, t)]
    return [dot(i[3 * k : 3 * k + 3], q) for k in range(3)]


def flu_to_opencv(m: Column | str) -> Column:
    """Axes forward-left-up to right-down-forward: columns (-c1, -c2, c0, c3)."""
    r = rot(m)
    return from_axes([-r[1], -r[4], -r[7]], [-r[2], -r[5], -r[8]], [r[0], r[3], r[6]], shift(m))


def opencv_to_flu(m: Column | str) -> Column:
    r = rot(m)
    return from_axes([r[2], r[5], r[8]], [-r[0], -r[3], -r[6]], [-r[1], -r[4], -r[7]], shift(m))


def yaw(angle: Column) -> list[Column]:
    c, s = F.cos(angle), F.sin(angle)
    return [c, -s, d(0), s, c, d(0), d(0), d(0), d(1)]


def euler_zyx(z: Column, y: Column, x: Column) -> list[Column]:
    """Rz Ry Rx."""
    ry = [F.cos(y), d(0), F.sin(y), d(0), d(1), d(0), -F.sin(y), d(0), F.cos(y)]
    rx = [d(1), d(0), d(0), d(0), F.cos(x), -F.sin(x), d(0), F.sin(x), F.cos(x)]
    return mul3(mul3(yaw(z), ry), rx)


def heading_pose(vehicle: Column | str, heading: Column, centre: Vec) -> Column:
    """World pose of a box from its heading and centre in the vehicle's frame."""
    return pose(mul3(rot(vehicle), yaw(heading)), apply(vehicle, centre))


def heading(m: Column | str) -> list[Column]:
    """Normalised first column of the rotation."""
    r = rot(m)
    return unit([r[0], r[3], r[6]])


def grounded(m: Column | str, height: Column | None = None, convention: str = "flu") -> Column:
    """Pose with its forward axis laid flat and its up axis along z. The translation stays, or takes the height.

    convention: axes of m and of the result, "flu" or "opencv"; another is an error."""
    if convention not in ("flu", "opencv"):
        raise ValueError(f"unknown convention {convention!r}")
    r, t = rot(m), shift(m)
    forward = [r[0], r[3]] if convention == "flu" else [r[2], r[5]]
    f = [*unit([*forward, d(0)])[:2], d(0)]
    left = [-f[1], f[0], d(0)]  # up x forward
    t = [t[0], t[1], t[2] if height is None else height]
    out = from_axes(f, left, [d(0), d(0), d(1)], t)
    return out if convention == "flu" else flu_to_opencv(out)


def is_orthonormal(r: list[Column], eps: float = 1e-12) -> Column:
    """Whether the rows of nine items are of length one and at right angles, but for eps."""
    rows = [r[0:3], r[3:6], r[6:9]]
    apart = [F.abs(dot(rows[a], rows[b]) - (1.0 if a == b else 0.0)) <= eps for a in range(3) for b in range(a, 3)]
    return functools.reduce(Column.__and__, apart)


def nearest_rotation(m: Column | str, rounds: int = 8) -> Column:
    """Polar factor by Newton steps 0.5 (R + R^-T), in one aggregate so that the expression stays small. Steps end when the matrix is orthonormal; one that is so from the
    start takes none, and no interpreted aggregate."""
    m = F.col(m) if isinstance(m, str) else m

    def step(acc: Column, _: Column) -> Column:
        r = [acc[i] for i in range(9)]
        i = inv3(r)
        return F.when(is_orthonormal(r), acc).otherwise(F.array(*(0.5 * (r[3 * a + b] + i[3 * b + a]) for a in range(3) for b in range(3))))

    r = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*rot(m)), step)
    found = F.transform(F.array(r), lambda x: pose([x[i] for i in range(9)], shift(m)))[0]
    return F.when(is_orthonormal(rot(m)), pose(rot(m), shift(m))).otherwise(found)


# Quaternions -------------------------------------------------------------------------------------------------


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def q_items(q: Column | str) -> list[Column]:
    q = F.col(q) if isinstance(q, str) else q
    return [q["w"], q["x"], q["y"], q["z"]]


def q_from(m: Column | str) -> Column:
    """Quaternion of a pose's rotation: the branch of the largest of trace and diagonal."""
    r = rot(m)
    trace = r[0] + r[4] + r[8]
    s0 = F.sqrt(F.greatest(trace + 1, d(1e-300))) * 2
    s1 = F.sqrt(F.greatest(1 + r[0] - r[4] - r[8], d(1e-300))) * 2
    s2 = F.sqrt(F.greatest(1 + r[4] - r[0] - r[8], d(1e-300))) * 2
    s3 = F.sqrt(F.greatest(1 + r[8] - r[0] - r[4], d(1e-300))) * 2
    return (
        F.when(trace > 0, quat(s0 / 4, (r[7] - r[5]) / s0, (r[2] - r[6]) / s0, (r[3] - r[1]) / s0))
        .when((r[0] >= r[4]) & (r[0] >= r[8]), quat((r[7] - r[5]) / s1, s1 / 4, (r[1] + r[3]) / s1, (r[2] + r[6]) / s1))
        .when(r[4] >= r[8], quat((r[2] - r[6]) / s2, (r[1] + r[3]) / s2, s2 / 4, (r[5] + r[7]) / s2))
        .otherwise(quat((r[3] - r[1]) / s3, (r[2] + r[6]) / s3, (r[5] + r[7]) / s3, s3 / 4))
    )


def q_rotation(q: Column | str) -> list[Column]:
    w, x, y, z = q_items(q)
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def q_mul(a: Vec, b: Vec) -> list[Column]:
    return [a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2], a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0]]


def q_log(q: Vec) -> list[Column]:
    """Rotation vector (half angle times axis) of a unit quaternion."""
    v = norm(q[1:])
    k = F.when(v > 1e-12, F.atan2(v, q[0]) / F.greatest(v, d(1e-12))).otherwise(d(1))
    return [k * x for x in q[1:]]


def q_exp(v: Vec) -> list[Column]:
    n = norm(v)
    k = F.when(n > 1e-12, F.sin(n) / F.greatest(n, d(1e-12))).otherwise(d(1))
    return [F.cos(n), *(k * x for x in v)]


def with_slerp(df: DataFrame, a: str, b: str, t: Column, out: str, align: bool = True) -> DataFrame:
    """Adds the spherical interpolation of two quaternion columns, along the shorter way if align; straight and renormalised
    for small angles. Each stage is a column of its own, so nothing is computed twice."""
    p, q = q_items(a), q_items(b)
    df = df.withColumn("__t", t.cast("double")).withColumn("__dot", dot(p, q))
    df = df.withColumn("__sign", F.when(F.col("__dot") < 0, d(-1)).otherwise(d(1)) if align else d(1))
    df = df.withColumn("__angle", F.acos(F.least(F.greatest(F.col("__dot") * F.col("__sign"), d(-1)), d(1)))).withColumn("__sin", F.sin("__angle"))
    near, safe = F.col("__sin") < 1e-9, F.greatest("__sin", d(1e-9))
    df = df.withColumn("__ka", F.when(near, 1 - F.col("__t")).otherwise(F.sin((1 - F.col("__t")) * F.col("__angle")) / safe))
    df = df.withColumn("__kb", F.when(near, F.col("__t")).otherwise(F.sin(F.col("__t") * F.col("__angle")) / safe) * F.col("__sign"))
    df = df.withColumn("__raw", F.array(*(F.col("__ka") * x + F.col("__kb") * y for x, y in zip(p, q))))
    df = df.withColumn("__norm", norm(vec("__raw", 4)))
    df = df.withColumn(out, quat(*(F.try_divide(x, F.col("__norm")) for x in vec("__raw", 4))))
    return df.drop("__t", "__dot", "__sign", "__angle", "__sin", "__ka", "__kb", "__raw", "__norm")


def with_interpolated_pose(df: DataFrame, a: str, b: str, t: Column, out: str) -> DataFrame:
    """Adds the pose between columns a (t = 0) and b (t = 1): translation by lerp, rotation by slerp. Null where either is."""
    df = df.withColumn("__at", t.cast("double")).withColumn("__qa", q_from(a)).withColumn("__qb", q_from(b))
    df = with_slerp(df, "__qa", "__qb", F.col("__at"), "__q")
    at = [lerp(x, y, F.col("__at")) for x, y in zip(shift(a), shift(b))]
    made = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), pose(q_rotation("__q"), at))
    return df.withColumn(out, made).drop("__qa", "__qb", "__q", "__at")


def axis_angle(angle: Column, axis: Column, centre: Vec) -> Column:
    """Pose of a rotation about the axis named 'x', 'y' or 'z', at a centre."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis == "x", axis == "y", axis == "z"
    v = lambda on, a, b: F.when(on, a).otherwise(b)
    r = [v(x, d(1), c), v(z, -s, d(0)), v(y, s, d(0)), v(z, s, d(0)), v(y, d(1), c), v(x, -s, d(0)), v(y, -s, d(0)), v(x, s, d(0)), v(z, d(1), c)]
    known = F.when(x | y | z, r[0]).otherwise(F.raise_error(F.concat(F.lit("unknown axis "), axis)).cast("double"))
    return pose([known, *r[1:]], centre)
