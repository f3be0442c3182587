"""Running values along tracks: many small blocks against one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetables.functions import mat
from scenetables.operators import resample, scans


def rows(df):
    return sorted(map(repr, df.collect()))


def cases(spark):
    """Tracks of all lengths, with gaps wider than a block, one long one, and quaternions with products of zero."""
    r = np.random.default_rng(5)
    out = []
    for c, n in (("long", 700), ("b", 60), ("one", 1), ("two", 2)):
        frames = np.sort(r.choice(n * 3, n, replace=False))
        for f in frames:
            q = r.normal(size=4) if r.random() > 0.2 else np.eye(4)[r.integers(0, 4)] * r.choice([-1, 1])
            out.append((c, int(f), *map(float, q), float(r.normal())))
    return spark.createDataFrame(out, "clip_id string, frame int, w double, x double, y double, z double, v double").repartition(5)


@pytest.mark.parametrize("block", [7, 50])
def test_blocks_change_nothing(spark, monkeypatch, block):
    t = cases(spark)
    spine = t.select("clip_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(-3), F.lit(2200))))
    pose = t.select("clip_id", "frame", mat.pose(mat.yaw(F.col("v")), [F.col("w"), F.col("x"), F.col("y")]).alias("m"))
    jobs = {
        "upsample": lambda: resample.upsample(t, ["clip_id"], ["v", "w"]),
        "poses": lambda: resample.extrapolate_poses(resample.upsample_poses(pose, ["clip_id"]), ["clip_id"]),
        "extrapolate": lambda: resample.extrapolate(t, ["clip_id"], ["v", "w"]),
        "bracket": lambda: resample.bracket(spine, t, ["clip_id"]),
        "signs": lambda: resample.align_signs(t, ["clip_id"]),
    }
    whole = {name: rows(job()) for name, job in jobs.items()}
    monkeypatch.setattr(scans, "BLOCK", block)
    for name, job in jobs.items():
        assert rows(job()) == whole[name], name


def test_signs_follow_the_rule(spark, monkeypatch):
    """Against the rule applied row by row."""
    monkeypatch.setattr(scans, "BLOCK", 11)
    t = cases(spark)
    got = {(r.clip_id, r.frame): [r.w, r.x, r.y, r.z] for r in resample.align_signs(t, ["clip_id"]).collect()}
    before: dict = {}
    for r in sorted(t.collect(), key=lambda r: (r.clip_id, r.frame)):
        q = np.array([r.w, r.x, r.y, r.z])
        if r.clip_id in before and before[r.clip_id] @ q < 0:
            q = -q
        before[r.clip_id] = q
        assert np.allclose(got[r.clip_id, r.frame], q)


def test_one_long_track_is_many_groups(spark, monkeypatch):
    """The windows over rows hold a block each; only summaries of blocks share a group."""
    monkeypatch.setattr(scans, "BLOCK", 1000)
    t = spark.range(100_000).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("frame"), F.col("id").cast("double").alias("v"))
    up = resample.upsample(t, ["clip_id"], ["v"])
    plan = up._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    over_rows = [line for line in windows if "frame#" in line]  # the constant clip is no key in the plan
    assert len(windows) == 2 and len(over_rows) == 1 and "windowspecdefinition(__block" in over_rows[0]
    got = up.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.max("frame").alias("f")).first()
    assert (got.n, got.f) == (299_998, 299_997) and math.isclose(got.s, sum(k / 3 for k in range(299_998)), rel_tol=1e-9)


def test_pose_tracks_share_one_pass(spark):
    """All columns of a track go through one window: no rows of (column, value), and no pivot."""
    k = spark.range(40).selectExpr("id % 4 AS clip_id", "cast(id div 4 * 3 AS int) AS frame", *(f"cast(id AS double) AS {c}" for c in ("x", "y", "z", "qw", "qx", "qy", "qz")))
    spine = k.groupBy("clip_id").agg(F.max("frame").alias("last")).select("clip_id", F.expr("explode(sequence(0, last)) AS frame"))
    for way in ("linear", "bezier"):
        plan = resample.pose_track(spine, k, ["clip_id"], way)._jdf.queryExecution().optimizedPlan().toString()
        assert "__n#" not in plan and "pivot" not in plan, way


def test_values_go_along_over_blocks_without_labels(spark):
    b = scans.BLOCK
    rows = [("a", 5, 1.0), ("a", 3 * b, 2.0), ("a", 3 * b + 7, None), (None, 1, 4.0)]
    k = spark.createDataFrame(rows, "clip_id string, frame int, value double")
    at = [("a", f) for f in (0, 5, 6, b - 1, b, 2 * b + 3, 3 * b - 1, 3 * b, 3 * b + 1, 3 * b + 9, 5 * b)] + [("b", 4), (None, 2 * b)]
    spine = spark.createDataFrame(at, "clip_id string, frame int")
    got = {(r.clip_id, r.frame): (r.prev, r.next, r.p_value, r.n_value) for r in resample._around(spine, k, ["clip_id"], ["value"]).collect()}
    want = {}
    for c, f in at:
        p = max(((x[1], x[2]) for x in rows if x[0] == c and x[1] <= f), default=(None, None), key=lambda x: x[0])
        n = min(((x[1], x[2]) for x in rows if x[0] == c and x[1] >= f), default=(None, None), key=lambda x: x[0])
        want[c, f] = (p[0], n[0], p[1], n[1])
    assert got == want
