"""Writing clips as tar files, and reading their members by offset."""

import os
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from scenetables.sources import scene, sinks, tars
from test_scene import rz


def sweeps_and_points(spark, clips=4, frames=5, n=200):
    sweeps = spark.createDataFrame([(f"c{c}", 3 * f, rz(5 * f, (c, f, 0))) for c in range(clips) for f in range(frames)], "clip_id string, frame int, m array<double>")
    p = sweeps.filter("frame > 0").select("clip_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    p = p.select("clip_id", "frame", F.col("k").cast("long").alias("point_id"), *((F.col("k") * i + F.col("frame") / 2).cast("double").alias(a) for i, a in enumerate("xyz")))
    return sweeps, p.repartition(7)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lidar_round_trip(spark, tmp_path):
    """Points and poses come back; a second run writes nothing; a sweep without points stays."""
    sweeps, p = sweeps_and_points(spark)
    tars.write_tars(tars.lidar_members(p, sweeps), str(tmp_path / "lidar"))
    assert sorted(os.listdir(tmp_path / "lidar")) == sorted([*(f"c{c}.tar" for c in range(4)), "_SUCCESS"])
    points, poses = scene.lidar_tables(tars.read_lidar(spark, str(tmp_path / "lidar")))
    assert rows(points) == rows(p.select(*points.columns)) and rows(poses) == rows(sweeps)
    before = {f: os.stat(tmp_path / "lidar" / f).st_mtime_ns for f in os.listdir(tmp_path / "lidar") if f.endswith(".tar")}
    os.unlink(tmp_path / "lidar" / "c2.tar")
    tars.write_tars(tars.lidar_members(p, sweeps), str(tmp_path / "lidar"))
    after = {f: os.stat(tmp_path / "lidar" / f).st_mtime_ns for f in before}
    assert [f for f in before if before[f] != after[f]] == ["c2.tar"] and "1 tars written, 3 there before" in (tmp_path / "lidar" / "_SUCCESS").read_text()
    tars.write_tars(tars.lidar_members(p, sweeps).filter("clip_id = 'c1'").limit(1), str(tmp_path / "lidar"), replace=True)
    assert tars.read_lidar(spark, str(tmp_path / "lidar" / "c1.tar")).count() == 1 and tars.read_lidar(spark, str(tmp_path / "lidar")).count() == 16


def test_killed_task_leaves_no_tar(spark, tmp_path):
    """A task that dies in the middle of a clip; those that are whole may stay, none is half."""
    members = spark.createDataFrame([(f"c{c}", f"{k:03d}.x.bin", bytes([c]) * 1000) for c in range(6) for k in range(30)], "clip_id string, name string, bytes binary")

    def dying(batches):
        for b in batches:
            yield b
            if b.column("clip_id")[0].as_py() == "c3":
                raise RuntimeError("killed")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    bad = members.repartition(3, "clip_id").sortWithinPartitions("clip_id", "name").mapInArrow(dying, members.schema)
    spark.dataSource.register(tars.TarSource)
    try:
        with pytest.raises(Exception, match="killed"):
            bad.write.format("scene_tar").mode("append").save(str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = [f for f in os.listdir(tmp_path / "t") if f.endswith(".tar")]
    assert "c3.tar" not in left
    for f in left:
        assert len(tarfile.open(tmp_path / "t" / f).getnames()) == 30
    tars.write_tars(members, str(tmp_path / "t"))
    assert tars.read_members(spark, str(tmp_path / "t")).count() == 180 and "_temporary" not in os.listdir(tmp_path / "t")


def test_rows_of_a_clip_apart_are_refused(spark, tmp_path):
    spark.dataSource.register(tars.TarSource)
    apart = spark.createDataFrame([("a", "1.x", b"1"), ("b", "1.x", b"2"), ("a", "2.x", b"3")], "clip_id string, name string, bytes binary").coalesce(1)
    with pytest.raises(Exception, match="do not lie together"):
        apart.write.format("scene_tar").mode("append").save(str(tmp_path / "t"))
    with pytest.raises(Exception, match="clip_id, name and bytes"):
        apart.select("name", "clip_id", "bytes").write.format("scene_tar").mode("append").save(str(tmp_path / "u"))


class Counting:
    """An open file that notes what is read of it."""

    def __init__(self, f, seen):
        self.f, self.seen = f, seen

    def read(self, n=-1):
        data = self.f.read(n)
        self.seen.append(len(data))
        return data

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()


def test_filters_choose_what_is_read(spark, tmp_path, monkeypatch):
    """Members that a filter leaves out are skipped over, and so are the tars of other clips."""
    sweeps, p = sweeps_and_points(spark, clips=3, frames=12, n=3000)
    tars.write_tars(tars.lidar_members(p, sweeps), str(tmp_path))
    seen: list[int] = []

    def counted(path):
        system, inner = real(path)

        class Store:
            def open_input_file(self, x):
                return Counting(system.open_input_file(x), seen)

        return Store(), inner

    real = tars.store
    every = sum(os.stat(tmp_path / f"c{c}.tar").st_size for c in range(3))
    reader = tars._LidarReader([str(tmp_path)])
    left = list(reader.pushFilters([ds.EqualTo(("frame",), 9), ds.EqualTo(("clip_id",), "c1"), ds.EqualTo(("m",), [0.0])]))
    assert [f.attribute for f in left] == [("m",)]
    parts = reader.partitions()
    assert [len(x.value) for x in parts] == [3]
    monkeypatch.setattr(tars, "store", counted)
    got = [b for part in parts for b in reader.read(part)]
    assert [(b.num_rows, b.column("frame").to_pylist()) for b in got] == [(1, [9])]
    assert sum(seen) < every / 10
    monkeypatch.undo()
    df = tars.read_lidar(spark, str(tmp_path)).filter("frame > 20 AND clip_id IN ('c0', 'c2')")
    assert sorted((r.clip_id, r.frame, len(r.points)) for r in df.collect()) == [(c, f, 3000) for c in ("c0", "c2") for f in (21, 24, 27, 30, 33)]
    assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    members = tars.read_members(spark, str(tmp_path)).filter("field LIKE '%lidar_raw' AND frame = 3")
    assert [(r.clip_id, r.ext, r.frame) for r in members.orderBy("clip_id").collect()] == [(f"c{c}", "npz", 3) for c in range(3)]


def test_index(spark, tmp_path, monkeypatch):
    """The index is a table to filter; its rows are read by the places they name, a large tar by several tasks."""
    members = spark.createDataFrame([(f"c{c}", f"{k:06d}.pose.front.npy", os.urandom(700)) for c in range(3) for k in range(40)], "clip_id string, name string, bytes binary")
    tars.write_tars(members, f"file://{tmp_path}/pose")
    index = tars.tar_index(spark, f"file://{tmp_path}/pose/")
    index.write.parquet(f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    assert stored.count() == 120 and stored.filter("frame IS NULL").count() == 0
    monkeypatch.setattr(tars, "SPAN_BYTES", 9000)
    some = tars.read_indexed(stored.filter("clip_id <> 'c1' AND frame BETWEEN 5 AND 30"))
    want = tars.read_members(spark, f"{tmp_path}/pose").filter("clip_id <> 'c1' AND frame BETWEEN 5 AND 30")
    assert rows(some) == rows(want) and some.count() == 52
    same = tars.read_members(spark, f"{tmp_path}/pose").select("clip_id", "field", "ext", "frame", "bytes")
    assert rows(same) == rows(scene.read_tars(spark, str(tmp_path), "pose").select(*same.columns))


def test_other_members_of_a_tar(spark, tmp_path):
    """Long names, folders inside, a second sample, fields without a frame; poses are read from what the source gives."""
    eye = sinks.pose_members(spark.createDataFrame([("c", "front", 3, rz(0))], "clip_id string, camera string, frame int, m array<double>")).first()["bytes"]
    with tarfile.open(tmp_path / "c.tar", "w") as tar:
        for name in ("d/", "c.000003.pose.front.npy", f"c.{'x' * 150}.txt", "d/c.about.json", "other.000001.pose.front.npy"):
            info = tarfile.TarInfo(name)
            if name.endswith("/"):
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(eye)
                tar.addfile(info, pa.BufferReader(eye))
    m = tars.read_members(spark, str(tmp_path / "c.tar"))
    assert sorted((r.field, r.ext, r.frame) for r in m.collect()) == [("000003.pose.front", "npy", 3), ("about", "json", None), ("x" * 150, "txt", None)]
    assert np.allclose(scene.camera_poses(m).first().m, rz(0))
