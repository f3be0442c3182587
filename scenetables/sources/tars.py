"""Tar files as a data source: reading by member offsets with filters pushed down, and writing with commits.

    spark.dataSource.register(TarSource)
    spark.read.format("scene_tar").option("path", folder).load()      # clip_id, field, ext, frame, bytes
    write_tars(members, folder)                                       # clip_id, name, bytes

A reader looks at headers first, skipping over contents, and reads the contents of those members alone that pass the filters on clip_id, field, ext and frame.
Folders are local ones that all executors share, or URIs of a store that Arrow's file systems know. Tars are not compressed (scene.read_tars() reads
others, by the first byte to the last).
"""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

#: Bytes of tars that a task reads, of members that go into an Arrow batch, and of a tar that read_indexed() gives one task.
TASK_BYTES, BATCH_BYTES, SPAN_BYTES = 128 << 20, 16 << 20, 256 << 20
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_MEMBERS = "clip_id string, field string, ext string, frame int, bytes binary"
_INDEX = "path string, clip_id string, field string, ext string, frame int, offset long, size long"
_LIDAR = ".lidar_raw"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class Member:
    clip_id: str
    field: str
    ext: str
    frame: int | None
    offset: int
    size: int


def headers(f: pa.NativeFile) -> Iterator[Member]:
    """The members of the first sample of an open tar; contents are skipped."""
    first = None
    with tarfile.open(fileobj=f, mode="r:") as tar:
        for m in tar:
            if not m.isfile():
                continue
            key, _, rest = m.name.rsplit("/", 1)[-1].partition(".")
            first = first or key
            if key != first:
                return
            field, _, ext = rest.rpartition(".")
            digits = re.match(r"\d+", field)
            yield Member(key, field, ext, int(digits.group()) if digits and int(digits.group()) < 1 << 31 else None, m.offset_data, m.size)


def _tars(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the tar files under a folder; a path that is a tar is itself."""
    folder = folder.rstrip("/")
    system, inner = store(folder)
    found = system.get_file_info(inner)
    infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
    return sorted((scheme + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(".tar") and "/_temporary/" not in i.path)


def _packed(tars: list[tuple[str, int]]) -> list[list[str]]:
    """Paths in groups of TASK_BYTES or a single tar."""
    groups: list[list[str]] = []
    left = 0
    for path, size in tars:
        if not groups or size > left:
            groups.append([])
            left = TASK_BYTES
        groups[-1].append(path)
        left -= size
    return groups


#: The filters that headers can answer, by their kind.
_TESTS = {
    ds.EqualTo: lambda x, v: x == v,
    ds.In: lambda x, v: x in v,
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.IsNotNull: lambda x, v: True,
}


class _Reader(ds.DataSourceReader):
    """Reads the members of tars that pass the filters on `columns`."""

    columns = ("clip_id", "field", "ext", "frame")

    def __init__(self, folders: list[str]):
        self.folders, self.tests = folders, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.tests.append((f.attribute[0], type(f), value))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        return [ds.InputPartition(g) for g in _packed([t for f in self.folders for t in _tars(f)])]

    def passes(self, m: Member, columns: tuple[str, ...]) -> bool:
        return all((x := getattr(m, c)) is not None and _TESTS[kind](x, v) for c, kind, v in self.tests if c in columns)

    def wanted(self, m: Member) -> bool:
        return self.passes(m, self.columns)

    def batch(self, rows: list[tuple[Member, bytes]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
        cols = [pa.array([getattr(m, c) for m, _ in rows], k) for c, k in zip(("clip_id", "field", "ext", "frame"), kinds)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([b for _, b in rows], pa.binary())], ["clip_id", "field", "ext", "frame", "bytes"])

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            system, inner = store(path)
            with system.open_input_file(inner) as f:
                found = []
                for m in headers(f):
                    if not self.passes(m, ("clip_id",)):
                        break  # a tar holds one clip
                    if self.wanted(m):
                        found.append(m)
                yield from map(self.batch, _contents(f, found))


def _contents(f: pa.NativeFile, members: Iterable[Member]) -> Iterator[list[tuple[Member, bytes]]]:
    """Members with their bytes, in lists of BATCH_BYTES or a single member."""
    rows, held = [], 0
    for m in members:
        if rows and held + m.size > BATCH_BYTES:
            yield rows
            rows, held = [], 0
        f.seek(m.offset)
        rows.append((m, f.read(m.size)))
        held += m.size
    if rows:
        yield rows


class TarSource(ds.DataSource):
    """Rows of members, read and written. Options: path (a folder, or a tar)."""

    @classmethod
    def name(cls) -> str:
        return "scene_tar"

    def schema(self) -> str:
        return _MEMBERS

    def reader(self, schema) -> ds.DataSourceReader:
        return _Reader([self.options["path"]])

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        if schema.names != ["clip_id", "name", "bytes"]:
            raise ValueError("a tar is written from clip_id, name and bytes")
        return _Writer(self.options["path"].rstrip("/"), overwrite)


class _LidarReader(_Reader):
    """Sweeps; filters on clip_id and frame choose the members."""

    columns = ("clip_id", "frame")

    def wanted(self, m: Member) -> bool:
        return m.ext == "npz" and m.field.endswith(_LIDAR) and super().wanted(m)

    def batch(self, rows: list[tuple[Member, bytes]]) -> pa.RecordBatch:
        sweeps = [np.load(io.BytesIO(b)) for _, b in rows]
        xyz = [z["xyz"].astype(float).reshape(-1, 3) for z in sweeps]
        ends = np.cumsum([0, *map(len, xyz)], dtype=np.int32)
        flat = pa.array(np.concatenate(xyz).ravel())
        places = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1, dtype=np.int32) * 3), flat)
        poses = pa.array([z["lidar_to_world"].astype(float).ravel() for z in sweeps], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([m.clip_id for m, _ in rows]), pa.array([m.frame for m, _ in rows], pa.int32()), poses, pa.ListArray.from_arrays(pa.array(ends), places)], ["clip_id", "frame", "m", "points"])


class LidarSource(ds.DataSource):
    """Sweeps with their points, from tars with `{frame}.lidar_raw.npz` members. Options: path (a folder, or a tar)."""

    @classmethod
    def name(cls) -> str:
        return "lidar_tar"

    def schema(self) -> str:
        return "clip_id string, frame int, m array<double>, points array<array<double>>"

    def reader(self, schema) -> ds.DataSourceReader:
        return _LidarReader([self.options["path"]])


@dataclass
class _Written(ds.WriterCommitMessage):
    tars: int
    skipped: int


class _Writer(ds.DataSourceArrowWriter):
    """Streams each clip's rows into a tar under _temporary, and gives the tars their names when a task is done: a task that is killed leaves none under its
    name, and one that is run again makes the same bytes. Clips whose tar is there are skipped, unless it is to be replaced. One job at a time writes to a folder: what
killed tasks have left under _temporary goes when the next one ends."""

    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace, self.job = folder, replace, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = store(self.folder)
        attempt = f"{folder}/_temporary/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt)
        done: dict[str, bool] = {}
        clip, out, tar = None, None, None

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()

        for b in iterator:
            for key, name, content in zip(b.column("clip_id").to_pylist(), b.column("name").to_pylist(), b.column("bytes")):
                if key != clip:
                    close()
                    if key in done:
                        raise ValueError(f"the rows of clip {key} do not lie together")
                    clip, out, tar = key, None, None
                    done[key] = self.replace or system.get_file_info(f"{folder}/{key}.tar").type == fs.FileType.NotFound
                    if done[key]:
                        out = system.open_output_stream(f"{attempt}/{key}.tar")
                        tar = tarfile.open(fileobj=out, mode="w|")
                if tar is not None:
                    data = content.as_py() or b""
                    info = tarfile.TarInfo(f"{key}.{name}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        close()
        for key in (k for k, new in done.items() if new):
            system.move(f"{attempt}/{key}.tar", f"{folder}/{key}.tar")
        return _Written(sum(done.values()), len(done) - sum(done.values()))

    def _clean(self) -> None:
        system, folder = store(self.folder)
        if system.get_file_info(f"{folder}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")

    def commit(self, messages: list) -> None:
        self._clean()
        system, folder = store(self.folder)
        with system.open_output_stream(f"{folder}/_SUCCESS") as f:
            f.write(f"{sum(m.tars for m in messages if m)} tars written, {sum(m.skipped for m in messages if m)} there before\n".encode())

    def abort(self, messages: list) -> None:
        self._clean()


def write_tars(members: DataFrame, folder: str, replace: bool = False) -> None:
    """A tar `{clip_id}.tar` in the folder for each clip of members (clip_id, name, bytes), members in the order of their names. A task holds one member
    at a time; a clip's rows come to one task, sorted. Clips whose tar is there are left alone unless replaced."""
    members.sparkSession.dataSource.register(TarSource)
    rows = members.select(F.col("clip_id").cast("string").alias("clip_id"), "name", "bytes").repartition("clip_id").sortWithinPartitions("clip_id", "name")
    rows.write.format("scene_tar").mode("overwrite" if replace else "append").save(folder)


class _FileWriter(ds.DataSourceArrowWriter):
    """A file for each row, under its name when all of it is there. A name that exists is left alone, unless it is to be replaced."""

    def __init__(self, folder: str, replace: bool):
        self.folder, self.replace = folder, replace

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = store(self.folder)
        system.create_dir(f"{folder}/_temporary")
        new = old = 0
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("bytes")):
                if not self.replace and system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                    old += 1
                    continue
                part = f"{folder}/_temporary/{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_py() or b"")
                system.move(part, f"{folder}/{name}")
                new += 1
        return _Written(new, old)

    def commit(self, messages: list) -> None:
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, folder = store(self.folder)
        if system.get_file_info(f"{folder}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")


class FileSink(ds.DataSource):
    """Rows (name, bytes) written as files of a folder. Options: path."""

    @classmethod
    def name(cls) -> str:
        return "scene_files"

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        return _FileWriter(self.options["path"].rstrip("/"), overwrite)


def write_files(rows: DataFrame, folder: str, replace: bool = False) -> None:
    """A file in the folder for each row (name, bytes), for tools that read captions or map JSON file by file; rows of one name overwrite each other. Files
    that are there are left alone unless replaced, so that a job that stopped goes on where it was."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select(F.col("name").cast("string").alias("name"), F.col("bytes").cast("binary").alias("bytes")).write.format("scene_files").mode("overwrite" if replace else "append").save(folder)


def _loaded(spark: SparkSession, source: type[ds.DataSource], folder: str) -> DataFrame:
    if spark.conf.get(_PUSHDOWN, "false") != "true":
        spark.conf.set(_PUSHDOWN, "true")  # else Spark refuses a reader that takes filters
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(folder)


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, field, ext, frame, bytes) of the tars under a folder, as scene.read_tars() gives them; filters reach the reader."""
    return _loaded(spark, TarSource, folder)


def read_lidar(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, frame, m, points) of the sweeps in the tars under a folder, for scene.lidar_tables(); filters on clip_id and frame reach the reader."""
    return _loaded(spark, LidarSource, folder)


def tar_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, clip_id, field, ext, frame, offset, size) of the members of the tars under a folder, from headers alone. Store it, and later jobs
    choose members by a scan of this table."""
    paths = spark.createDataFrame([(p,) for p, _ in _tars(folder)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("clip_id", "field", "ext", "frame", "offset", "size")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        for b in batches:
            for path in b.column("path").to_pylist():
                system, inner = store(path)
                with system.open_input_file(inner) as f:
                    found = list(headers(f))
                cols = [pa.array([getattr(m, n) for m in found], k) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *cols], ["path", *names])

    return paths.repartition(max(1, min(10_000, paths.count() // 100))).mapInArrow(run, _INDEX)


def read_indexed(index: DataFrame) -> DataFrame:
    """(clip_id, field, ext, frame, bytes) of the members that rows of an index name. Members that lie together in a tar are read by one
    task, SPAN_BYTES of it at most, so that a large tar is read by several."""
    near = index.repartition(F.col("path"), F.floor(F.col("offset") / SPAN_BYTES)).sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, f = _Reader([]), None, None
        for b in batches:
            rows = b.to_pylist()
            for k, r in enumerate(rows):
                if r["path"] != at:
                    if f is not None:
                        f.close()
                    system, inner = store(r["path"])
                    at, f = r["path"], system.open_input_file(inner)
                    here = (Member(**{n: x[n] for n in ("clip_id", "field", "ext", "frame", "offset", "size")}) for x in rows[k:] if x["path"] == at)
                    yield from map(reader.batch, _contents(f, here))
            at = None
        if f is not None:
            f.close()

    return near.mapInArrow(run, _MEMBERS)


def lidar_members(points: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(clip_id, name, bytes): a member for each sweep that read_lidar() reads: its points (clip_id, frame, point_id, x, y, z), in the order of their ids, as single precision, and its
    pose (clip_id, frame, m). A sweep, bounded by its sensor, is in memory at a time. Sweeps without points are empty members; points without a pose are left out."""

    def pack(key: tuple[pa.Scalar, ...], p: pa.Table, s: pa.Table) -> pa.Table:
        rows = []
        if s.num_rows:
            p = p.sort_by("point_id")
            xyz = np.stack([p.column(a).to_numpy() for a in "xyz"], axis=1).astype(np.float32)
            out = io.BytesIO()
            np.savez_compressed(out, xyz=xyz, lidar_to_world=np.array(s.column("m")[0].as_py(), dtype=float).reshape(4, 4))
            rows = [(str(key[0].as_py()), f"{key[1].as_py():06d}{_LIDAR}.npz", out.getvalue())]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.binary()))], ["clip_id", "name", "bytes"])

    p, s = points.select("clip_id", "frame", "point_id", *"xyz"), sweeps.select("clip_id", "frame", "m")
    return p.groupBy("clip_id", "frame").cogroup(s.groupBy("clip_id", "frame")).applyInArrow(pack, "clip_id string, name string, bytes binary")
