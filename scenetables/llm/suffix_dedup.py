"""Repeated byte strings by an enhanced suffix array over anchored suffixes.

A string of REPORT bytes that occurs twice has the same smallest-hash GRAM-byte gram in both places, so only the
suffixes at such anchors need sorting. Occurrences of an anchor form a class; a row's context is what its windows
of REPORT bytes cover, and the bytes after them up to LENGTH from the last start. Classes of one member are dropped by counts of
grams alone. Equal contexts repeat each other, which a hash settles. For the rest of a class the suffixes from the anchor are
sorted; a stack scan of their common prefixes walks the interval tree, and at every interval the left extensions of its
members are compared. That gives each occurrence the longest repeats it takes part in, whatever the order of the occurrences. Classes of more than CLASS members
are first cut into finer ones, by more of the text around the anchor, down to single windows, which need no sorting; so
no class grows with the corpus.

Repeats of REPORT bytes or more are reported; bytes go where a repeat of LENGTH or more covers them. The groups of maximal repeats,
each whole and with all its occurrences, are made in repeat_groups.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from scenetables.llm.common import discard, materialize, small_batches, table, text_key

LENGTH = 400
REPORT = 256
GRAM = 40
CLASS = 4_096
CELLS = (16, 1)  # window starts that a finer class spans
CHUNK = 1 << 20
EMIT = 8 << 20  # bytes of contexts that leave a task at a time
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROW = "gram long, ctx long, start long, lead int, span int, size int"
_KINDS = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_SPAN = "start long, end long, name long"


class _Powers:
    """Powers of the hash base and of its inverse, as far as texts have asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            ones = np.ones(1, np.uint64)
            cls.up = np.concatenate([ones, np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            cls.down = np.concatenate([ones, np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])


def _chunk_anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows that start in b: anchors, their gram hashes, and the first and last start of the windows of each."""
    n = len(b)
    _Powers.reach(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * _Powers.up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _Powers.down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    mask = np.uint64((1 << 22) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # the smallest hash, and of equal ones the leftmost
    w = length - gram + 1
    rows = -(-len(key) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    windows = n - length + 1
    at = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], windows) - 1
    a = at[first]
    return a, h[a].view(np.int64), first, last


def text_anchors(raw: bytes, report: int = REPORT, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Columns of _ROW: gram hash, context digest, first window start, anchor minus that, last window start minus that, and
    bytes of the context."""
    parts = [np.zeros((4, 0), np.int64)]
    b = np.frombuffer(raw, np.uint8)
    for c in range(0, len(raw) - report + 1, CHUNK):
        a, h, first, last = _chunk_anchors(b[c : c + CHUNK + report - 1], report, gram)
        parts.append(np.array([c + a, h, c + first, c + last]))
    a, h, start, last = np.concatenate(parts, axis=1)
    new = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])  # an anchor of two chunks is one row
    a, h, start, last = a[new], h[new], start[new], last[np.append(new[1:], len(a))[: len(new)] - 1]
    size = np.minimum(last - start + length, len(raw) - start)
    ctx = np.fromiter(map(xxh3_64_intdigest, (raw[s:e] for s, e in zip(start.tolist(), (start + size).tolist()))), np.uint64, len(a))
    return [x.astype(k) for x, k in zip((h, ctx.view(np.int64), start, a - start, last - start, size), _KINDS)]


def anchors(docs: DataFrame, report: int = REPORT, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, gram, ctx, start, lead, span, size) of docs(doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [text_anchors((t.as_py() or "").encode(), report, length, gram) for t in part.column("text")]
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found]))
                cols = [pa.array(np.concatenate([f[i] for f in found])) for i in range(len(_KINDS))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("text_key").take(of), *cols], ["doc_id", "text_key", *_NAMES])

    return small_batches(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, {_ROW}")


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def interval_repeats(right: list[bytes], left: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, l, r): places i and j share r bytes to the right of their anchors and l to the left, l + r >= length.

    right holds the suffixes from the anchors, left the texts before them, reversed. For every place, the pairs given
    cover all windows that it shares with any other place: an interval's members are kept in the order of their left
    texts, where the longest shared left extension is always that of a neighbour; a member of the larger part
    that is no neighbour of a newcomer has a closer one already, at a longer common prefix."""
    order = sorted(range(len(right)), key=right.__getitem__)
    by_left = sorted(range(len(left)), key=left.__getitem__)
    rank = [0] * len(left)
    for k, i in enumerate(by_left):
        rank[i] = k

    def merged(a: list[int], b: list[int], r: int) -> list[int]:
        """Joins two lists of left ranks; pairs go to `found`."""
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect_left(a, x)
            for y in a[max(k - 1, 0) : k + 1]:
                i, j = by_left[x], by_left[y]
                n = common(left[i], left[j])
                if n + r >= length:
                    found.append((i, j, n, r))
            a.insert(k, x)
        return a

    found: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []  # (common prefix with what follows, members) of the open intervals
    for k, i in enumerate(order):
        members = [rank[i]]
        follows = common(right[i], right[order[k + 1]]) if k + 1 < len(order) else -1
        while stack and stack[-1][0] > follows:
            r, before = stack.pop()
            members = merged(before, members, r)
        if follows >= 0:
            if stack and stack[-1][0] == follows:
                members = merged(stack.pop()[1], members, follows)
            stack.append((follows, members))
        yield from found
        found.clear()


def name_of(repeat: bytes) -> int:
    """Signed 64-bit name of a repeated string."""
    return int(np.uint64(xxh3_64_intdigest(repeat)).astype(np.int64))


def class_spans(rows: list[tuple], report: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, start, end, name) of the maximal repeats of a class; rows are (data, start, lead)."""
    right = [d[lead:] for d, _, lead in rows]
    left = [d[:lead][::-1] for d, _, lead in rows]
    if len(rows) == 2:
        n, r = common(*left), common(*right)
        pairs = [(0, 1, n, r)] if n + r >= report else []
    else:
        pairs = interval_repeats(right, left, report)
    for i, j, n, r in pairs:
        data, start, lead = rows[i]
        name = name_of(data[lead - n : lead + r])
        for k in (i, j):
            at = rows[k][1] + rows[k][2]
            yield k, at - n, at + r, name


def sorted_classes(rows: DataFrame, report: int) -> DataFrame:
    """(doc_id, text_key, start, end, name) from rows with `data` (the context's bytes), of classes of at most CLASS members."""
    ordered = rows.select("gram", "doc_id", "text_key", "start", "lead", "data").repartition("gram").sortWithinPartitions("gram", "doc_id", "text_key", "start")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple], out: list[tuple]) -> None:
            if len(group) > 1:
                for k, s, e, name in class_spans([g[2:] for g in group], report):
                    out.append((*group[k][:2], s, e, name))

        now, group, kind, place = None, [], pa.string(), None
        for b in batches:
            out: list[tuple] = []
            kind = b.schema.field("doc_id").type
            cols = [b.column(c).to_pylist() for c in ("gram", "doc_id", "text_key", "data", "start", "lead")]
            for g, *row in zip(*cols):
                if g != now:
                    settle(group, out)
                    now, group, place = g, [], None
                if place != (row[0], row[1], row[3]):  # repeated rows stand for one place
                    group.append(tuple(row))
                    place = row[0], row[1], row[3]
            yield _span_batch(out, kind)
        last: list[tuple] = []
        settle(group, last)
        if last:
            yield _span_batch(last, kind)

    return small_batches(ordered).mapInArrow(run, f"doc_id {id_type}, text_key long, {_SPAN}")


def _span_batch(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = (id_kind, *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "text_key", "start", "end", "name"])


def finer(rows: DataFrame, cell: int, report: int, length: int) -> DataFrame:
    """Cuts the windows of each row at multiples of `cell` from its anchor. What all windows of a cell share joins the
    class key, so that a finer class holds only places that agree on it."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, out = [], []
            cols = [b.column(c).to_pylist() for c in ("gram", "data", "start", "lead", "span")]
            for k, (g, data, start, lead, span) in enumerate(zip(*cols)):
                for c in range(-lead // cell, (span - lead) // cell + 1):
                    lo, hi = c * cell, c * cell + cell - 1  # window starts of the cell, from the anchor
                    u, v = max(lo, -lead), min(hi, span - lead)
                    key = xxh3_64_intdigest(data[lead + hi : lead + lo + report], g + c & (1 << 64) - 1)
                    part = data[lead + u : lead + v + length]
                    out.append((key - (1 << 64) if key >> 63 else key, name_of(part), start + lead + u, -u, v - u, len(part)))
                    of.append(k)
            new = [pa.array(np.array([r[i] for r in out], t)) for i, t in enumerate(_KINDS)]
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_key").take(at), *new], ["doc_id", "text_key", *_NAMES])

    return small_batches(rows).mapInArrow(run, f"doc_id {id_type}, text_key long, {_ROW}")


def _with_data(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(doc_id, text_key, gram, start, lead, span, size, big) with `data`, the bytes of each row's context, cut as tasks read the texts."""
    r = rows.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct("gram", "start", "lead", "span", "size", "big")).alias("list"))
    d = docs.join(r, docs["doc_id"].eqNullSafe(r["__id"]) & (docs["text_key"] == r["__key"])).select("doc_id", "text_key", "text", "list")
    names, kinds = ["gram", "start", "lead", "span", "big"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, of: list[int], rows: list[dict], data: list[bytes]) -> pa.RecordBatch:
            at = pa.array(of, pa.int64())
            cols = [pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)]
            return pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_key").take(at), *cols, pa.array(data, pa.binary())], ["doc_id", "text_key", *names, "data"])

        for b in batches:
            of, rows_, data, held = [], [], [], 0
            for k, (t, places) in enumerate(zip(b.column("text"), b.column("list"))):
                raw = t.as_py().encode()
                for x in places:
                    p = x.as_py()
                    of.append(k)
                    rows_.append(p)
                    data.append(raw[p["start"] : p["start"] + p["size"]])
                    held += p["size"]
                    if held >= EMIT:
                        yield out(b, of, rows_, data)
                        of, rows_, data, held = [], [], [], 0
            yield out(b, of, rows_, data)

    return small_batches(d).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, gram long, start long, lead int, span int, big boolean, data binary")


def _settled(docs: DataFrame, found: DataFrame, report: int, length: int, cells: tuple[int, ...]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans of the anchor rows, and the scratch tables that they are read from."""
    found = materialize(found, "anchors")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed"))
    grams = materialize(grams, "grams")  # a table of its own, so that a hot gram's rows are a join key that Spark can split
    again = materialize(found.join(grams, "gram"), "again")
    discard(found)
    discard(grams)
    whole = ["doc_id", "text_key", "start", (F.col("start") + F.col("size")).alias("end"), F.col("ctx").alias("name")]
    out = [again.filter("NOT mixed").select(*whole)]
    mixed = again.filter("mixed")
    place = F.struct("doc_id", "text_key", "start", "lead", "span", "size")
    contexts = materialize(mixed.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("place")), "contexts")
    out.append(mixed.join(contexts.filter("n > 1").select("gram", "ctx"), ["gram", "ctx"]).select(*whole))
    classes = materialize(contexts.groupBy("gram").agg(F.count("*").alias("members")), "classes")
    rows = contexts.join(classes, "gram").select("gram", "place.*", (F.col("members") > CLASS).alias("big"))
    if not cells:
        # a class is one window of `report` bytes by now: all its members repeat that window, and contexts say the rest
        out.append(mixed.select("doc_id", "text_key", "start", (F.col("start") + report).alias("end"), F.col("gram").alias("name")))
        return out, [again, contexts, classes]
    data = materialize(_with_data(docs, rows), "contexts-data")
    out.append(sorted_classes(data.filter("NOT big"), report))
    tables = [again, contexts, classes, data]
    if not data.filter("big").isEmpty():
        more, kept = _settled(docs, finer(data.filter("big"), cells[0], report, length), report, length, cells[1:])
        out, tables = out + more, tables + kept
    return out, tables


def repeats(docs: DataFrame, report: int = REPORT, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, start, end, name) of docs (doc_id, text_key, text): pieces of repeated byte strings, of `report` bytes or more. The union of the spans is every byte covered by a string of `report` bytes that also starts anywhere else;
    that of the spans of `length` or more is the same for `length`. Rows of a name hold one string."""
    parts, tables = _settled(docs, anchors(docs, report, length, gram), report, length, CELLS)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = materialize(every.distinct(), "repeats")
    for t in tables:
        discard(t)
    return every


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, report: int = REPORT, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_repeats, repeated_bytes): one row per row of docs. Bytes covered by repeats of `length`
    go; n_repeats counts the maximal runs of bytes that repeats of `report` or more cover, repeated_bytes their bytes. kept is binary, as a cut may fall inside a
    character. A null text counts as empty; texts shorter than `report` stay whole; repeated rows repeat each other and
    lose all their bytes if they have `length`. An empty table gives an empty result, and columns other than id and text are not read.
    A very long text is hashed CHUNK bytes at a time, and its contexts leave a task EMIT bytes at a time."""
    if report > length:
        raise ValueError("report must not exceed length")
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeats(d, report, length, gram)
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    both = d.join(spans, d["doc_id"].eqNullSafe(spans["__id"]) & (d["text_key"] == spans["__key"]), "left").select("doc_id", "text", "spans")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeats", "repeated_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = []
                for t, spans_ in zip(part.column("text"), part.column("spans")):
                    raw, places = t.as_py().encode(), [(x["start"], x["end"]) for x in spans_.as_py() or ()]
                    gone, seen = _merged([x for x in places if x[1] - x[0] >= length]), _merged(places)
                    edges = [0, *(x for m in gone for x in m), len(raw)]
                    kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    rows.append((len(raw), len(raw) - len(kept), len(gone), kept, len(seen), sum(e - s for s, e in seen)))
                new = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *new], names)

    return small_batches(both).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, n_repeats long, repeated_bytes long")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeats, repeated_bytes for every row of documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeats", "repeated_bytes")
