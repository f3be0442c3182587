"""Groups of maximal repeats with all their occurrences: a common-prefix interval tree with left-extension diversity.

A maximal repeat is a string that occurs at two places at least, that does not go on alike to the right at all of them, nor to the
left. All its occurrences begin with the same window of `report` bytes, and not all of those windows have the same byte before them. So only windows
of which that holds start suffixes: anchored classes (suffix_dedup) name the candidates, and the bytes before them decide. A suffix ends where repeated text
ends, so it is as long as it has to be, however long the repeat. The suffixes of a window are sorted; a stack scan of their common prefixes walks the
interval tree, and an interval whose members differ in the byte before them is a group. Suffixes that are equal stand for each other in the scan, which keeps one
suffix and the open intervals in memory, and get their places back by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from scenetables.llm import suffix_dedup as sd
from scenetables.llm.common import discard, materialize, small_batches, text_key

#: What comes before a place where a text starts, from which no other place goes on alike to the left; other values are the byte before.
_START = -1
_SUFFIX = "w long, before int, at long, data binary"
_SCANNED = "w long, ord long, digest long, name long, n_bytes long, last long"


def class_starts(rows: list[tuple], report: int) -> Iterator[tuple[int, int]]:
    """(row, start) of the windows of a class that may start a maximal repeat; rows are (data, start, lead, span). Where two places go apart to the
    left, the window that begins there is one, in each row that has it."""
    right = [d[lead:] for d, _, lead, _ in rows]
    left = [d[:lead][::-1] for d, _, lead, _ in rows]
    if len(rows) == 2:
        n, r = sd.common(*left), sd.common(*right)
        pairs = [(0, 1, n, r)] if n + r >= report else []
    else:
        pairs = sd.interval_repeats(right, left, report)
    wanted: dict[int, set[int]] = {}

    def window(k: int, n: int) -> int | None:
        """The window that begins n bytes before the anchor, if this row has it."""
        data, _, lead, span = rows[k]
        return xxh3_64_intdigest(data[lead - n : lead - n + report]) if lead - span <= n <= lead else None

    for i, _, n, _ in pairs:
        w = window(i, n)
        if w is not None:
            wanted.setdefault(n, set()).add(w)
    for k, (_, start, lead, _) in enumerate(rows):
        for n, windows in wanted.items():
            if window(k, n) in windows:
                yield k, start + lead - n


def _sorted_starts(rows: DataFrame, report: int) -> DataFrame:
    """(doc_id, text_key, anchor, at) from rows with `data` of classes of at most CLASS members."""
    ordered = rows.select("gram", "doc_id", "text_key", "start", "lead", "span", "data").repartition("gram").sortWithinPartitions("gram")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(group: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            found = [(*group[k][:2], group[k][3] + group[k][4], at) for k, at in class_starts([g[2:] for g in group], report)] if len(group) > 1 else []
            kinds = (kind, pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["doc_id", "text_key", "anchor", "at"])

        now, group, kind = None, [], pa.string()
        for b in batches:
            kind = b.schema.field("doc_id").type
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "doc_id", "text_key", "data", "start", "lead", "span"))):
                if g != now:
                    yield settled(group, kind)
                    now, group = g, []
                group.append(tuple(row))
        yield settled(group, kind)

    return small_batches(ordered).mapInArrow(run, f"doc_id {id_type}, text_key long, anchor long, at long")


def _starts(docs: DataFrame, found: DataFrame, report: int, length: int, cells: tuple[int, ...]) -> DataFrame:
    """(doc_id, text_key, anchor, at): the windows that may start a maximal repeat, of the anchor rows `found`."""
    found = materialize(found, "anchors")
    grams = materialize(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")
    again = materialize(found.join(grams, "gram").withColumn("anchor", F.col("start") + F.col("lead")).distinct(), "again")
    first = ["doc_id", "text_key", "anchor", F.col("start").alias("at")]
    place = F.struct("doc_id", "text_key", "start", "lead", "span", "size")
    contexts = materialize(again.groupBy("gram", "ctx", "mixed").agg(F.count("*").alias("n"), F.min(place).alias("place")), "contexts")
    # places of one context go apart before it, if at all in this row
    alike = again.join(contexts.filter("n > 1").select("gram", "ctx"), ["gram", "ctx"]).select(*first)
    mixed = again.filter("mixed")
    if not cells:
        return alike.unionByName(mixed.select(*first)).distinct()
    classes = materialize(contexts.filter("mixed").groupBy("gram").agg(F.count("*").alias("members")), "classes")
    rows = contexts.join(classes, "gram").select("gram", "place.*", (F.col("members") > sd.CLASS).alias("big"))
    data = materialize(sd._with_data(docs, rows), "contexts-data")
    starts = _sorted_starts(data.filter("NOT big"), report)
    if not data.filter("big").isEmpty():
        starts = starts.unionByName(_starts(docs, sd.finer(data.filter("big"), cells[0], report, length), report, length, cells[1:]))
    starts = materialize(starts, "starts")
    # the places of a context have the starts of the one that stood for them
    of = contexts.filter("mixed").select("gram", "ctx", F.col("place.doc_id").alias("__id"), F.col("place.text_key").alias("__key"), F.col("place.start").alias("__start"), F.col("place.span").alias("__span"), (F.col("place.start") + F.col("place.lead")).alias("__anchor"))
    same = starts["doc_id"].eqNullSafe(of["__id"]) & (starts["text_key"] == of["__key"]) & (starts["anchor"] == of["__anchor"])
    back = starts.join(of, same & starts["at"].between(of["__start"], of["__start"] + of["__span"])).select("gram", "ctx", (F.col("anchor") - F.col("at")).alias("l")).distinct()
    all_places = mixed.join(back, ["gram", "ctx"]).select("doc_id", "text_key", "anchor", (F.col("anchor") - F.col("l")).alias("at"))
    out = materialize(alike.unionByName(all_places).distinct(), "candidates")
    for t in (found, grams, again, contexts, classes, data, starts):
        discard(t)
    return out


def _by_text(docs: DataFrame, places: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """docs with the places (doc_id, text_key, at) of each text as an array, and the spans (start, end) of its repeats."""
    id_, key = F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")
    out = docs.select("doc_id", "text_key", "text")
    for rows, name, item in ((places, "places", F.col("at")), (spans, "spans", F.struct("start", "end"))):
        if rows is not None:
            r = rows.groupBy(id_, key).agg(F.collect_set(item).alias(name))
            out = out.join(r, out["doc_id"].eqNullSafe(r["__id"]) & (out["text_key"] == r["__key"])).drop("__id", "__key")
    return out.dropDuplicates(["doc_id", "text_key"])


def _suffixes(texts: DataFrame, report: int, whole: bool) -> DataFrame:
    """(doc_id, text_key, w, before, at, data) of the places of texts: the digest of the window, the byte before it, and, if whole, the
    suffix up to where the repeated run around it ends."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["w", "before", "at", "data"], (pa.int64(), pa.int32(), pa.int64(), pa.binary())

        def out(b: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            at = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_key").take(at), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "text_key", *names])

        for b in batches:
            of, rows, held = [], [], 0
            for k, (t, places) in enumerate(zip(b.column("text"), b.column("places"))):
                raw = t.as_py().encode()
                runs = sd._merged([(x["start"], x["end"]) for x in b.column("spans")[k].as_py()]) if whole else []
                j = 0
                for p in sorted(places.as_py()):
                    data = None
                    if whole:
                        while runs[j][1] <= p:
                            j += 1
                        data = raw[p : runs[j][1]]
                        held += len(data)
                    of.append(k)
                    rows.append((sd.name_of(raw[p : p + report]), raw[p - 1] if p else _START, p, data))
                    if held >= sd.EMIT:
                        yield out(b, of, rows)
                        of, rows, held = [], [], 0
            yield out(b, of, rows)

    return small_batches(texts).mapInArrow(run, f"doc_id {id_type}, text_key long, {_SUFFIX}")


class IntervalScan:
    """The stack scan over the sorted suffixes of a window. Intervals of the tree come out when they close, if the bytes before their members differ."""

    def __init__(self, report: int):
        self.report, self.stack, self.now, self.n = report, [], None, 0

    @staticmethod
    def _apart(low: int, high: int) -> bool:
        """Whether places with these least and largest bytes before them, two places at least, do not all go on alike to the left."""
        return low != high or high == _START

    def _step(self, follows: int) -> Iterator[tuple[int, int, int]]:
        """Ends the last suffix, given how much of it the next one shares (-1: none follows)."""
        data, low, high, many = self.now
        node, end = [len(data), self.n - 1, low, high], self.n - 1
        if many and self._apart(low, high) and follows < len(data):
            yield end, end, len(data)
        while self.stack and self.stack[-1][0] > follows:
            top = self.stack.pop()
            node = [top[0], top[1], min(top[2], node[2]), max(top[3], node[3])]
            if self._apart(*node[2:]) and node[0] >= self.report:
                yield node[1], end, node[0]
        if follows >= 0:
            if self.stack and self.stack[-1][0] == follows:
                self.stack[-1][2:] = [min(self.stack[-1][2], node[2]), max(self.stack[-1][3], node[3])]
            else:
                self.stack.append([follows, *node[1:]])

    def add(self, data: bytes, low: int, high: int, many: bool) -> Iterator[tuple[int, int, int, int]]:
        """(first, last, length, name) of the intervals that end before this suffix. low and high: the least and the largest byte before it, at its places."""
        if self.now is not None:
            before = self.now[0]
            for first, last, n in self._step(sd.common(before, data)):
                yield first, last, n, sd.name_of(before[:n])
        self.now, self.n = (data, low, high, many), self.n + 1

    def close(self) -> Iterator[tuple[int, int, int, int]]:
        for first, last, n in self._step(-1):
            yield first, last, n, sd.name_of(self.now[0][:n])


def _scanned(leaves: DataFrame, report: int) -> DataFrame:
    """Two kinds of rows: suffixes (w, ord, digest), numbered in their order within a window, and groups (w, ord, last, name, n_bytes) of those from ord to last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64()] * 6, [x.split()[0] for x in _SCANNED.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        now, scan = None, None
        for b in batches:
            out: list[tuple] = []
            group = lambda w, found: [(w, first, None, name, n, last) for first, last, n, name in found]
            for w, digest, data, low, high, n in zip(*(b.column(c).to_pylist() for c in ("w", "digest", "data", "low", "high", "n"))):
                if w != now:
                    if scan:
                        out += group(now, scan.close())
                    now, scan = w, IntervalScan(report)
                out += group(w, scan.add(data, low, high, n > 1))
                out.append((w, scan.n - 1, digest, None, None, None))
            yield batch(out)
        if scan:
            yield batch([(now, first, None, name, n, last) for first, last, n, name in scan.close()])

    return small_batches(leaves.repartition("w").sortWithinPartitions("w", "data")).mapInArrow(run, _SCANNED)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: int = sd.REPORT, gram: int = sd.GRAM) -> DataFrame:
    """(name, n_bytes, occurrences, doc_id, start): one row per occurrence of each group, a group for each maximal repeat of `report` bytes or more. The name is a
    hash of the repeated bytes.

    A null text counts as empty; rows of equal id and text are one place; an empty table gives an empty result; columns other than id and text are not read. Very
    long texts are hashed in chunks. As groups nest, a place comes once for each group that it is in."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    length = report + sd.GRAM
    spans = sd.repeats(d, report, length, gram)
    starts = materialize(_starts(d, sd.anchors(d, report, length, gram), report, length, sd.CELLS).select("doc_id", "text_key", "at").distinct(), "starts")
    before = materialize(_suffixes(_by_text(d, starts), report, False).drop("data"), "windows")
    apart = before.groupBy("w").agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count("*").alias("n")).filter(f"lo <> hi OR hi = {_START} AND n > 1").select("w")
    chosen = before.join(apart, "w").select("doc_id", "text_key", "at")
    members = materialize(_suffixes(_by_text(d, chosen, spans), report, True).withColumn("digest", F.xxhash64("data")), "suffixes")
    leaves = members.groupBy("w", "digest").agg(F.min("data").alias("data"), F.min("before").alias("low"), F.max("before").alias("high"), F.count("*").alias("n"))
    tree = materialize(_scanned(leaves, report), "tree")
    for t in (spans, starts, before):
        discard(t)
    groups = tree.filter("digest IS NULL").select("w", "name", "n_bytes", F.explode(F.expr("sequence(ord, last)")).alias("ord"))
    places = groups.join(tree.filter("digest IS NOT NULL").select("w", "ord", "digest"), ["w", "ord"]).join(members.select("w", "digest", "doc_id", F.col("at").alias("start")), ["w", "digest"])
    sizes = places.groupBy("name", "n_bytes").agg(F.count("*").alias("occurrences"))
    return places.join(sizes, ["name", "n_bytes"]).select("name", "n_bytes", "occurrences", "doc_id", "start")
