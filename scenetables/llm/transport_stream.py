"""MPEG transport streams as a binary column.

mux() stores bytes as one private elementary stream: program association and map tables, then one timed packet (PES)
for each access unit, cut into 188-byte transport packets with continuity counters, clock references and a
random-access flag at the start of each unit. demux() reads any stream of 188-byte packets: it parses the tables of all programs, checks the counters,
reassembles the elementary packets of every stream, and indexes them: timestamps, and whether reading may start there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import small_batches, table

PACKET = 188
SYNC = 0x47
PMT_PID, ES_PID = 0x1000, 0x100
PRIVATE_STREAM, STREAM_TYPE = 0xBD, 0x06
UNIT = 8192  # payload bytes of an access unit
TABLES_EVERY = 16  # access units between repeats of the tables
TICKS = 3600  # of the 90 kHz clock, 25 units a second
PAD = 64


def _crc_row(byte: int) -> int:
    crc = byte << 24
    for _ in range(8):
        crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


_CRC = [_crc_row(byte) for byte in range(256)]


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload (not empty)."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        if k % TABLES_EVERY == 0:
            out += [_table_packet(0, _PAT, k // TABLES_EVERY), _table_packet(PMT_PID, _PMT, k // TABLES_EVERY)]
        unit, pts = payload[at : at + UNIT], TICKS * k & (1 << 33) - 1
        pes = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit, np.uint8)
        first = min(len(pes), PACKET - 4 - 8)
        full, rest = divmod(len(pes) - first, PACKET - 4)
        n = 1 + full + (rest > 0)
        p = np.full((n, PACKET), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        p[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        p[0, 4] = PACKET - 5 - first  # adaptation field: random access and clock reference, then stuffing
        p[0, 5] = 0x50
        p[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        p[0, PACKET - first :] = pes[:first]
        p[1 : 1 + full, 4:] = pes[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if rest:
            p[-1, 3] |= 0x20
            p[-1, 4] = PACKET - 5 - rest
            if rest < PACKET - 5:
                p[-1, 5] = 0
            p[-1, PACKET - rest :] = pes[len(pes) - rest :]
        out.append(p.tobytes())
    return b"".join(out)


class Unit(NamedTuple):
    """An elementary packet."""

    pid: int
    packet: int  # number of the transport packet that it begins in
    pts: int | None
    dts: int | None
    entry: bool  # whether the random-access indicator stands there
    data: bytes


class Stream(NamedTuple):
    packets: int
    pids: list[int]
    programs: dict[int, dict[int, int]]  # program number -> PID -> stream type
    continuity_errors: int
    units: list[Unit]  # by PID, then in order

    def payload(self, pid: int | None = None) -> bytes:
        """The data of one stream, or of all."""
        return b"".join(u.data for u in self.units if pid in (None, u.pid))


#: Without a header after the length.
_PLAIN = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
_PADDING, _NULL = 0xBE, 0x1FFF


def _clock(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _payloads(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one PID's packets, in order: those that carry new payload, where it starts, and how many jumps the counters show.

    Packets without payload do not count; a packet may be sent twice; an announced discontinuity is no error."""
    adapted, field = q[:, 3] & 0x20 > 0, q[:, 4].astype(np.int64)
    offset = np.where(adapted, 5 + field, 4)
    flagged = adapted & (field > 0) & (q[:, 5] & 0x80 > 0)
    at = np.flatnonzero((q[:, 3] & 0x10 > 0) & (offset < PACKET))
    if not len(at):
        return at, offset[at], 0
    step = q[at[1:], 3].astype(np.int64) - q[at[:-1], 3] & 15
    again = np.flatnonzero(step == 0)
    twice = [k for k in again.tolist() if (q[at[k], 4:] == q[at[k + 1], 4:]).all() and not (k and step[k - 1] == 0)] if len(again) else []
    bad = (step != 1) & ~flagged[at[1:]]
    bad[twice] = False
    keep = np.ones(len(at), bool)
    keep[np.array(twice, np.int64) + 1] = False
    return at[keep], offset[at[keep]], int(bad.sum())


def _bytes(q: np.ndarray, at: np.ndarray, offset: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payloads of packets in a row, and where each begins."""
    data = q[at][np.arange(PACKET) >= offset[:, None]].tobytes()
    return data, np.concatenate([[0], np.cumsum(PACKET - offset)])


def _sections(q: np.ndarray) -> Iterator[bytes]:
    """The checked sections of a table's PID. One may go over several packets, and a packet may hold several; the pointer at the start of
    a packet says how many bytes still belong to the section before."""
    at, offset, _ = _payloads(q)
    data, starts = _bytes(q, at, offset)
    begins = starts[:-1][q[at, 1] & 0x40 > 0].tolist()
    for i, k in enumerate(begins):
        rest = data[k + 1 + data[k] :]
        if i + 1 < len(begins):
            j = begins[i + 1]
            rest = data[k + 1 + data[k] : j] + data[j + 1 : j + 1 + data[j]]
        while len(rest) > 2 and rest[0] != 0xFF:
            size = 3 + (int.from_bytes(rest[1:3], "big") & 0xFFF)
            if len(rest) < size:  # the stream ends within
                break
            if crc32_mpeg(rest[:size]):
                raise ValueError("damaged program table")
            yield rest[:size]
            rest = rest[size:]


def _programs(p: np.ndarray, pid: np.ndarray) -> dict[int, dict[int, int]]:
    """Program number -> PID -> stream type, by the association table and the map table of each program."""
    maps, out = {}, {}
    for s in _sections(p[pid == 0]):
        for i in range(8, len(s) - 4, 4):
            number = int.from_bytes(s[i : i + 2], "big")
            if s[0] == 0 and number:
                maps.setdefault(number, int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF)
    for number, of in maps.items():
        for s in _sections(p[pid == of]):
            if s[0] != 2 or int.from_bytes(s[3:5], "big") != number:
                continue
            at, streams = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF), {}
            while at < len(s) - 4:
                streams[int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF] = s[at]
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
            out.setdefault(number, streams)
    return out


def _units(q: np.ndarray, numbers: np.ndarray, pid: int, at: np.ndarray, offset: np.ndarray) -> Iterator[Unit]:
    data, starts = _bytes(q, at, offset)
    begins = np.flatnonzero(q[at, 1] & 0x40).tolist()
    for i, k in enumerate(begins):
        u = data[starts[k] : starts[begins[i + 1]] if i + 1 < len(begins) else len(data)]
        length = int.from_bytes(u[4:6], "big")
        if u[:3] != b"\x00\x00\x01" or len(u) < 6 + length:
            raise ValueError("damaged elementary packet")
        if length:  # 0: as far as the next one
            u = u[: 6 + length]
        if u[3] == _PADDING:
            continue
        row = q[at[k]]
        entry = bool(row[3] & 0x20 and row[4] and row[5] & 0x40)
        if u[3] in _PLAIN:
            yield Unit(pid, int(numbers[at[k]]), None, None, entry, u[6:])
        else:
            pts = _clock(u[9:14]) if u[7] & 0x80 else None
            dts = _clock(u[14:19]) if u[7] & 0xC0 == 0xC0 else None
            yield Unit(pid, int(numbers[at[k]]), pts, dts, entry, u[9 + u[8] :])


def demux(media: bytes) -> Stream:
    """Tables, counters and elementary packets of a transport stream. A damaged stream is an error; jumps of the counters are counted."""
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    programs = _programs(p, pid)
    streams = sorted({x for s in programs.values() for x in s})
    errors, units = 0, []
    pids = np.unique(pid).tolist()
    for x in pids:
        if x == _NULL:  # stuffing without a counter
            continue
        numbers = np.flatnonzero(pid == x)
        q = p[numbers]
        at, offset, bad = _payloads(q)
        errors += bad
        if x in streams and len(at):
            units += _units(q, numbers, x, at, offset)
    return Stream(len(p), pids, programs, errors, units)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\0")


def transport_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a stream, one row per row of docs, repeated rows too. A null text counts as empty, and an empty one is PAD zero
    bytes. An empty table gives an empty result; a very long text is one value of media, some 3 % longer. Only the id and the text are read, so other columns may have any names."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # some MB of media at a time
                part = b.slice(at, 256)
                rows = [padded(t.as_py()) for t in part.column("text")]
                media = pa.array([mux(x) for _, x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pid:int,packet:long,pts:long,entry:boolean>>"


def stream_features(streams: DataFrame) -> DataFrame:
    """Reads the column media back: its other columns stay, but for those of an added name, which are replaced, and payload digests, a feature string and units (PID, packet number, timestamp and
    whether reading may start there, of each elementary packet) are added. Streams that demux() refuses, and null ones, are errors."""
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    kept = [f for f in streams.schema.fields if f.name not in ("media", *names)]
    unit = pa.list_(pa.struct([("pid", pa.int32()), ("packet", pa.int64()), ("pts", pa.int64()), ("entry", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("media"):
                media = m.as_py()
                s = demux(media)
                payload, stamps, entries = s.payload(), [u.pts for u in s.units if u.pts is not None], [u.packet for u in s.units if u.entry]
                ends = lambda x: f"{x[0]}-{x[-1]}" if x else ""
                text = f"packets={s.packets};pids={'/'.join(map(str, s.pids))};units={len(s.units)};errors={s.continuity_errors};pts={ends(stamps)};entry={len(entries)}@{ends(entries)}"
                index = [{"pid": u.pid, "packet": u.packet, "pts": u.pts, "entry": u.entry} for u in s.units]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), text, index))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), unit)
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], [*(f.name for f in kept), *names])

    return small_batches(streams).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _FEATURES]))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and units (the index of timestamps and
    random-access points) for every row of documents."""
    return stream_features(transport_streams(table(spark, sf_dir, "documents")))
