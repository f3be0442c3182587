import hashlib
import random
import zlib

import pytest

from scenetables.llm import transport_stream as ts


def plain(media, pid):
    """An independent reader, packet by packet: (payload of one stream, its timestamps, packets with the random-access indicator)."""
    out, stamps, entries, left, size = b"", [], [], 0, 0
    for k in range(0, len(media), 188):
        p = media[k : k + 188]
        if (p[1] & 0x1F) << 8 | p[2] != pid or not p[3] & 0x10:
            continue
        body = p[4:]
        if p[3] & 0x20:
            if p[4] and p[5] & 0x40:
                entries.append(k // 188)
            body = p[5 + p[4] :]
        if p[1] & 0x40:
            assert body[:3] == b"\0\0\1" and left == 0
            size = int.from_bytes(body[4:6], "big")
            c = body[9:14]
            stamps.append(int(f"{c[0] >> 1 & 7:03b}{c[1]:08b}{c[2] >> 1:07b}{c[3]:08b}{c[4] >> 1:07b}", 2))
            left = size - 3 - body[8]
            body = body[9 + body[8] :]
        out += body
        left -= len(body)
    assert left == 0
    return out, stamps, entries


def test_round_trip_of_many_lengths():
    rng = random.Random(3)
    for n in [64, 128, 183, 184, 185, 162, 161, 163, 346, 345, 347, 8191, 8192, 8193, 16 * 8192 + 5, *(rng.randrange(1, 40_000) for _ in range(60))]:
        data = rng.randbytes(n)
        media = ts.mux(data)
        s = ts.demux(media)
        stamps = [u.pts for u in s.units]
        assert len(media) % 188 == 0 and s.payload() == data and s.continuity_errors == 0
        assert s.pids == [0, 0x100, 0x1000] and stamps == [3600 * k for k in range(-(-n // 8192))] and s.programs == {1: {0x100: 6}}
        assert all(u.entry for u in s.units)
        assert plain(media, 0x100) == (data, stamps, [u.packet for u in s.units])


def packet(pid, counter, payload=b"", start=False, flags=None):
    """A packet with an adaptation field where flags or stuffing ask for one."""
    control = (0x10 if payload else 0) | (0x20 if flags is not None or len(payload) < 184 else 0)
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, control | counter & 15])
    if control & 0x20:
        n = 184 - len(payload) - 1
        field = bytes([flags or 0]) + b"\xff" * (n - 1) if n else b""
        head += bytes([n]) + field
    assert len(head + payload) == 188
    return head + payload


def pes(data, pts=None, stream=0xE0, length=None):
    stamp = b"" if pts is None else ts._stamp(pts)
    body = bytes([0x80, 0x80 if pts is not None else 0, len(stamp)]) + stamp + data
    return b"\0\0\1" + bytes([stream]) + (len(body) if length is None else length).to_bytes(2, "big") + body


def table(pid, counter, section):
    return packet(pid, counter, (b"\0" + section).ljust(184, b"\xff"), True)


def tables(programs):
    """Association table and a map table for each program {number: (PID, {PID: type})}; long ones go over packets."""
    out = table(0, 0, ts._section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, (pid, _) in {0: (0x10, {}), **programs}.items())))
    for n, (pid, streams) in programs.items():
        first = min(streams)
        body = (0xE000 | first).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([t]) + (0xE000 | x).to_bytes(2, "big") + b"\xf0\x02\x52\x00" for x, t in streams.items())
        section = b"\0" + ts._section(2, n, body)
        parts = [section[i : i + 184] for i in range(0, len(section), 184)]
        for i, part in enumerate(parts):
            out += packet(pid, i, part.ljust(184, b"\xff"), i == 0)
    return out


def test_streams_as_the_standard_has_them():
    """Two programs, a map table over two packets, stuffing, packets sent twice, packets without payload, units without a length or a
    timestamp, padding units, and an announced jump of the counter."""
    rng = random.Random(9)
    a, b, c = rng.randbytes(160), rng.randbytes(150), rng.randbytes(500)
    programs = {1: (0x20, {0x31: 0x1B, 0x32: 0x0F}), 7: (0x21, {0x40 + k: 6 for k in range(40)})}
    null = packet(0x1FFF, 5, b"\xff" * 184)
    long = pes(c, 1 << 32 | 12345, length=0)
    media = tables(programs) + null
    media += packet(0x31, 14, pes(a, 90_000), True, 0x40)
    first = packet(0x31, 15, pes(b), True)
    media += first + first + null + null  # sent twice
    media += packet(0x31, 15, b"", flags=0x00)  # no payload: the counter stands
    media += packet(0x31, 0, long[:184], True) + packet(0x32, 3, pes(b"other", 7, stream=0xC0), True) + packet(0x31, 1, long[184:368]) + packet(0x31, 2, long[368:])
    media += packet(0x31, 3, pes(b"", stream=0xBE) + b"\xff" * 20, True)  # padding
    media += packet(0x31, 9, pes(a, 180_000), True, 0xC0)  # jump announced
    media += packet(0x41, 6, pes(b"private", stream=0xBF), True)
    s = ts.demux(media)
    assert s.continuity_errors == 0 and 0x1FFF in s.pids
    assert s.programs == {n: streams for n, (_, streams) in programs.items()}
    video = [u for u in s.units if u.pid == 0x31]
    assert [(u.pts, u.entry) for u in video] == [(90_000, True), (None, False), (1 << 32 | 12345, False), (180_000, True)]
    assert s.payload(0x31) == a + b + c + a and s.payload(0x32) == b"other"
    assert [u.packet for u in video] == sorted(u.packet for u in video)
    assert len(s.payload(0x41)) == len(pes(b"private")) - 6  # private stream 2 has no header of its own
    # a packet lost, without a word
    assert ts.demux(media.replace(packet(0x31, 9, pes(a, 180_000), True, 0xC0), packet(0x31, 9, pes(a, 180_000), True, 0x40))).continuity_errors == 1
    assert ts.demux(media.replace(null, b"")).units[0].data == a


def test_crc_by_bits():
    def bits(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    rng = random.Random(1)
    for n in (0, 1, 5, 100):
        d = rng.randbytes(n)
        assert ts.crc32_mpeg(d) == bits(d)


def test_a_long_text():
    """20 MB in one value."""
    data = random.Random(2).randbytes(20 << 20)
    s = ts.demux(ts.mux(data))
    assert s.payload() == data and len(s.units) == 2560 and s.continuity_errors == 0


def test_damage_is_seen():
    media = bytearray(ts.mux(random.Random(0).randbytes(20_000)))
    lost = bytes(media[: 188 * 10] + media[188 * 11 :])
    with pytest.raises(ValueError):
        ts.demux(lost)
    media[188 * 12 + 3] ^= 1
    assert ts.demux(bytes(media)).continuity_errors == 2
    assert ts.demux(media=ts.mux(b"a" * 64)).units[0].entry
    media[20] ^= 1
    with pytest.raises(ValueError):
        ts.demux(bytes(media))


def test_rows_nulls_and_clashing_columns(spark, documents, corpus_dir):
    d = documents([(1, None), (1, ""), (2, "é" * 40), (None, "x" * 100_000)])
    out = {(r.doc_id, r.n_bytes): r for r in ts.op6_transport_stream(spark, corpus_dir(documents=d)).collect()}
    assert len(out) == 3 and out[1, 0].payload_bytes == 64 and out[2, 80].payload_bytes == 128
    for (_, n), text in zip(((1, 0), (2, 80), (None, 100_000)), ("", "é" * 40, "x" * 100_000)):
        r, (size, payload) = out[_, n], ts.padded(text)
        assert (size, len(payload)) == (r.n_bytes, r.payload_bytes)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert [(u.pts, u.entry) for u in r.units] == [(3600 * k, True) for k in range(-(-len(payload) // 8192))]
        assert r.media_sha256 == hashlib.sha256(ts.mux(payload)).hexdigest()
    clash = d.withColumnRenamed("lang", "media").withColumnRenamed("source", "run")
    assert ts.stream_features(ts.transport_streams(clash)).count() == 4
    assert ts.stream_features(ts.transport_streams(d.limit(0))).count() == 0
    named = ts.transport_streams(d).selectExpr("*", "1 AS units", "'x' AS feature", "'y' AS extra")
    got = ts.stream_features(named)
    assert "extra" in got.columns and len(set(got.columns)) == len(got.columns) and all(r.units is not None for r in got.collect())
