"""Deterministic inputs: channels, binary logs, documents and containers."""

import struct

HEADER = struct.Struct("<4sB16s6sqIIBHBB")


def samples(spark, channels, rate=10.0, session="s0"):
    """Long samples from {name: [values]}."""
    rows = [(session, name, i, i / rate if rate else float(i), float(v)) for name, values in channels.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_id string, channel_id string, idx long, t double, value double")


def make_log(records, registry=(), start_ms=1000, imu_rate=800, gps_rate=5, mask=0x3F, version=3, session=bytes(range(16)), end=True):
    out = HEADER.pack(b"IDL0", version, session, b"\x01\x02\x03\x04\x05\x06", start_ms, 0xABCD, mask, 1, imu_rate, gps_rate, len(registry))
    for i, kind, rate, scale, offset, name, units in registry:
        out += struct.pack("<BBHff20s8s", i, kind, rate, scale, offset, name.encode(), units.encode())
    out += struct.pack("<I", 0xDEADBEEF)
    for kind, payload in records:
        out += struct.pack("<BH", kind, len(payload)) + payload
    return out + (struct.pack("<BH", 0xFF, 0) if end else b"")


def imu(unit, ts, axes):
    return 1, struct.pack(f"<Bq{len(axes)}h", unit, ts, *axes)


def gps(epoch, ts, lat, lon, speed=0):
    return 2, struct.pack("<qqiihHHBB", epoch, ts, lat, lon, 100, speed, 9000, 1, 8)


def value(i, ts, form, v):
    return 3, struct.pack("<Bq" + form, i, ts, v)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def klv(key, kind, size, body):
    n = len(body) // size if size else 0
    return struct.pack(">4scBH", key, kind, size, n) + body + b"\0" * (-len(body) % 4)


def make_gpmf(fixes, when=b"240102030405.500"):
    gps5 = b"".join(struct.pack(">5i", *f) for f in fixes)
    stream = klv(b"GPSU", b"U", 16, when) + klv(b"SCAL", b"l", 4, struct.pack(">5i", 10000000, 10000000, 1000, 1000, 100)) + klv(b"GPS5", b"l", 20, gps5)
    inner = klv(b"STRM", b"\0", 1, stream)
    return klv(b"DEVC", b"\0", 1, inner)


def make_mp4(payloads, fps=30, frames=60, width=640, height=360, created=3_000_000_000):
    """A container with one video track and one telemetry track of a payload a second."""
    ftyp = box(b"ftyp", b"mp42")
    mdat_at = len(ftyp) + 8
    mdat = box(b"mdat", b"".join(payloads))
    offsets, at = [], mdat_at
    for p in payloads:
        offsets.append(at)
        at += len(p)

    def track(handler, codec, scale, length, stts, stsc, sizes, offsets_, w=0, h=0):
        full = b"\0\0\0\0"
        tkhd = box(b"tkhd", full + b"\0" * 72 + struct.pack(">II", w << 16, h << 16))
        mdhd = box(b"mdhd", full + struct.pack(">IIII", 0, 0, scale, length))
        hdlr = box(b"hdlr", full + b"\0" * 4 + handler + b"\0" * 12)
        stsd = box(b"stsd", full + struct.pack(">I", 1) + struct.pack(">I4s", 16, codec) + b"\0" * 8)
        table = lambda k, rows, form: box(k, full + struct.pack(">I", len(rows)) + b"".join(struct.pack(form, *r) for r in rows))
        stsz = box(b"stsz", full + struct.pack(">II", 0, len(sizes)) + b"".join(struct.pack(">I", s) for s in sizes))
        stbl = box(b"stbl", stsd + table(b"stts", stts, ">II") + table(b"stsc", stsc, ">III") + stsz + table(b"stco", [(o,) for o in offsets_], ">I"))
        return box(b"trak", tkhd + box(b"mdia", mdhd + hdlr + box(b"minf", stbl)))

    mvhd = box(b"mvhd", b"\0\0\0\0" + struct.pack(">IIII", created, 0, 1000, frames * 1000 // fps))
    video = track(b"vide", b"avc1", fps, frames, [(frames, 1)], [(1, frames, 1)], [0] * frames, [0], width, height)
    meta = track(b"meta", b"gpmd", 1000, 1000 * len(payloads), [(len(payloads), 1000)], [(1, 1, 1)], [len(p) for p in payloads], offsets)
    return ftyp + mdat + box(b"moov", mvhd + video + meta)
