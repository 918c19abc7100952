"""Binary motion logs: decoding of one file, and the DataFrame source over many.

Spark's binaryFile reader delivers whole files, so any file system that Spark reads will do. One file is one
recording; its records are framed in order by one task and come out as rows, and all that follows (slots, the
shared grid of inertial units, event times, session starts) is DataFrame work.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..model import SessionSet
from ..operators.blocked import dense_index
from ..operators.synthesis import distance, place_slots, rebuild_imu_grid, time_ramp
from ..storage import SharedTable

#: Fixed values of the format: magic, version, end of the registry, record types, GPS channels, unit axes.
MAGIC, VERSION, REGISTRY_END = b"IDL0", 3, 0xDEADBEEF
IMU, GPS, CHANNEL, END = 0x01, 0x02, 0x03, 0xFF
GPS_CHANNELS = ("GPS_EpochMs", "GPS_Latitude", "GPS_Longitude", "GPS_Altitude", "GPS_SpeedKmh", "GPS_Heading", "GPS_FixQuality", "GPS_Satellites")
AXES = ("AccelX", "AccelY", "AccelZ", "GyroX", "GyroY", "GyroZ")
_VALUE = ("<B", "<H", "<I", "<b", "<h", "<i", "<f", "<d")
_HEADER = struct.Struct("<4sB16s6sqIIBHBB")
_ENTRY = struct.Struct("<BBHff20s8s")


@dataclass(frozen=True)
class Entry:
    id: int
    data_type: int
    rate: int
    scale: float
    offset: float
    name: str
    units: str


@dataclass
class Header:
    session_id: str
    device_id: str
    start_ms: int
    checksum: str
    imu_mask: int
    imu_count: int
    imu_rate: int
    gps_rate: int
    registry: dict[int, Entry] = field(default_factory=dict)
    size: int = 0

    @property
    def period_us(self) -> int:
        return 1_000_000 // self.imu_rate if self.imu_rate > 0 else 10_000


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def read_header(data: bytes) -> Header:
    """Header and channel registry; wrong magic, an unknown version or a cut-off header are errors."""
    if data[:4] != MAGIC:
        raise InputError("invalid_magic", "not a log: wrong magic bytes")
    if len(data) < 5 or data[4] != VERSION:
        raise InputError("unsupported_version", f"log version {data[4] if len(data) > 4 else '?'} is not {VERSION}")
    if len(data) < _HEADER.size:
        raise InputError("truncated", "the log ends in its header")
    _, _, uuid, device, start, crc, mask, count, rate, gps, entries = _HEADER.unpack_from(data)
    out = Header(uuid.hex(), device.hex(), start, f"{crc:08x}", mask, count, rate, gps)
    at = _HEADER.size
    if len(data) < at + entries * _ENTRY.size + 4:
        raise InputError("truncated", "the log ends in its channel registry")
    for _ in range(entries):
        i, kind, hz, scale, offset, name, units = _ENTRY.unpack_from(data, at)
        name = _text(name)
        out.registry[i] = Entry(i, kind, hz, scale, offset, "HR_BPM" if name == "HeartRate" else name, _text(units))
        at += _ENTRY.size
    if struct.unpack_from("<I", data, at)[0] != REGISTRY_END:
        raise InputError("truncated", "the channel registry has no end marker")
    out.size = at + 4
    return out


def records(data: bytes, header: Header):
    """(type, payload) in order. The generator's return value is a warning when the log ends inside a record."""
    at = header.size
    while at < len(data):
        if data[at] == END:
            return None
        if at + 3 > len(data):
            return f"the log ends in a record header at byte {at}"
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 3], "little")
        if at + 3 + size > len(data):
            return f"the log ends in a record at byte {at}"
        yield kind, data[at + 3 : at + 3 + size]
        at += 3 + size
    return None


#: Rows of the decoder: kind 0 the session, 1 inertial axis values, 2 other samples, 3 times of unknown channels.
ROW = "session_id string, kind int, channel_id string, ord int, seq long, ts_us long, imu int, raw double, data_type int, scale double, offset double, rate_hz double, device_id string, start_ms long, checksum string, period_us long, warning string"
_COLUMNS = tuple(c.split()[0] for c in ROW.split(", "))


def decode(data: bytes, inertial: bool = True, order: dict[str, int] | None = None):
    """Rows (tuples in the order of ROW) of one log. Everything before a damaged record is kept. Without ``inertial`` those
    samples are left to ``inertial_columns``, but their channels are numbered in ``order`` (by first appearance)."""
    h = read_header(data)
    by_name = {e.name: e for e in h.registry.values()}
    order = {} if order is None else order
    seq = 0

    def row(kind, channel, ts, raw, imu=-1, data_type=7, scale=1.0, offset=0.0, rate=0.0):
        return (h.session_id, kind, channel, -1 if channel is None else order.setdefault(channel, len(order)), seq, ts, imu, raw, data_type, scale, offset, rate, None, None, None, h.period_us, None)

    axes = [i for i in range(6) if h.imu_mask >> i & 1]
    numbered: set = set()
    stream = records(data, h)
    warning = None
    while True:
        try:
            kind, p = next(stream)
        except StopIteration as stop:
            warning = stop.value
            break
        seq += 1
        try:
            if kind == IMU:
                unit, ts = _IMU.unpack_from(p)
                if not inertial:
                    if (unit, len(p)) not in numbered:
                        numbered.add((unit, len(p)))
                        for axis in axes[: (len(p) - 9) // 2]:
                            order.setdefault(f"IMU{unit}_{AXES[axis]}", len(order))
                    continue
                for axis, raw in zip(axes, struct.unpack_from(f"<{min(len(axes), (len(p) - 9) // 2)}h", p, 9), strict=False):
                    name = f"IMU{unit}_{AXES[axis]}"
                    e = by_name.get(name)
                    yield row(1, name, ts, float(raw), unit, 4, e.scale if e else 1.0, e.offset if e else 0.0, 1e6 / h.period_us)
            elif kind == GPS:
                epoch, ts, *rest = struct.unpack_from("<qqiihHHBB", p)
                for name, raw in zip(GPS_CHANNELS, (epoch, *rest), strict=True):
                    scale = 0.01 if name == "GPS_SpeedKmh" else 1.0
                    yield row(2, name, ts, float(raw), -1, 5 if scale != 1.0 else 7, scale, 0.0, float(h.gps_rate))
            elif kind == CHANNEL:
                i, ts = struct.unpack_from("<Bq", p)
                e = h.registry.get(i)
                if e is None:
                    yield row(3, None, ts, None)
                elif e.data_type < len(_VALUE):
                    raw = float(struct.unpack_from(_VALUE[e.data_type], p, 9)[0])
                    yield row(2, e.name, ts, raw, -1, e.data_type, e.scale, e.offset, float(e.rate))
        except struct.error:
            warning = f"record {seq} is shorter than its fields"
            break
    yield (h.session_id, 0, None, None, 0, None, None, None, None, None, None, None, h.device_id, h.start_ms, h.checksum, h.period_us, warning)


_IMU = struct.Struct("<Bq")


def _frames(data: bytes, header: Header):
    """(kinds, starts and sizes of the payloads, warning) of a log's records."""
    kinds, starts, sizes, at, end = [], [], [], header.size, len(data)
    warning = None
    while at < end:
        kind = data[at]
        if kind == END:
            break
        if at + 3 > end:
            warning = f"the log ends in a record header at byte {at}"
            break
        size = data[at + 1] | data[at + 2] << 8
        if at + 3 + size > end:
            warning = f"the log ends in a record at byte {at}"
            break
        kinds.append(kind)
        starts.append(at + 3)
        sizes.append(size)
        at += 3 + size
    return np.array(kinds, np.uint8), np.array(starts, np.int64), np.array(sizes, np.int64), warning


def inertial_columns(data: bytes, header: Header) -> dict[str, np.ndarray] | None:
    """The inertial samples of a log as columns unit, seq, ts_us, axis and raw: runs of records of equal size are read as one
    array. None if a record is shorter than its fields, so that ``decode`` tells where."""
    kinds, starts, sizes, _ = _frames(data, header)
    axes = np.array([i for i in range(6) if header.imu_mask >> i & 1], np.int64)
    least = {IMU: _IMU.size, GPS: 36, CHANNEL: _IMU.size}
    if any((sizes[kinds == k] < n).any() for k, n in least.items()):
        return None
    raw_bytes = np.frombuffer(data, np.uint8)
    out: dict[str, list] = {k: [] for k in ("unit", "seq", "ts_us", "axis", "raw")}
    seq = np.arange(1, len(kinds) + 1)
    for size in np.unique(sizes[kinds == IMU]).tolist():
        at = (kinds == IMU) & (sizes == size)
        n = min(len(axes), (size - _IMU.size) // 2)
        if not n:
            continue
        rows = raw_bytes[starts[at][:, None] + np.arange(_IMU.size + 2 * n)]
        out["unit"].append(np.repeat(rows[:, 0].astype(np.int64), n))
        out["ts_us"].append(np.repeat(np.ascontiguousarray(rows[:, 1:9]).view("<i8").ravel(), n))
        out["raw"].append(np.ascontiguousarray(rows[:, 9:]).view("<i2").astype(np.float64).ravel())
        out["seq"].append(np.repeat(seq[at], n))
        out["axis"].append(np.tile(axes[:n], int(at.sum())))
    return {k: np.concatenate(v) if v else np.empty(0) for k, v in out.items()}


def _inertial(data: bytes, header: Header, order: dict[str, int], schema: pa.Schema):
    """Batches of the rows that ``decode`` makes of inertial records, or None. ``order`` has the channels' numbers."""
    found = inertial_columns(data, header)
    if found is None:
        return None
    by_name = {e.name: e for e in header.registry.values()}
    batches = []
    where = found["unit"] * 6 + found["axis"]
    for code in np.unique(where).astype(np.int64).tolist():
        at = where == code
        name = f"IMU{code // 6}_{AXES[code % 6]}"
        e = by_name.get(name)
        fixed = {"session_id": header.session_id, "kind": 1, "channel_id": name, "ord": order[name], "imu": code // 6, "data_type": 4, "scale": e.scale if e else 1.0, "offset": e.offset if e else 0.0, "rate_hz": 1e6 / header.period_us, "period_us": header.period_us}
        rows = int(at.sum())
        for a in range(0, rows, 50_000):
            part = slice(a, min(rows, a + 50_000))
            n = part.stop - a
            columns = {"seq": found["seq"][at][part], "ts_us": found["ts_us"][at][part], "raw": found["raw"][at][part]}
            batches.append(pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.repeat(pa.scalar(fixed[f.name], f.type), n) if f.name in fixed else pa.nulls(n, f.type) for f in schema], schema=schema))
    return batches


def _batches(batches):
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in ROW.split(", ")])
    for batch in batches:
        for content in batch.column(0):
            rows: list = []
            data, order = content.as_py(), {}
            header = read_header(data)
            fast = inertial_columns(data, header) is not None
            for r in decode(data, not fast, order):
                rows.append(r)
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            if fast:
                yield from _inertial(data, header, order, schema)


def read_logs(spark: SparkSession, path: str, pattern: str = "*") -> SessionSet:
    """Sessions of every log under ``path`` (a file or a folder), with Time and Distance made."""
    return read_contents(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content"))


def read_contents(logs: DataFrame) -> SessionSet:
    """Sessions of logs that are rows already (column content), with Time and Distance made."""
    return from_records(logs.select("content").mapInArrow(_batches, ROW))


def from_records(rows: DataFrame) -> SessionSet:
    rows = SharedTable(rows, "log-rows").df  # read several times below; deleted when the session ends
    sample = rows.where("kind > 0")
    origin = sample.groupBy("session_id").agg(F.min("ts_us").alias("origin_us"))
    sample = sample.where("kind < 3")
    physical = F.when(F.col("data_type") == 7, F.col("raw") * F.col("scale") + F.when(F.col("offset") != 0, F.col("offset")).otherwise(F.lit(-0.0))).otherwise(F.col("raw") * F.col("scale") + F.col("offset"))
    other = dense_index(sample.where("kind = 2"), ["session_id", "channel_id"], "seq").join(origin, "session_id")
    t = F.when(F.col("rate_hz") > 0, F.col("idx") / F.col("rate_hz")).otherwise((F.col("ts_us") - F.col("origin_us")) / 1e6)
    values = other.select("session_id", "channel_id", "idx", t.alias("t"), physical.alias("value"))

    # one slot for each record of a unit, from any of its axes; then the shared grid in raw counts
    imu = sample.where("kind = 1")
    per_record = imu.select("session_id", "imu", "seq", "ts_us", "period_us").distinct()
    gaps = None
    periods = [r[0] for r in per_record.select("period_us").distinct().collect()]  # one for each configured rate
    for period in periods:
        placed = place_slots(per_record.where(F.col("period_us") == period), period).where("kept").select("session_id", "imu", "seq", "slot", "first_us")
        placed = SharedTable(placed, "log-slots").df
        facts = imu.where(F.col("period_us") == period).groupBy("session_id", "channel_id").agg(F.first("scale").alias("scale"), F.first("offset").alias("offset"))
        kept = imu.join(placed, ["session_id", "imu", "seq"]).select("session_id", "imu", "channel_id", "slot", "first_us", "raw")
        grid, spans = rebuild_imu_grid(kept, period)
        grid = SharedTable(grid, "log-grid").df
        scaled = grid.join(facts, ["session_id", "channel_id"]).select("session_id", "channel_id", "idx", "t", (F.col("value") * F.col("scale") + F.col("offset")).alias("value"))
        values = values.unionByName(scaled)
        gaps = spans if gaps is None else gaps.unionByName(spans)

    meta = sample.groupBy("session_id", "channel_id").agg(F.min("ord").alias("ord"), F.first("rate_hz").alias("rate_hz"), F.first("data_type").cast("byte").alias("data_type"), F.first("scale").alias("scale"), F.first("offset").alias("offset"))
    lengths = values.groupBy("session_id", "channel_id").agg(F.count(F.lit(1)).alias("len"))
    channels = meta.join(lengths, ["session_id", "channel_id"]).select("session_id", "channel_id", "ord", "rate_hz", "len", (F.col("rate_hz") == 0).alias("is_event_driven"), F.lit(False).alias("synthesized"), "data_type", "scale", "offset", F.lit("").alias("units"))

    # a start of 0 is filled from the first fix with a time, less the time from the first record to that fix
    fix = sample.where("channel_id = 'GPS_EpochMs' and raw > 0").groupBy("session_id").agg(F.min_by(F.struct("raw", "ts_us"), "seq").alias("fix"))
    head = rows.where("kind = 0").join(fix, "session_id", "left").join(origin, "session_id", "left")
    back = F.col("fix.raw").cast("long") - F.round((F.col("fix.ts_us") - F.col("origin_us")) / 1000.0).cast("long")
    start = F.when((F.col("start_ms") == 0) & F.col("fix").isNotNull(), back).otherwise(F.col("start_ms"))
    sessions = head.select("session_id", "device_id", start.alias("timestamp_utc_ms"), F.col("checksum").alias("config_checksum"), F.col("warning").alias("truncation_warning"))

    time = time_ramp(channels)
    made = values.unionByName(time)
    if not channels.where("channel_id = 'GPS_SpeedKmh'").isEmpty():
        made = made.unionByName(distance(values, channels))
    base = time.groupBy("session_id").agg(F.count(F.lit(1)).alias("len")).join(channels.groupBy("session_id").agg(F.max("rate_hz").alias("rate_hz"), F.max("ord").alias("ord"), F.max((F.col("channel_id") == "GPS_SpeedKmh").cast("int")).alias("gps")), "session_id")
    names = F.when(F.col("gps") == 1, F.array(F.lit("Time"), F.lit("Distance"))).otherwise(F.array(F.lit("Time")))
    extra = base.select("session_id", F.posexplode(names).alias("k", "channel_id"), "ord", "rate_hz", "len").select("session_id", "channel_id", (F.col("ord") + 1 + F.col("k")).alias("ord"), "rate_hz", "len", F.lit(False).alias("is_event_driven"), F.lit(True).alias("synthesized"), F.lit(7).cast("byte").alias("data_type"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit("").alias("units"))
    return SessionSet(made, channels.unionByName(extra), sessions, gaps)


# ---- recovery from raw images ----
#: Most bytes of a plausible record; payloads beyond end the recording.
MOST_PAYLOAD = 4096


@dataclass(frozen=True)
class Region:
    offset: int
    size: int
    records: int
    session_id: str
    clean_end: bool
    cut_off: bool


def walk(data: bytes, start: int) -> Region | None:
    """The recording whose header is at ``start``, up to its end record or the first implausible byte; None if no
    complete header is there."""
    try:
        h = read_header(data[start : start + _HEADER.size + 255 * _ENTRY.size + 4])
    except InputError:
        return None
    at, n = start + h.size, 0
    while True:
        if at >= len(data) or (data[at] != END and at + 3 > len(data)):
            return Region(start, at - start, n, h.session_id, False, True)
        if data[at] == END:
            return Region(start, min(at + 3, len(data)) - start, n, h.session_id, True, False)
        size = int.from_bytes(data[at + 1 : at + 3], "little")
        if data[at] not in (IMU, GPS, CHANNEL) or not 0 < size <= MOST_PAYLOAD:
            return Region(start, at - start, n, h.session_id, False, False)
        if at + 3 + size > len(data):
            return Region(start, at - start, n, h.session_id, False, True)
        at, n = at + 3 + size, n + 1


def find_recordings(data: bytes, sector: int = 1, session_id: str | None = None) -> list[Region]:
    """Every recording in an image (bytes, or a mapped file of any size), at multiples of ``sector`` bytes; with
    ``session_id`` only that one."""
    out, at = [], 0
    while (at := data.find(MAGIC + bytes([VERSION]), at)) >= 0:
        found = walk(data, at) if at % sector == 0 else None
        if found and (session_id is None or found.session_id == session_id.strip().lower()):
            out.append(found)
            at += max(found.size, 1)
        else:
            at += 1
    return out


def extract(data: bytes, region: Region) -> bytes:
    """A recovered recording as a log of its own, with an end record where it had none."""
    body = data[region.offset : region.offset + region.size]
    return body if region.clean_end else body + struct.pack("<BH", END, 0)


def scan_images(spark: SparkSession, path: str, sector: int = 512) -> DataFrame:
    """(path, offset, size, records, session_id, clean_end, cut_off) of the recordings in raw images, a task per image."""
    return scan_contents(spark.read.format("binaryFile").load(path).select("path", "content"), sector)


def scan_contents(images: DataFrame, sector: int = 512) -> DataFrame:
    """The same of images that are rows already (path, content)."""

    def run(batches):
        for batch in batches:
            rows = [(p.as_py(), r.offset, r.size, r.records, r.session_id, r.clean_end, r.cut_off) for p, c in zip(batch.column(0), batch.column(1), strict=True) for r in find_recordings(c.as_py(), sector)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            names = ["path", "offset", "size", "records", "session_id", "clean_end", "cut_off"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return images.select("path", "content").mapInArrow(run, "path string, offset long, size long, records long, session_id string, clean_end boolean, cut_off boolean")
