"""FIT activity files from fixes, heart rate and laps."""

from __future__ import annotations

import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..operators import joins
from ..operators.blocked import running_sum
from ..operators.laps import cumulative_distance

#: Fixed values of the format: base types (size, code), message numbers, epoch, versions, invalid values.
ENUM, U8, U16, U32, I32, U32Z = (1, 0x00), (1, 0x02), (2, 0x84), (4, 0x86), (4, 0x85), (4, 0x8C)
FILE_ID, SESSION, LAP, RECORD, DEVICE_INFO, ACTIVITY = 0, 18, 19, 20, 23, 34
EPOCH_OFFSET_S, PROTOCOL, PROFILE = 631_065_600, 0x20, 2100
_FORMAT = {ENUM: "B", U8: "B", U16: "H", U32: "I", I32: "i", U32Z: "I"}


def crc16(data: bytes, crc: int = 0) -> int:
    """CRC-16 of FIT files (polynomial 0x8005 reflected), bit by bit over a table built from the rule."""
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 0xFF]
    return crc


def _entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xA001 if i & 1 else 0)
    return i


_CRC = [_entry(i) for i in range(256)]


class Writer:
    """Definition and data messages; ``finish`` frames them."""

    def __init__(self):
        self.body = bytearray()
        self.forms: dict[int, str] = {}

    def define(self, local: int, message: int, fields: list[tuple[int, tuple]]) -> None:
        self.body += struct.pack("<BBBHB", 0x40 | local, 0, 0, message, len(fields))
        for number, (size, code) in fields:
            self.body += bytes((number, size, code))
        self.forms[local] = "<" + "".join(_FORMAT.get(kind, f"{kind[0]}s") for _, kind in fields)

    def put(self, local: int, *values) -> None:
        self.body += bytes((local,)) + struct.pack(self.forms[local], *values)

    def finish(self) -> bytes:
        head = struct.pack("<BBHI4s", 14, PROTOCOL, PROFILE, len(self.body), b".FIT")
        head += struct.pack("<H", crc16(head))
        whole = head + bytes(self.body)
        return whole + struct.pack("<H", crc16(whole))


def fit_time(ms: Column) -> Column:
    """Seconds of the FIT epoch, 0 before it."""
    s = F.when(ms >= 0, F.floor(ms / 1000)).otherwise(F.ceil(ms / 1000))
    return F.greatest(s - EPOCH_OFFSET_S, F.lit(0)).cast("long")


def _clamped(x: Column, most: int) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(0.0)), F.lit(float(most))).cast("long")


def semicircles(e7: Column) -> Column:
    return F.round(e7 / 1e7 * (2.0**31 / 180.0)).cast("long")


def altitude(m_x10: Column) -> Column:
    return _clamped((m_x10 / 10.0 + 500.0) * 5.0, 65535)


def speed(kmh: Column) -> Column:
    return _clamped(kmh / 3.6 * 1000.0, 65535)


def activity_records(fixes: DataFrame, heart: DataFrame | None = None) -> DataFrame:
    """FIT record fields per fix (session_id, idx, timestamp_ms, lat, lon[, alt, speed]), heart rate (session_id, t: wall
    ms, value: bpm) carried forward: ts, lat, lon, distance_cm, altitude, speed, hr."""
    f = cumulative_distance(fixes)
    for c in ("alt", "speed"):
        if c not in f.columns:
            f = f.withColumn(c, F.lit(None).cast("double"))
    if heart is not None:
        beat = heart.select("session_id", F.col("t").cast("double").alias("t"), F.least(F.greatest(F.round("value"), F.lit(0.0)), F.lit(254.0)).alias("value"))
        f = joins.as_of(f.withColumn("__w", F.col("timestamp_ms").cast("double")), beat, "__w", "hr", seconds_per_block=3_600_000.0).drop("__w")
    else:
        f = f.withColumn("hr", F.lit(None).cast("double"))
    return f.select("session_id", "idx", "timestamp_ms", fit_time(F.col("timestamp_ms")).alias("ts"), semicircles(F.col("lat")).alias("lat"), semicircles(F.col("lon")).alias("lon"), _clamped(F.col("distance_m") * 100.0, 2**32 - 1).alias("distance_cm"), altitude(F.col("alt")).alias("altitude"), speed(F.col("speed")).alias("speed"), F.col("hr").cast("long").alias("hr"), (F.col("speed") / 3.6).alias("mps"), "distance_m")


def session_rollup(records: DataFrame) -> DataFrame:
    """Per session: elapsed, distance, mean and greatest speed, whole-number mean and greatest heart rate, fixes. Speeds are
    added up in the order of the fixes, so that the mean doesn't hang on how rows lie in partitions."""
    summed = running_sum(records, ["session_id"], "idx", F.coalesce("mps", F.lit(0.0)), "__mps")
    return summed.groupBy("session_id").agg(
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"),
        (F.greatest(F.max_by("timestamp_ms", "idx") - F.min_by("timestamp_ms", "idx"), F.lit(0)) / 1000.0).alias("elapsed_s"),
        F.max("distance_m").alias("distance_m"), (F.max_by("__mps", "idx") / F.nullif(F.count("mps"), F.lit(0))).alias("avg_speed"), F.max("mps").alias("max_speed"),
        F.floor(F.sum("hr") / F.count("hr")).cast("long").alias("avg_hr"), F.max("hr").alias("max_hr"), F.count(F.lit(1)).alias("fixes"),
    )


def encode(records: list[dict], laps: list[tuple[int, int, float]] | None = None, sport: int = 0, product: str = "kinespark") -> bytes:
    """A FIT file from ordered records (fields of ``activity_records``) and laps (start_ms, end_ms, elapsed_s); without
    laps the whole ride is one. No record is an error."""
    if not records:
        raise InputError("parse", "no GPS fixes")
    w = Writer()
    stamp = lambda ms: max(0, int(ms / 1000) - EPOCH_OFFSET_S)
    first, last = records[0], records[-1]
    w.define(1, FILE_ID, [(0, ENUM), (1, U16), (2, U16), (3, U32Z), (4, U32)])
    w.put(1, 4, 255, 0, first["ts"] or 1, first["ts"])
    name = product.encode()[:15] + b"\0"
    w.define(2, DEVICE_INFO, [(0, U8), (2, U16), (27, (len(name), 0x07))])
    w.put(2, 0, 255, name)
    has = {k: any(r[k] is not None for r in records) for k in ("altitude", "speed", "hr")}
    fields = [(253, U32), (0, I32), (1, I32), (5, U32)] + [f for k, f in (("altitude", (2, U16)), ("speed", (6, U16)), ("hr", (3, U8))) if has[k]]
    w.define(0, RECORD, fields)
    missing = {"altitude": 0xFFFF, "speed": 0xFFFF, "hr": 0xFF}
    for r in records:
        w.put(0, r["ts"], r["lat"], r["lon"], r["distance_cm"], *[r[k] if r[k] is not None else missing[k] for k in missing if has[k]])
    elapsed = max(0, last["timestamp_ms"] - first["timestamp_ms"]) / 1000.0
    spans = laps or [(first["timestamp_ms"], last["timestamp_ms"], elapsed)]
    ms = lambda s: min(max(int(math.floor(s * 1000 + 0.5)), 0), 2**32 - 1)
    w.define(3, LAP, [(254, U16), (253, U32), (2, U32), (7, U32), (8, U32)])
    for i, (a, b, s) in enumerate(spans):
        w.put(3, i, stamp(b), stamp(a), ms(s), ms(s))
    speeds = [r["mps"] for r in records if r["mps"] is not None]
    beats = [r["hr"] for r in records if r["hr"] is not None]
    mmps = lambda v: min(max(int(math.floor(v * 1000 + 0.5)), 0), 0xFFFF)
    w.define(4, SESSION, [(254, U16), (253, U32), (2, U32), (7, U32), (8, U32), (9, U32), (5, ENUM), (6, ENUM), (25, U16), (26, U16), (14, U16), (15, U16), (16, U8), (17, U8)])
    w.put(4, 0, last["ts"], first["ts"], ms(elapsed), ms(elapsed), last["distance_cm"], sport, 0, 0, len(spans), mmps(sum(speeds) / len(speeds)) if speeds else 0xFFFF, mmps(max(speeds)) if speeds else 0xFFFF, sum(beats) // len(beats) if beats else 0xFF, max(beats) if beats else 0xFF)
    w.define(5, ACTIVITY, [(253, U32), (0, U32), (1, U16), (2, ENUM), (3, ENUM), (4, ENUM)])
    w.put(5, last["ts"], ms(elapsed), 1, 0, 26, 1)
    return w.finish()


def fit_files(records: DataFrame, sport: int = 0) -> DataFrame:
    """(session_id, content): one FIT file per session, sessions in parallel."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("idx").to_pylist()
        return pa.table({"session_id": [rows[0]["session_id"]], "content": pa.array([encode(rows, sport=sport)], pa.binary())})

    return records.groupBy("session_id").applyInArrow(run, "session_id string, content binary")
