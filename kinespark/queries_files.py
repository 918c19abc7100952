"""Queries over sources, sinks, tables, tracks and overlays, and the SQL that gives the same rows.

Files are made from ``events`` by small writers of their formats (one recording for each user), read by the
library's sources, and compared with what SQL computes from the events directly.
"""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine, run_command
from .errors import EvalError
from .functions import aggregate, vector
from .kernels import rotation
from .model import SessionSet, grid
from .operators import joins, laps, overlay, series, tables
from .plans.compile import evaluate, evaluate_scalar
from .queries import _CIRCUIT, GATE, LAPS, RATE, S_SQL, SECTOR, X_SQL, _cross_sql, _events, channels, common, fixes, query
from .sources import config, export, fit, log, video

# ---- binary logs: one for each user ----
#: The events of a user as records: click an inertial sample, view a fix, error a value at times of its own, purchase one
#: at a fixed rate, signup a value of a channel that the registry lacks.
_U_SQL = """u AS (SELECT user_id, event_id, event_type AS k, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS i FROM events),
o AS (SELECT user_id, min(CASE WHEN k = 'click' THEN i * 1250 ELSE us END) AS origin FROM u GROUP BY user_id)"""
_REGISTRY = ((1, 1, 0, 0.125, 2.0, "Pressure", "kPa"), (2, 5, 10, 0.5, -1.0, "Fork", "mm"), (3, 4, 800, 0.25, 1.0, "IMU0_AccelX", "g"))


def _log_of(user: int, rows: list[dict], cut: int = 0) -> bytes:
    out = struct.pack("<4sB16s6sqIIBHBB", log.MAGIC, log.VERSION, user.to_bytes(16), b"\1\2\3\4\5\6", 0 if user % 2 else 1000 + user, 0xABCD, 1, 1, 800, 5, len(_REGISTRY))
    for i, kind, rate, scale, offset, name, units in _REGISTRY:
        out += struct.pack("<BBHff20s8s", i, kind, rate, scale, offset, name.encode(), units.encode())
    parts, clicks = [out + struct.pack("<I", log.REGISTRY_END)], 0
    for r in rows:
        us, v = r["us"], int(r["value"])
        if r["k"] == "click":
            kind, p = log.IMU, struct.pack("<Bqh", 0, clicks * 1250, v)
            clicks += 1
        elif r["k"] == "view":
            kind, p = log.GPS, struct.pack("<qqiihHHBB", 1_700_000_000_000 + us // 1000, us, 450_000_000 + v, 60_000_000 - v, 100, v, 9000, 1, 8)
        elif r["k"] == "error":
            kind, p = log.CHANNEL, struct.pack("<BqH", 1, us, v)
        elif r["k"] == "purchase":
            kind, p = log.CHANNEL, struct.pack("<Bqi", 2, us, -v)
        else:
            kind, p = log.CHANNEL, struct.pack("<Bqd", 9, us, r["value"])
        parts.append(struct.pack("<BH", kind, len(p)) + p)
    whole = b"".join([*parts, struct.pack("<BH", log.END, 0)])
    return whole[: len(whole) - cut] if cut else whole


def _logs(spark: SparkSession, sf_dir: str, cut: int = 0) -> DataFrame:
    """(user_id, content): a log for each user; with ``cut``, that many bytes short."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("event_id").to_pylist()
        return pa.table({"user_id": [rows[0]["user_id"]], "content": pa.array([_log_of(rows[0]["user_id"], rows, cut)], pa.binary())})

    e = _events(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("k"), "value", "us")
    return e.groupBy("user_id").applyInArrow(run, "user_id long, content binary")


def _user(c: str = "session_id"):
    return F.conv(F.substring(c, 17, 16), 16, 10).cast("long")


@query(
    "log_samples",
    f"""WITH {_U_SQL} SELECT user_id, 'IMU0_AccelX' AS channel_id, i AS idx, round(floor(value) * 0.25 + 1, 6) AS value, round(i / 800.0, 6) AS t FROM u WHERE k = 'click'
UNION ALL SELECT user_id, 'Pressure', i, round(floor(value) * 0.125 + 2, 6), round((us - origin) / 1e6, 6) FROM u JOIN o USING (user_id) WHERE k = 'error'
UNION ALL SELECT user_id, 'Fork', i, round(-floor(value) * 0.5 - 1, 6), round(i / 10.0, 6) FROM u WHERE k = 'purchase'
UNION ALL SELECT user_id, 'GPS_EpochMs', i, 1700000000000.0 + us // 1000, round(i / 5.0, 6) FROM u WHERE k = 'view'
UNION ALL SELECT user_id, 'GPS_Latitude', i, 450000000 + floor(value), round(i / 5.0, 6) FROM u WHERE k = 'view'
UNION ALL SELECT user_id, 'GPS_Longitude', i, 60000000 - floor(value), round(i / 5.0, 6) FROM u WHERE k = 'view'
UNION ALL SELECT user_id, 'GPS_SpeedKmh', i, round(floor(value) * 0.01, 6), round(i / 5.0, 6) FROM u WHERE k = 'view'""",
)
def _log_samples(spark, sf_dir):
    data = log.read_contents(_logs(spark, sf_dir))
    wanted = ("IMU0_AccelX", "Pressure", "Fork", "GPS_EpochMs", "GPS_Latitude", "GPS_Longitude", "GPS_SpeedKmh")
    s = data.samples.where(F.col("channel_id").isin(*wanted))
    return s.select(_user().alias("user_id"), "channel_id", "idx", F.round("value", 6).alias("value"), F.round("t", 6).alias("t"))


@query(
    "log_sessions",
    f"""WITH {_U_SQL}, f AS (SELECT user_id, arg_min(us, event_id) AS us FROM u WHERE k = 'view' GROUP BY user_id)
SELECT o.user_id, '010203040506' AS device_id, '0000abcd' AS config_checksum, CASE WHEN o.user_id % 2 = 0 THEN 1000 + o.user_id WHEN f.us IS NULL THEN 0 ELSE 1700000000000 + f.us // 1000 - CAST(round((f.us - origin) / 1000.0) AS BIGINT) END AS timestamp_utc_ms, FALSE AS cut_off FROM o LEFT JOIN f USING (user_id)""",
)
def _log_sessions(spark, sf_dir):
    s = log.read_contents(_logs(spark, sf_dir)).sessions
    return s.select(_user().alias("user_id"), "device_id", "config_checksum", "timestamp_utc_ms", F.col("truncation_warning").isNotNull().alias("cut_off"))


@query(
    "log_channels",
    f"""WITH {_U_SQL}, c(k, channel_id, rate_hz, data_type, scale, "offset") AS (VALUES ('click', 'IMU0_AccelX', 800.0, 4, 0.25, 1.0), ('error', 'Pressure', 0.0, 1, 0.125, 2.0), ('purchase', 'Fork', 10.0, 5, 0.5, -1.0), ('view', 'GPS_SpeedKmh', 5.0, 5, 0.01, 0.0), ('view', 'GPS_Heading', 5.0, 7, 1.0, 0.0), ('view', 'GPS_Satellites', 5.0, 7, 1.0, 0.0))
SELECT user_id, channel_id, CAST(rate_hz AS DOUBLE) AS rate_hz, CAST(data_type AS INT) AS data_type, CAST(scale AS DOUBLE) AS scale, CAST("offset" AS DOUBLE) AS "offset", rate_hz = 0 AS is_event_driven, count(*) AS len FROM u JOIN c USING (k) GROUP BY ALL""",
)
def _log_channels(spark, sf_dir):
    c = log.read_contents(_logs(spark, sf_dir)).channels
    wanted = ("IMU0_AccelX", "Pressure", "Fork", "GPS_SpeedKmh", "GPS_Heading", "GPS_Satellites")
    return c.where(F.col("channel_id").isin(*wanted)).select(_user().alias("user_id"), "channel_id", "rate_hz", F.col("data_type").cast("int").alias("data_type"), "scale", "offset", "is_event_driven", "len")


@query(
    "log_truncated",
    f"""WITH {_U_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM u), n AS (SELECT user_id, count(*) FILTER (back > 1) AS n FROM l GROUP BY user_id)
SELECT n.user_id, TRUE AS cut_off, coalesce(c.n, 0) AS n_samples FROM n LEFT JOIN (SELECT user_id, count(*) AS n FROM l WHERE back > 1 AND k IN ('error', 'purchase', 'click') GROUP BY user_id) c USING (user_id)""",
)
def _log_truncated(spark, sf_dir):
    data = log.read_contents(_logs(spark, sf_dir, 5))
    n = data.samples.where(F.col("channel_id").isin("Pressure", "Fork", "IMU0_AccelX")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return data.sessions.join(n, "session_id", "left").select(_user().alias("user_id"), F.col("truncation_warning").isNotNull().alias("cut_off"), F.coalesce("n", F.lit(0)).cast("long").alias("n_samples"))


@query("resident_bytes", f"WITH {_U_SQL} SELECT user_id, CAST(sum(CASE k WHEN 'click' THEN 2 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'view' THEN 7 * 8 + 4 ELSE 0 END) AS BIGINT) AS bytes FROM u GROUP BY user_id HAVING count(*) FILTER (k <> 'signup') > 0")
def _resident(spark, sf_dir):
    return Engine(spark, log.read_contents(_logs(spark, sf_dir))).resident_bytes().select(_user().alias("user_id"), "bytes")


_RECORD = "CASE k WHEN 'click' THEN 14 WHEN 'view' THEN 35 WHEN 'error' THEN 14 WHEN 'purchase' THEN 16 ELSE 20 END"


@query("recover_scan", f"WITH {_U_SQL} SELECT user_id, 512::BIGINT AS first_offset, CAST(48 + 3 * 40 + 4 + sum({_RECORD}) + 3 AS BIGINT) AS size, count(*) AS records, TRUE AS clean_end, CAST(512 * (2 + (48 + 3 * 40 + 4 + sum({_RECORD}) + 3 + 511) // 512) AS BIGINT) AS second_offset, TRUE AS second_cut_off FROM u GROUP BY user_id")
def _recover(spark, sf_dir):
    """Images of empty sectors, a log, an empty sector and the same log without its last bytes."""

    def image(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                pad = b"\0" * (-len(x) % 512)
                out.append(b"\0" * 512 + x + pad + b"\0" * 512 + x[:-4])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    images = _logs(spark, sf_dir).mapInArrow(image, "path string, content binary")
    found = log.scan_contents(images, 512)
    one = found.groupBy(F.col("path").cast("long").alias("user_id")).agg(F.sort_array(F.collect_list(F.struct("offset", "size", "records", "clean_end", "cut_off"))).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return one.select("user_id", first["offset"].alias("first_offset"), first["size"].alias("size"), first["records"].alias("records"), first["clean_end"].alias("clean_end"), second["offset"].alias("second_offset"), second["cut_off"].alias("second_cut_off"))


# ---- exports ----
@query("export_rows", f"WITH {S_SQL} SELECT channel_id AS channel, t AS time_s, value FROM s WHERE channel_id IN ('view', 'click')")
def _export(spark, sf_dir):
    return export.export_rows(SessionSet.from_samples(channels(spark, sf_dir), RATE), ["view", "click"])


@query("export_csv", f"WITH {S_SQL} SELECT channel_id AS channel, round(t, 3) AS time_s, round(value, 4) AS value FROM s WHERE channel_id = 'error'")
def _csv(spark, sf_dir):
    lines = export.export_rows(SessionSet.from_samples(channels(spark, sf_dir), RATE), ["error"]).select(F.to_csv(F.struct("channel", "time_s", "value")).alias("line"))
    return lines.select(F.from_csv("line", "channel string, time_s double, value double").alias("x")).select("x.channel", F.round("x.time_s", 3).alias("time_s"), F.round("x.value", 4).alias("value"))


@query("export_json", "WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, event_type AS channel_id, CAST(i AS BIGINT) AS idx, round(value, 6) AS value, 10.0::DOUBLE AS rate FROM e WHERE event_type IN ('click', 'view')")
def _json(spark, sf_dir):
    doc = export.export_json(_by_user(spark, sf_dir), ["click", "view"])
    shape = "session struct<session_id:string>, channels array<struct<channel_id:string,sample_rate_hz:double,samples:array<double>>>"
    one = doc.select(F.from_json("json", shape).alias("d")).select(F.col("d.session.session_id").cast("long").alias("user_id"), F.explode("d.channels").alias("c"))
    return one.select("user_id", "c.channel_id", F.posexplode("c.samples").alias("idx", "value"), F.col("c.sample_rate_hz").alias("rate")).select("user_id", "channel_id", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"), "rate")


def _by_user(spark, sf_dir) -> SessionSet:
    """A session for each user: fixed-rate channels by event type."""
    from .operators.blocked import dense_index

    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("channel_id"), "event_id", "value")
    s = dense_index(e, ["session_id", "channel_id"], "event_id").select("session_id", "channel_id", "idx", (F.col("idx") / RATE).alias("t"), "value")
    return SessionSet.from_samples(s, RATE)


# ---- FIT ----
def _fit_messages(data: bytes) -> tuple[bool, list[tuple[int, dict]]]:
    """(whether length and both checksums hold, messages as (number, fields)) of a FIT file."""

    def crc(x: bytes) -> int:
        c = 0
        for b in x:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0xA001 if c & 1 else 0)
        return c

    head, size = data[0], int.from_bytes(data[4:8], "little")
    sound = data[8:12] == b".FIT" and len(data) == head + size + 2 and crc(data[:12]) == int.from_bytes(data[12:14], "little") and crc(data[:-2]) == int.from_bytes(data[-2:], "little")
    codes = {0x00: "B", 0x02: "B", 0x84: "H", 0x85: "i", 0x86: "I", 0x8C: "I"}
    shapes, out, at = {}, [], head
    while at < head + size:
        first = data[at]
        at += 1
        if first & 0x40:
            number, n = struct.unpack_from("<H", data, at + 2)[0], data[at + 4]
            shapes[first & 15] = number, [tuple(data[at + 5 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
            at += 5 + 3 * n
            continue
        number, fields = shapes[first & 15]
        values = {}
        for f, width, code in fields:
            values[f] = struct.unpack_from("<" + codes[code], data, at)[0] if code in codes else data[at : at + width]
            at += width
        out.append((number, values))
    return sound, out


def _fit(spark, sf_dir) -> DataFrame:
    """(user_id, content): a FIT file for each user's fixes."""
    f = fixes(spark, sf_dir).drop("session_id").join(_events(spark, sf_dir).select("event_id", "user_id", "value"), F.col("idx") == F.col("event_id"))
    own = f.select(F.col("user_id").cast("string").alias("session_id"), "idx", "timestamp_ms", "lat", "lon", F.col("value").alias("speed"), (F.col("value") * 10).alias("alt"))
    return fit.fit_files(fit.activity_records(own.withColumn("timestamp_ms", F.col("timestamp_ms") + 1_704_067_200_000)))


_FIT_SQL = X_SQL + """, w AS (SELECT user_id, x.*, value FROM x JOIN events ON event_id = idx), s AS (SELECT *, idx AS i0, lag(lat) OVER o AS a, lag(lon) OVER o AS b FROM w WINDOW o AS (PARTITION BY user_id ORDER BY idx)),
d AS (SELECT *, pow(sin(radians((lat - a) * 1e-7) / 2), 2) + cos(radians(a * 1e-7)) * cos(radians(lat * 1e-7)) * pow(sin(radians((lon - b) * 1e-7) / 2), 2) AS h FROM s),
r AS (SELECT *, sum(coalesce(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 0)) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS m, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS k FROM d)"""


@query("fit_records", f"WITH {_FIT_SQL} SELECT user_id, CAST(k AS BIGINT) AS k, CAST((ms + 1704067200000) // 1000 - 631065600 AS BIGINT) AS ts, CAST(round(lat / 1e7 * (2147483648.0 / 180)) AS BIGINT) AS lat, CAST(round(lon / 1e7 * (2147483648.0 / 180)) AS BIGINT) AS lon, round(round(m * 100) / 100.0, 0) AS metres, CAST(round(least(greatest((value + 500.0) * 5, 0), 65535)) AS BIGINT) AS altitude, CAST(round(least(value / 3.6 * 1000, 65535)) AS BIGINT) AS speed FROM r")
def _fit_records(spark, sf_dir):
    def run(batches):
        for batch in batches:
            rows = []
            for user, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [v for number, v in _fit_messages(data)[1] if number == 20]
                rows += [(int(user), k, v[253], v[0], v[1], v[5], v[2], v[6]) for k, v in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], ["user_id", "k", "ts", "lat", "lon", "cm", "altitude", "speed"])

    out = _fit(spark, sf_dir).mapInArrow(run, "user_id long, k long, ts long, lat long, lon long, cm long, altitude long, speed long")
    return out.select("user_id", "k", "ts", "lat", "lon", F.round(F.col("cm") / 100.0, 0).alias("metres"), "altitude", "speed")


@query("fit_summary", f"WITH {_FIT_SQL} SELECT user_id, TRUE AS sound, CAST(count(*) AS BIGINT) AS records, 1::BIGINT AS laps, CAST(max(ms) - min(ms) AS BIGINT) AS elapsed_ms, round(round(max(m) * 100) / 100.0, 0) AS metres, CAST(least(round(max(value) / 3.6 * 1000), 65535) AS BIGINT) AS max_speed, 1::BIGINT AS activities, 255::BIGINT AS max_hr FROM r GROUP BY user_id")
def _fit_summary(spark, sf_dir):
    def run(batches):
        for batch in batches:
            rows = []
            for user, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sound, found = _fit_messages(data)
                session = next(v for n, v in found if n == 18)
                count = lambda k: sum(n == k for n, _ in found)  # noqa: B023, E731
                rows.append((int(user), sound, count(20), count(19), session[7], session[9], session[15], count(34), session[17]))
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["user_id", "sound", "records", "laps", "elapsed_ms", "cm", "max_speed", "activities", "max_hr"])

    out = _fit(spark, sf_dir).mapInArrow(run, "user_id long, sound boolean, records long, laps long, elapsed_ms long, cm long, max_speed long, activities long, max_hr long")
    return out.withColumn("metres", F.round(F.col("cm") / 100.0, 0)).drop("cm")


# ---- video telemetry ----
@query("video_telemetry", f"WITH {X_SQL}, p AS (SELECT user_id, x.*, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM x JOIN events ON event_id = idx) SELECT user_id, CAST(k AS BIGINT) AS k, round(k / n, 6) AS t, round(lat / 1e7, 7) AS lat, round(lon / 1e7, 7) AS lon, round(k % 100 / 1000.0, 6) AS mps FROM p")
def _telemetry(spark, sf_dir):
    """A GPMF payload of a second for each user's fixes, written and read."""

    def item(key, kind, size, body):
        return struct.pack(">4scBH", key, kind, size, len(body) // size if size else 0) + body + b"\0" * (-len(body) % 4)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("idx").to_pylist()
        parts, out = [], []
        for at in range(0, len(rows), 1000):  # an item holds at most 65,535 structures
            five = b"".join(struct.pack(">5i", int(r["lat"]), int(r["lon"]), 0, (at + j) % 100, 0) for j, r in enumerate(rows[at : at + 1000]))
            parts.append(item(b"SCAL", b"l", 4, struct.pack(">5i", 10**7, 10**7, 1000, 1000, 100)) + item(b"GPS5", b"l", 20, five))
        found, n = [], len(rows)
        for at, part in zip(range(0, n, 1000), parts, strict=True):
            got = list(video.klv(part))
            scale = [x[0] for x in struct.iter_unpack(">i", got[0][3])]
            found += [(at + j, r[0] / scale[0], r[1] / scale[1], r[3] / scale[3]) for j, r in enumerate(struct.iter_unpack(">5i", got[1][3]))]
        for k, lat, lon, mps in found:
            out.append((rows[0]["user_id"], k, k / n, lat, lon, mps))
        kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["user_id", "k", "t", "lat", "lon", "mps"])

    f = fixes(spark, sf_dir).select("idx", "lat", "lon").join(_events(spark, sf_dir).select("event_id", "user_id"), F.col("idx") == F.col("event_id"))
    out = f.groupBy("user_id").applyInArrow(run, "user_id long, k long, t double, lat double, lon double, mps double")
    return out.select("user_id", "k", F.round("t", 6).alias("t"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("mps", 6).alias("mps"))


# ---- expressions: errors, scalars, definitions ----
_BAD = (
    ("[click] / 0", "division_by_zero"), ("[nothing] + 1", "unknown_channel"), ("nope([click])", "unknown_function"), ("sin()", "arg_count"), ("sin([click], 2)", "arg_count"), ("[click", "parse"), ("1 +", "parse"),
    ("vec([click], 1, 2)", "type"), ("norm([click])", "type"), ("hilbert([click])", "not_implemented"), ("resample([click], 2)", "not_implemented"), ("'text'", "type"), ("[click] and 1", "ok"), ("p([click], 50)", "ok"),
)


@query("error_kinds", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(t.replace("'", "''"), k) for t, k in _BAD) + ") v(text, kind)")
def _errors(spark, sf_dir):
    data, rows = common(spark, sf_dir, ("click",)), []
    for text, _ in _BAD:
        try:
            evaluate(data, text)
            rows.append((text, "ok"))
        except EvalError as e:
            rows.append((text, e.kind))
    return spark.createDataFrame(rows, "text string, kind string")


@query("envelope_kinds", "SELECT * FROM (VALUES ('division', FALSE, 'eval', 'division_by_zero'), ('stub', FALSE, 'unsupported', 'not_implemented'), ('channel', FALSE, 'not_found', NULL), ('log', FALSE, 'invalid_input', NULL), ('file', FALSE, 'io', NULL), ('fine', TRUE, NULL, NULL)) v(command, ok, kind, eval_kind)")
def _envelopes(spark, sf_dir):
    engine = Engine(spark, common(spark, sf_dir, ("click",)))
    actions = {"division": lambda: engine.evaluate("[click] / 0"), "stub": lambda: engine.evaluate("hilbert([click])"), "channel": lambda: engine.welch("nothing"), "log": lambda: log.read_header(b"no log"), "file": lambda: open("/nonexistent/file"), "fine": lambda: 1}  # noqa: SIM115
    out = {name: run_command(name, action) for name, action in actions.items()}
    rows = [(k, v["ok"], v.get("error", {}).get("kind"), v.get("error", {}).get("details", {}).get("eval_kind")) for k, v in out.items()]
    return spark.createDataFrame(rows, "command string, ok boolean, kind string, eval_kind string")


@query("scalar_expression", f"WITH {S_SQL} SELECT round(avg(value) FILTER (channel_id = 'click') + 2 * max(value) FILTER (channel_id = 'view') - quantile_cont(value, 0.9) FILTER (channel_id = 'click'), 6) AS value FROM s")
def _scalar(spark, sf_dir):
    out = evaluate_scalar(SessionSet.from_samples(channels(spark, sf_dir), RATE), "mean([click]) + 2 * max([view]) - p([click], 90)")
    return out.select(F.round("value", 6).alias("value"))


_BOOK = {
    "workbook_version": 2, "workbook_id": "w", "name": "book",
    "math_channels": [{"name": "twice", "expression": "[half] * 4"}, {"name": "half", "expression": "[click] / 2"}, {"name": "broken", "expression": "[half] + [none]"}, {"name": "loop", "expression": "[loop] + 1"}],
    "worksheets": [{"name": "sheet", "blocks": [{"id": "t", "placement": "p", "content": {"kind": "table", "table": {
        "columns": [{"id": "a", "name": "mean", "template": "mean([click])"}, {"id": "b", "name": "range", "template": "max([view]) - min([view])"}, {"id": "c", "name": "both", "template": "{a} + 2 * {range}"}, {"id": "d", "name": "share", "template": "{a} / sum({mean[]})"}, {"id": "e", "name": "gain", "template": "{b} - main({b[]})"}],
        "rows": [{"id": "r0", "context": {"lapIndex": 0}}, {"id": "r1", "context": {"lapIndex": 1}}, {"id": "r2", "context": {"lapIndex": 2}}, {"id": "r3", "context": {"lapIndex": 9}}],
        "cells": [[{}, {}, {}, {}, {}], [{}, {"formula": "count([view])"}, {}, {}, {}], [{"literal": 7, "name": "seven"}, {}, {}, {}, {"formula": "{A1} * {seven}"}], [{"literal": 1}, {"literal": 2}, {}, {}, {"formula": "nope(1)"}]]}}}]}],
}


@query("workbook_channels", f"WITH {S_SQL} SELECT channel_id, idx, value FROM (SELECT 'half' AS channel_id, idx, round(value / 2, 6) AS value FROM s WHERE channel_id = 'click' UNION ALL SELECT 'twice', idx, round(value * 2, 6) FROM s WHERE channel_id = 'click' UNION ALL SELECT 'failed:' || f, 0, 0.0 FROM (VALUES ('broken'), ('loop')) v(f))")
def _workbook(spark, sf_dir):
    engine = Engine(spark, common(spark, sf_dir, ("click",)))
    failed = engine.apply_workbook(json.dumps(_BOOK))
    out = spark.createDataFrame([(f"failed:{name}", 0, 0.0) for name, _ in failed], "channel_id string, idx long, value double")
    for name in ("half", "twice"):
        out = out.unionByName(engine.data.frame(name).select(F.lit(name).alias("channel_id"), "idx", F.round("value", 6).alias("value")))
    return out


_LAP_ROWS = "w(r, a, b) AS (VALUES (0, 0, 300), (1, 300, 755), (2, 755, 1200))"


@query(
    "table_cells",
    f"""WITH {S_SQL}, {_LAP_ROWS}, m AS (SELECT r, CASE WHEN r = 2 THEN 7.0 ELSE avg(value) FILTER (channel_id = 'click') END AS a, CASE WHEN r = 1 THEN count(*) FILTER (channel_id = 'view')::DOUBLE ELSE max(value) FILTER (channel_id = 'view') - min(value) FILTER (channel_id = 'view') END AS b FROM s JOIN w ON idx BETWEEN a AND b GROUP BY r UNION ALL SELECT 3, 1.0, 2.0),
x AS (SELECT r, a, b, a + 2 * b AS c, a / sum(a) OVER () AS d, CASE r WHEN 2 THEN (SELECT a FROM m WHERE r = 0) * 7 WHEN 3 THEN NULL ELSE b - (SELECT b FROM m WHERE r = 1) END AS e FROM m)
SELECT CAST(r AS BIGINT) AS "row", k AS "column", round(v, 6) AS value, CASE WHEN r = 3 AND k = 'gain' THEN 'unknown_function' END AS error FROM (SELECT r, 'mean' AS k, a AS v FROM x UNION ALL SELECT r, 'range', b FROM x UNION ALL SELECT r, 'both', c FROM x UNION ALL SELECT r, 'share', d FROM x UNION ALL SELECT r, 'gain', e FROM x)""",
)
def _table_cells(spark, sf_dir):
    engine = Engine(spark, SessionSet.from_samples(channels(spark, sf_dir), RATE))
    cells, _ = engine.table_eval(json.dumps(_BOOK), "t", LAPS.bounds, 1)
    names = [c["name"] for c in _BOOK["worksheets"][0]["blocks"][0]["content"]["table"]["columns"]]
    rows = [(r, n, None if v is None else float(v), e) for r, row in enumerate(cells) for n, (v, e) in zip(names, row, strict=True)]
    return spark.createDataFrame(rows, "row long, column string, value double, error string").withColumn("value", F.round("value", 6))


@query("table_windows", "SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE, 30.0::DOUBLE, FALSE), (1, 30.0, 75.5, FALSE), (2, 75.5, 120.0, FALSE), (3, NULL, NULL, TRUE)) v(\"row\", start_s, end_s, warned)")
def _table_windows(spark, sf_dir):
    table = config.read_workbook(json.dumps(_BOOK)).table("t").table
    warned = tables.lap_windows(table, LAPS.bounds)
    rows = [(i, *(row.window or (None, None)), any(f"row {row.id} " in w for w in warned)) for i, row in enumerate(table.rows)]
    return spark.createDataFrame(rows, "row long, start_s double, end_s double, warned boolean")


@query("table_problems", "SELECT * FROM (VALUES ('unknown_reference', 0::BIGINT, 0::BIGINT), ('parse_error', 0, 1), ('cycle', 0, 2), ('cycle', 0, 3), ('unknown_reference', 0, 4)) v(problem, \"row\", \"column\")")
def _table_problems(spark, sf_dir):
    names = ("a", "b", "c", "d", "e")
    table = tables.Table([(n, n, t) for n, t in zip(names, ("mean([gone])", "1 +", "{d}", "{c} + 1", "{Z9}"), strict=True)], [tables.TableRow("r")], [[tables.TableCell()] * 5])
    known = set(common(spark, sf_dir, ("click",)).load_info())
    return spark.createDataFrame(tables.validate(table, known), "problem string, row long, column long")


@query("table_list", "SELECT * FROM (VALUES ('t', 'sheet', 'mean,range,both,share,gain', 4::BIGINT)) v(block_id, worksheet, columns, n_rows)")
def _table_list(spark, sf_dir):
    found = Engine(spark, common(spark, sf_dir, ("click",))).table_list(json.dumps(_BOOK))
    return spark.createDataFrame([(t["block_id"], t["worksheet"], ",".join(t["columns"]), t["rows"]) for t in found], "block_id string, worksheet string, columns string, n_rows long")


@query("table_grid", "SELECT * FROM (VALUES (0::BIGINT, 'x,y'), (1, '1.5,#ERR'), (2, ',4.0')) v(line, text)")
def _table_grid(spark, sf_dir):
    table = tables.Table([("a", "x", None), ("b", "y", None)], [tables.TableRow("r"), tables.TableRow("s")], [])
    lines = tables.text_grid(table, [[(1.5, None), (None, "type")], [(None, None), (4.0, None)]]).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


@query("table_addresses", "SELECT * FROM (VALUES ('{A1}', 'cell', 0::BIGINT, 0::BIGINT), ('{$B$2}', 'cell', 1, 1), ('{y}', 'cell', 0, 1), ('{y[]}', 'column', NULL, 1), ('{seven}', 'cell', 1, 0), ('{C9}', NULL, NULL, NULL), ('{none}', NULL, NULL, NULL)) v(body, kind, \"row\", \"column\")")
def _addresses(spark, sf_dir):
    table = tables.Table([("a", "x", None), ("b", "y", None)], [tables.TableRow("r"), tables.TableRow("s")], [[tables.TableCell(), tables.TableCell()], [tables.TableCell(name="seven"), tables.TableCell()]])
    rows = []
    for body in ("A1", "$B$2", "y", "y[]", "seven", "C9", "none"):
        a = tables.address(table, body, 0)
        rows.append((f"{{{body}}}", a and a[0], a[1] if a and a[0] == "cell" else None, a[-1] if a else None))
    return spark.createDataFrame(rows, "body string, kind string, row long, column long")


# ---- slices, tiles, spectra by session ----
@query("slice_lap_store", f"WITH {S_SQL} SELECT idx - 300 AS idx, value FROM s WHERE channel_id = 'click' AND idx BETWEEN 300 AND 755")
def _slice_store(spark, sf_dir):
    data = SessionSet.from_samples(channels(spark, sf_dir), RATE)
    name, _ = data.slice_lap("click", "main", 2, *LAPS.bounds[1])
    return data.frame(name).select("idx", "value")


@query("tile", f"WITH {S_SQL}, b AS (SELECT channel_id, idx // 8 AS bucket, min(value) AS lo, max(value) AS hi FROM s WHERE idx < 8192 GROUP BY ALL), c AS (SELECT DISTINCT channel_id FROM s) SELECT c.channel_id, CAST(i AS BIGINT) AS bucket, coalesce(lo, 'NaN'::DOUBLE) AS min_value, coalesce(hi, 'NaN'::DOUBLE) AS max_value FROM c CROSS JOIN range(0, 1024) r(i) LEFT JOIN b ON b.channel_id = c.channel_id AND b.bucket = i")
def _tile(spark, sf_dir):
    return series.tile(channels(spark, sf_dir), 1, 0).select("channel_id", "bucket", "min_value", "max_value")


@query("slice_index", f"WITH {S_SQL} SELECT channel_id, idx, value FROM s WHERE idx >= 50 AND idx < 80")
def _slice_index(spark, sf_dir):
    return series.slice_by_index(channels(spark, sf_dir), 50, 80).select("channel_id", "idx", "value")


@query("value_at", f"WITH {S_SQL} SELECT channel_id, value FROM s WHERE idx = 100")
def _value_at(spark, sf_dir):
    return series.value_at(channels(spark, sf_dir), 100).select("channel_id", "value")


@query(
    "welch_sessions",
    """WITH e AS (SELECT user_id, event_type AS channel_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events),
z AS (SELECT *, least(c, 16) AS n, CASE WHEN c <= 16 THEN c - least(8, c - 1) ELSE 8 END AS hop FROM e), f AS (SELECT DISTINCT user_id, channel_id, n, hop, unnest(range(0, (c - n) // hop + 1)) AS frame FROM z),
d AS (SELECT f.user_id, f.channel_id, f.n, frame, z.i - frame * f.hop AS j, value FROM z JOIN f ON f.user_id = z.user_id AND f.channel_id = z.channel_id AND z.i >= frame * f.hop AND z.i < frame * f.hop + f.n),
k AS (SELECT *, avg(value) OVER g AS y, avg(j) OVER g AS x FROM d WINDOW g AS (PARTITION BY user_id, channel_id, frame)),
l AS (SELECT *, coalesce(sum((value - y) * (j - x)) OVER g / nullif(sum((j - x) * (j - x)) OVER g, 0), 0) AS b FROM k WINDOW g AS (PARTITION BY user_id, channel_id, frame)),
h AS (SELECT *, (value - y - b * (j - x)) * (CASE WHEN n = 1 THEN 1 ELSE 0.54 - 0.46 * cos(2 * pi() * j / nullif(n - 1, 0)) END) AS v, CASE WHEN n = 1 THEN 1 ELSE pow(0.54 - 0.46 * cos(2 * pi() * j / nullif(n - 1, 0)), 2) END AS w FROM l WHERE n > 2),
p AS (SELECT user_id, channel_id, n, frame, q AS bin, (pow(sum(v * cos(2 * pi() * j * q / n)), 2) + pow(sum(v * sin(2 * pi() * j * q / n)), 2)) / (10.0 * sum(w)) AS power FROM h, range(0, 9) r(q) WHERE q <= n // 2 GROUP BY ALL)
SELECT user_id, channel_id, CAST(bin AS BIGINT) AS bin, round(bin * 10.0 / n, 6) AS freq, round(avg(power) * CASE WHEN bin = 0 OR bin * 2 = n THEN 1 ELSE 2 END, 4) AS power FROM p GROUP BY user_id, channel_id, bin, n""",
)
def _welch_sessions(spark, sf_dir):
    """Channels of every length from 3 samples on: those no longer than a segment are one frame of their own length."""
    data = _by_user(spark, sf_dir)
    long_enough = data.channels.where("len > 2").select("session_id", "channel_id")
    out = series.welch(data.samples.join(long_enough, ["session_id", "channel_id"], "left_semi"), RATE, "hamming", 16, 8, "linear")
    return out.select(F.col("session_id").cast("long").alias("user_id"), "channel_id", "bin", F.round("freq", 6).alias("freq"), F.round("power", 4).alias("power"))


# ---- fixes, tracks, overlays ----
def _gps(spark, sf_dir) -> SessionSet:
    """A session with GPS channels at 5 Hz and a channel at 10 Hz; every seventh fix is (0, 0)."""
    f = _from_zero(fixes(spark, sf_dir))
    lost = F.col("idx") % 7 == 3
    each = F.array(*[F.struct(F.lit(n).alias("channel_id"), c.cast("double").alias("value")) for n, c in (("GPS_Latitude", F.when(lost, 0).otherwise(F.col("lat"))), ("GPS_Longitude", F.when(lost, 0).otherwise(F.col("lon"))), ("GPS_EpochMs", F.col("timestamp_ms") + 1))])
    made = f.select("session_id", "idx", (F.col("idx") / 5.0).alias("t"), F.explode(each).alias("c")).select("session_id", "c.channel_id", "idx", "t", "c.value")
    own = channels(spark, sf_dir).where("channel_id = 'click'")
    return SessionSet.from_samples(made.unionByName(own), {"GPS_Latitude": 5.0, "GPS_Longitude": 5.0, "GPS_EpochMs": 5.0, "click": RATE})


def _from_zero(f: DataFrame) -> DataFrame:
    """Fixes numbered from 0 on."""
    return f.withColumn("idx", F.col("idx") - F.lit(f.agg(F.min("idx")).first()[0]))


_GPS_SQL = X_SQL + ", k AS (SELECT idx - min(idx) OVER () AS i, ms + 1 AS ms, lat, lon FROM x), v AS (SELECT row_number() OVER (ORDER BY i) - 1 AS idx, i, ms, lat, lon FROM k WHERE i % 7 <> 3)"


@query("gps_track", f"WITH {_GPS_SQL} SELECT CAST(idx AS BIGINT) AS idx, ms AS timestamp_ms, lat, lon FROM v")
def _gps_track(spark, sf_dir):
    return Engine(spark, _gps(spark, sf_dir)).fixes().select("idx", "timestamp_ms", "lat", "lon")


@query("values_at_fixes", f"WITH {_GPS_SQL}, {S_SQL}, c AS (SELECT idx, value FROM s WHERE channel_id = 'click') SELECT CAST(v.idx AS BIGINT) AS idx, coalesce(c.value, 'NaN'::DOUBLE) AS value FROM v LEFT JOIN c ON c.idx = CAST(floor(v.i / 5.0 * 10 + 0.5) AS BIGINT)")
def _at_fixes(spark, sf_dir):
    return Engine(spark, _gps(spark, sf_dir)).at_fixes("click").select("idx", "value")


@query("map_points", f"WITH {_GPS_SQL}, b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d, count(*) AS n FROM v) SELECT CAST(idx AS BIGINT) AS idx, round((lon - c) / (d - c), 9) AS x, round((lat - a) / (b - a), 9) AS y FROM v, b WHERE idx % greatest(CAST(ceil(n / 1024) AS BIGINT), 1) = 0")
def _map_points(spark, sf_dir):
    f = Engine(spark, _gps(spark, sf_dir)).fixes().withColumn("t", F.col("idx") / 5.0)
    return overlay.map_line(overlay.normalised_map(f)).select("idx", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("map_position", f"WITH {X_SQL}, k AS (SELECT idx - min(idx) OVER () AS i, lat, lon FROM x), b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d, max(i) AS n FROM k), f AS (SELECT CAST(j AS BIGINT) AS frame, j * 3.0 AS t FROM range(0, (SELECT n FROM b) * 8 // 3 + 4) r(j)), p AS (SELECT frame, t, CAST(least(floor(t / 8), n) AS BIGINT) AS i FROM f, b) SELECT frame, CASE WHEN t - p.i * 8 <= 5 THEN round((lon - c) / (d - c), 9) END AS x, CASE WHEN t - p.i * 8 <= 5 THEN round((lat - a) / (b - a), 9) END AS y FROM p JOIN k ON k.i = p.i, b")
def _map_position(spark, sf_dir):
    """The place every three seconds, of fixes eight seconds apart, so that some are stale."""
    f = _from_zero(fixes(spark, sf_dir)).withColumn("t", F.col("idx") * 8.0)
    n = f.agg(F.max("idx")).first()[0] * 8 // 3 + 4
    norm = overlay.normalised_map(f)
    return overlay.map_position(overlay.frame_clock(spark, "s0", 1 / 3, n * 3.0), norm).select("frame", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("trace_strip", f"WITH {S_SQL}, c AS (SELECT idx, value, min(value) OVER () AS lo, max(value) OVER () AS hi, max(idx) OVER () AS last FROM s WHERE channel_id = 'click'), f AS (SELECT i AS frame, i * 5.0 AS t FROM range(0, (SELECT max(last) FROM c) // 50 + 2) r(i)), w AS (SELECT frame, t, greatest(ceil((t - 60) * 10), 0) AS lo_i, least(floor(t * 10), (SELECT max(last) FROM c)) AS hi_i FROM f), g AS (SELECT *, greatest(ceil((hi_i - lo_i + 1) / 256), 1) AS st FROM w WHERE hi_i >= lo_i) SELECT CAST(frame AS BIGINT) AS frame, CAST((idx - lo_i) / st AS BIGINT) AS k, round(least(greatest((idx / 10.0 - (t - 60)) / 60, 0), 1), 9) AS x, round((value - lo) / (hi - lo), 9) AS y FROM g JOIN c ON idx BETWEEN lo_i AND hi_i AND CAST(idx - lo_i AS BIGINT) % CAST(st AS BIGINT) = 0")
def _trace_strip(spark, sf_dir):
    """The strip of the last minute, every five seconds of the whole channel."""
    click = channels(spark, sf_dir).where("channel_id = 'click'")
    n = click.agg(F.max("idx")).first()[0] // 50 + 2
    out = overlay.trace(overlay.frame_clock(spark, "s0", 0.2, n * 5.0), click, RATE, 60.0)
    return out.select("frame", F.col("k").cast("long").alias("k"), F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("overlay_texts", "WITH v AS (SELECT event_id, value FROM events) SELECT event_id, printf('%d:%04.1f', CAST(floor(value / 60) AS BIGINT), value - 60 * floor(value / 60)) AS elapsed, printf('%d:%05.2f', CAST(floor(value * 1000) AS BIGINT) // 60000, (CAST(floor(value * 1000) AS BIGINT) % 60000) / 1000.0) AS lap, CASE WHEN value >= 10 THEN printf('%.1f', value) ELSE printf('%.2f', value) END AS shown FROM v")
def _texts(spark, sf_dir):
    v = _events(spark, sf_dir)
    return v.select("event_id", overlay.elapsed_text(F.col("value")).alias("elapsed"), overlay.lap_text(F.floor(F.col("value") * 1000)).alias("lap"), overlay.value_text(F.col("value")).alias("shown"))


@query("video_sync", "SELECT * FROM (VALUES (1::BIGINT, 2.0::DOUBLE, 'gpmf', 0.9::DOUBLE), (2, 4.0, 'creation_time', 0.3), (3, NULL, 'no_overlap', NULL), (4, NULL, 'parse', NULL)) v(case_id, offset_s, method, confidence)")
def _sync(spark, sf_dir):
    rows = []
    for k, args in enumerate((((2.0, 5000.0), None), (None, 5000.0), (None, 1e6), (None, None)), 1):
        try:
            rows.append((k, *overlay.sync(*args, 10.0, 1000.0, 60.0)))
        except Exception as e:
            rows.append((k, None, getattr(e, "kind", "?"), None))
    return spark.createDataFrame(rows, "case_id long, offset_s double, method string, confidence double")


_TRACK = {
    "track_artifact_version": 1,
    "track": {
        "track_id": "t", "name": "loop", "venue_name": "v",
        "lap_timing": {"kind": "circuit", "start_finish": {"lat1_deg": GATE.lat1, "lon1_deg": GATE.lon1, "lat2_deg": GATE.lat2, "lon2_deg": GATE.lon2}},
        "sector_gates": [{"name": "first", "gate": {"lat1_deg": SECTOR.lat1, "lon1_deg": SECTOR.lon1, "lat2_deg": SECTOR.lat2, "lon2_deg": SECTOR.lon2}}],
    },
}


@query("track_laps", f"WITH {_CIRCUIT}, {_cross_sql('c2', SECTOR)}, f AS (SELECT min(ms) AS o FROM x), b AS (SELECT lap, start_ms, end_ms, (SELECT min(c2.ms) FROM c2 JOIN st ON st.idx = c2.idx WHERE st.a_ms >= l.start_ms AND st.ms <= l.end_ms) AS m FROM l) SELECT CAST(lap AS BIGINT) AS lap, round((start_ms - o) / 1000.0, 3) AS start_s, round((end_ms - o) / 1000.0, 3) AS end_s, end_ms - start_ms AS lap_time_ms, CASE WHEN m IS NULL THEN 1 ELSE 2 END::BIGINT AS n_sectors FROM b, f")
def _track_laps(spark, sf_dir):
    """Laps and sectors of a track artifact over a recording's GPS channels."""
    f = fixes(spark, sf_dir)
    artifact = config.read_track(json.dumps(_TRACK))
    out = laps.detect_laps(f, artifact.layout)
    return out.select("lap", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "lap_time_ms", F.size("sectors").cast("long").alias("n_sectors"))


@query("lap_panel_all", f"WITH {_CIRCUIT}, f AS (SELECT min(ms) AS o, max(ms) AS z FROM x), q AS (SELECT lap, (start_ms - o) / 1000.0 AS a, (end_ms - o) / 1000.0 AS b, end_ms - start_ms AS ms FROM l, f), t AS (SELECT CAST(i AS BIGINT) AS frame, i * (z - o) / 1000.0 / 2000 AS t FROM f, range(0, 2000) r(i)) SELECT frame, max(CASE WHEN t >= a AND t < b THEN lap END) AS current_lap, round(coalesce(max(CASE WHEN t >= a AND t < b THEN t - a END), 0.0), 3) AS lap_elapsed_s, arg_max(ms, lap) FILTER (t >= b) AS last_lap_ms, min(ms) FILTER (t >= b) AS best_lap_ms FROM t CROSS JOIN q GROUP BY frame")
def _panel_all(spark, sf_dir):
    """The panel over the whole recording, with every lap of its fixes (collected: laps of one session)."""
    f = fixes(spark, sf_dir)
    found = laps.detect_laps(f, laps.Layout(laps.Timing("circuit", GATE))).orderBy("lap").collect()
    lo, hi = f.agg(F.min("timestamp_ms"), F.max("timestamp_ms")).first()
    frames = spark.range(2000).select(F.lit("s0").alias("session_id"), F.col("id").alias("frame"), (F.col("id") * ((hi - lo) / 1000.0) / 2000).alias("t"))
    out = overlay.lap_panel(frames, [(r.lap, r.start_s, r.end_s, r.lap_time_ms) for r in found])
    return out.select("frame", "current_lap", F.round("lap_elapsed_s", 3).alias("lap_elapsed_s"), "last_lap_ms", "best_lap_ms")


@query("bounding_boxes", f"WITH {X_SQL}, b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM x), t(track_id, la, lo) AS (VALUES ('near', 450005000.0, 60005000.0), ('far', 470000000.0, 60000000.0)) SELECT track_id, la BETWEEN a AND b AND lo BETWEEN c AND d AS near FROM t, b")
def _boxes(spark, sf_dir):
    from .operators import tracks

    f = fixes(spark, sf_dir)
    lines = {"near": [(450005000.0, 60005000.0), (450005001.0, 60005001.0)], "far": [(470000000.0, 60000000.0), (470000001.0, 60000001.0)]}
    kept = tracks.candidates(f, lines)
    return spark.createDataFrame([(k, k in kept) for k in lines], "track_id string, near boolean")


@query("positional_join", f"WITH {S_SQL} SELECT a.idx, a.value AS x, b.value AS y FROM s a JOIN s b ON a.idx = b.idx AND a.channel_id = 'signup' AND b.channel_id = 'error'")
def _positional(spark, sf_dir):
    s = channels(spark, sf_dir)
    side = lambda name, c: s.where(F.col("channel_id") == name).select("session_id", "idx", F.col("value").alias(c))
    return joins.positional(side("signup", "x"), side("error", "y")).select("idx", "x", "y")


@query("grid_rows", f"WITH {S_SQL} SELECT idx, max(value) FILTER (channel_id = 'click') AS click, max(value) FILTER (channel_id = 'view') AS view FROM s WHERE channel_id IN ('click', 'view') GROUP BY idx")
def _grid_rows(spark, sf_dir):
    return grid(channels(spark, sf_dir), ["click", "view"]).select("idx", F.col("ch_click").alias("click"), F.col("ch_view").alias("view"))


# ---- statistics and vectors ----
@query("dynamic_sag", f"WITH {S_SQL} SELECT channel_id, round(median(value) FILTER (value <= 20), 6) AS sag, round(avg(value) FILTER (value > 20), 6) AS bias FROM s GROUP BY channel_id")
def _dynamic_sag(spark, sf_dir):
    v = F.col("value")
    return channels(spark, sf_dir).groupBy("channel_id").agg(F.round(aggregate.dynamic_sag(v, v > 20), 6).alias("sag"), F.round(aggregate.bias(v, v > 20), 6).alias("bias"))


_E3 = "e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS p, CAST(embedding[5] AS DOUBLE) AS q, CAST(embedding[6] AS DOUBLE) AS r FROM embeddings)"


def _vectors(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyzpqr")])


@query("lever_arm", f"WITH {_E3}, w AS (SELECT *, q * 0.1 - r * 0.2 AS a, r * 0.3 - p * 0.1 AS b, p * 0.2 - q * 0.3 AS c FROM e) SELECT vec_id, round(x + (y * 0.1 - z * 0.2) + (q * c - r * b), 9) + 0.0 AS ax, round(y + (z * 0.3 - x * 0.1) + (r * a - p * c), 9) AS ay, round(z + (x * 0.2 - y * 0.3) + (p * b - q * a), 9) AS az FROM w")
def _lever(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    of = lambda names: vector.Vec(*[F.col(c) for c in names])
    out = vector.lever_arm(of("xyz"), of("xyz"), of("pqr"), vector.Vec(F.lit(0.3), F.lit(0.2), F.lit(0.1)))
    return v.select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(out, ("ax", "ay", "az"), strict=True)])


@query(
    "rotations",
    f"""WITH {_E3}, n AS (SELECT *, sqrt(x*x + y*y + z*z) AS a, sqrt(p*p + q*q + r*r) AS b FROM e WHERE x*x + y*y + z*z > 0 AND p*p + q*q + r*r > 0), m AS (SELECT *, sin(a) / a AS s, (1 - cos(a)) / (a * a) AS c, x*p + y*q + z*r AS d FROM n)
SELECT vec_id, round(p + s * (y*r - z*q) + c * (x * d - a * a * p), 8) AS turned_x, round(q + s * (z*p - x*r) + c * (y * d - a * a * q), 8) AS turned_y, round(r + s * (x*q - y*p) + c * (z * d - a * a * r), 8) AS turned_z,
round(x, 8) AS log_x, round(y, 8) AS log_y, round(z, 8) AS log_z, round(p / b, 8) AS to_x, round(q / b, 8) AS to_y, round(r / b, 8) AS to_z, 0.0::DOUBLE AS up_x, 0.0::DOUBLE AS up_y, round(a, 8) AS up_z,
0.0::DOUBLE AS split_error, 0.0::DOUBLE AS twist_tilt, 0.0::DOUBLE AS vee_error, 0.0::DOUBLE AS adjoint_error, 0.0::DOUBLE AS jacobian_error, 0.0::DOUBLE AS quaternion_error FROM m WHERE a < 3.1""",
)
def _rotations(spark, sf_dir):
    """exp, log, between, from_gravity and swing_twist over pairs of vectors; the rest by identities that hold (0)."""
    import numpy as np

    names = ("turned_x", "turned_y", "turned_z", "log_x", "log_y", "log_z", "to_x", "to_y", "to_z", "up_x", "up_y", "up_z", "split_error", "twist_tilt", "vee_error", "adjoint_error", "jacobian_error", "quaternion_error")

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for k, x, y, z, p, q, r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                u, v = np.array([x, y, z]), np.array([p, q, r])
                if not u.any() or not v.any() or np.linalg.norm(u) >= 3.1:
                    continue
                m = rotation.exp(u)
                swing, twist = rotation.swing_twist(m, v)
                half = np.linalg.norm(u) / 2
                quaternion = rotation.from_quaternion(np.cos(half), *(u / (2 * half) * np.sin(half)))
                step = 1e-6 * v
                near = rotation.log(m.T @ rotation.exp(u + step)) / 1e-6
                errors = (np.abs(swing @ twist - m).max(), np.abs(twist @ v - v).max(), np.abs(rotation.vee(rotation.skew(v)) - v).max(), np.abs(rotation.adjoint(m, v)[3:, :3] @ u - np.cross(v, m @ u)).max(), np.abs(rotation.right_jacobian(u) @ v - near).max() * 1e-3, np.abs(quaternion - m).max())
                ids.append(k)
                rows.append((*(m @ v), *rotation.log(m), *(rotation.between(u, v) @ u / np.linalg.norm(u)), *(rotation.from_gravity(u).reshape(3, 3) @ u), *errors))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]], ["vec_id", *names])

    out = _vectors(spark, sf_dir).mapInArrow(run, "vec_id long, " + ", ".join(f"{n} double" for n in names))
    return out.select("vec_id", *[(F.round(n, 8) + 0.0).alias(n) for n in names])


@query("arc_length", f"WITH {X_SQL}, d AS (SELECT idx, sqrt(pow(lat - lag(lat) OVER o, 2) + pow(lon - lag(lon) OVER o, 2)) AS s FROM x WINDOW o AS (ORDER BY idx)) SELECT idx, round(sum(coalesce(s, 0)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 1) AS length FROM d")
def _arc(spark, sf_dir):
    from .operators.blocked import running_sum, windowed

    f = fixes(spark, sf_dir)
    step = windowed(f, ["session_id"], "idx", 1, 0, lambda w: {"__s": F.coalesce(F.sqrt(F.pow(F.col("lat") - F.lag("lat").over(w), 2) + F.pow(F.col("lon") - F.lag("lon").over(w), 2)), F.lit(0.0))})
    return running_sum(step, ["session_id"], "idx", F.col("__s"), "length").select("idx", F.round("length", 1).alias("length"))


@query("lap_start_distance", f"WITH {S_SQL}, d AS (SELECT idx, sum(value) OVER (ORDER BY idx) AS d FROM s WHERE channel_id = 'click') SELECT idx, round(CASE WHEN idx < 300 THEN (SELECT d FROM d WHERE idx = 0) WHEN idx < 755 THEN (SELECT d FROM d WHERE idx = 300) WHEN idx < 1200 THEN (SELECT d FROM d WHERE idx = 755) ELSE 'NaN'::DOUBLE END, 4) AS value FROM d")
def _lap_distance(spark, sf_dir):
    from .operators.blocked import running_sum

    click = channels(spark, sf_dir).where("channel_id = 'click'")
    far = running_sum(click, ["session_id"], "idx", F.col("value"), "__d").select("session_id", F.lit("Distance").alias("channel_id"), "idx", "t", F.col("__d").alias("value"))
    out, _, _ = evaluate(SessionSet.from_samples(far, RATE), "lap_start_distance(current_lap()) + 0 * [Distance]", LAPS)
    return out.select("idx", F.round("value", 4).alias("value"))


# ---- parts of the estimator ----
@query("gps_velocity", "SELECT event_id, round(value / 3.6 * cos(radians(user_id * 2)), 9) + 0.0 AS north, round(-value / 3.6 * sin(radians(user_id * 2)), 9) + 0.0 AS west FROM events WHERE event_type <> 'error'")
def _gps_velocity(spark, sf_dir):
    """Velocities of fixes whose speed is the event's value and whose course goes by the user; errors have no quality."""
    import numpy as np

    from .kernels import estimate

    def run(batches):
        for batch in batches:
            event, value, user, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            t, v = estimate.gps_velocity(event.astype(np.float64), value, user * 200.0, np.where(kind == "error", 0.0, 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(v[:, 0]), pa.array(v[:, 1])], ["event_id", "north", "west"])

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id", "event_type")
    return e.mapInArrow(run, "event_id long, north double, west double").select("event_id", F.round("north", 9).alias("north"), F.round("west", 9).alias("west"))


@query("axle_forces", f"WITH {S_SQL}, g AS (SELECT a.idx, a.value * 0.01 AS z, radians(b.value) AS w FROM s a JOIN s b ON a.idx = b.idx AND a.channel_id = 'click' AND b.channel_id = 'view'), d AS (SELECT idx, z, coalesce((lead(w) OVER o - lag(w) OVER o) * 5, (lead(w) OVER o - w) * 10, (w - lag(w) OVER o) * 10, 0) AS a FROM g WINDOW o AS (ORDER BY idx)) SELECT idx, round(z * 9.81 + 0.835 * a, 6) AS front, round(z * 9.81 - 0.445 * a, 6) AS rear FROM d")
def _axles(spark, sf_dir):
    from .operators.suspension import axle_forces

    s = common(spark, sf_dir, ("click", "view")).samples
    name = F.when(F.col("channel_id") == "click", "IMU0_AccelZ").otherwise("IMU0_GyroY")
    made = s.select("session_id", name.alias("channel_id"), "idx", "t", F.when(F.col("channel_id") == "click", F.col("value") * 0.01).otherwise(F.col("value")).alias("value"))
    out = axle_forces(SessionSet.from_samples(made, RATE))
    return out.select("idx", F.round("front", 6).alias("front"), F.round("rear", 6).alias("rear"))


@query("estimator_flags", f"WITH {S_SQL}, m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM s WHERE channel_id IN ('click', 'view', 'error') GROUP BY channel_id)), g AS (SELECT idx, 9.81 * sqrt(sum(pow(value * CASE channel_id WHEN 'error' THEN 0.005 ELSE 0.0002 END, 2))) AS a FROM s, m WHERE channel_id IN ('click', 'view', 'error') AND idx < m.n GROUP BY idx), f AS (SELECT idx, a, coalesce(stddev_pop(a) OVER (ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) < 1.5 AS still, a < 2.5 AS quiet FROM g) SELECT idx, round(a, 6) AS accel_norm, still AS stationary, quiet OR (coalesce(lag(quiet) OVER o, FALSE) AND coalesce(lead(quiet) OVER o, FALSE)) AS airborne FROM f WINDOW o AS (ORDER BY idx)")
def _flags(spark, sf_dir):
    """What the estimator sees of a recording with one unit's accelerations: their norm, and when it stands or flies."""
    from .kernels import estimate
    from .operators.suspension import suspension_trace

    s = common(spark, sf_dir, ("click", "view", "error")).samples
    pick = lambda *x: F.when(F.col("channel_id") == "click", x[0]).when(F.col("channel_id") == "view", x[1]).otherwise(x[2])
    made = s.select("session_id", pick("IMU0_AccelX", "IMU0_AccelY", "IMU0_AccelZ").alias("channel_id"), "idx", "t", (F.col("value") * pick(0.0002, 0.0002, 0.005)).alias("value"))
    out = suspension_trace(SessionSet.from_samples(made, RATE), config=estimate.Config(zupt_accel_std=1.5))
    return out.select("idx", F.round("accel_norm", 6).alias("accel_norm"), "stationary", "airborne")


def _wheel_sql() -> str:
    """The forward filter and the backward pass, step by step for all users at once; each update in its closed form."""
    dt, q0, q1 = 0.1, 1e-3**2 * 0.1, 5.0**2 * 0.1

    def velocity(test: str, source: str, sigma: float) -> str:  # the velocity is seen to be 0
        s, v = f"(p11 + {sigma * sigma!r})", f"{sigma * sigma!r}"
        new = {"x0": f"x0 - p01 / {s} * x1", "x1": f"x1 - p11 / {s} * x1", "p00": f"p00 - p01 * p01 / {s}", "p01": f"p01 * {v} / {s}", "p11": f"p11 * {v} / {s}"}
        return f"SELECT user_id, i, drive, still, air, {', '.join(f'CASE WHEN {test} THEN {e} ELSE {k} END AS {k}' for k, e in new.items())} FROM ({source})"

    def place(test: str, target: str, source: str, sigma: float) -> str:  # the travel is seen to be the target
        s, v = f"(p00 + {sigma * sigma!r})", f"{sigma * sigma!r}"
        new = {"x0": f"x0 + p00 / {s} * ({target} - x0)", "x1": f"x1 + p01 / {s} * ({target} - x0)", "p00": f"p00 * {v} / {s}", "p01": f"p01 * {v} / {s}", "p11": f"p11 - p01 * p01 / {s}"}
        return f"SELECT user_id, i, drive, still, air, {', '.join(f'CASE WHEN {test} THEN {e} ELSE {k} END AS {k}' for k, e in new.items())} FROM ({source})"

    ahead = f"SELECT m.user_id, m.i, m.drive, m.still, m.air, x0 + {dt} * x1 AS x0, x1 + m.drive * {dt} AS x1, p00 + 2 * {dt} * p01 + {dt * dt!r} * p11 + {q0!r} AS p00, p01 + {dt} * p11 AS p01, p11 + {q1!r} AS p11 FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1"
    seen = velocity("still", ahead, 0.02)
    seen = velocity("air", place("air", "0.0", seen, 0.01), 0.02)
    seen = place("x0 < 0 OR x0 > 0.17", "CASE WHEN x0 < 0 THEN 0.0 ELSE 0.17 END", seen, 0.005)
    spread = f"p00 + 2 * {dt} * p01 + {dt * dt!r} * p11 + {q0!r} AS s00, p01 + {dt} * p11 AS s01, p11 + {q1!r} AS s11"
    gain = f"(p00 + {dt} * p01) AS a, p01 AS b, (p01 + {dt} * p11) AS c, p11 AS d"  # the covariance times the transposed step
    back = f"SELECT f.user_id, f.i, f.x0, f.x1, k.x0 - (f.x0 + {dt} * f.x1) AS r0, k.x1 - (f.x1 + m.drive * {dt}) AS r1, {spread}, {gain} FROM k JOIN f ON f.user_id = k.user_id AND f.i = k.i - 1 AND f.i >= 0 JOIN m ON m.user_id = k.user_id AND m.i = k.i"
    back = back.replace("p00", "f.p00").replace("p01", "f.p01").replace("p11", "f.p11")
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i, (value - 40) * 0.05 AS drive, event_type = 'click' AS still, event_type = 'view' AS air FROM events),
f AS (SELECT DISTINCT user_id, -1::BIGINT AS i, 0.0::DOUBLE AS drive, FALSE AS still, FALSE AS air, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0025::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11 FROM m UNION ALL {seen}),
k AS (SELECT user_id, max(i) AS i, arg_max(x0, i) AS x0, arg_max(x1, i) AS x1 FROM f GROUP BY user_id UNION ALL SELECT user_id, i, x0 + ((a * s11 - b * s01) * r0 + (b * s00 - a * s01) * r1) / (s00 * s11 - s01 * s01), x1 + ((c * s11 - d * s01) * r0 + (d * s00 - c * s01) * r1) / (s00 * s11 - s01 * s01) FROM ({back}))
SELECT user_id, i AS idx, round(x0, 6) + 0.0 AS travel, round(x1, 6) + 0.0 AS velocity FROM k"""


@query("wheel_smoothing", _wheel_sql())
def _wheel(spark, sf_dir):
    """The estimator's two-state filter and smoother, a recording for each user: standing at clicks, in the air at views."""
    import numpy as np

    from .kernels import estimate

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_id")
        kind, value = np.array(table["event_type"].to_pylist()), table["value"].to_numpy()
        travel, velocity = estimate.smooth_wheel((value - 40) * 0.05, kind == "click", kind == "view", 0.1, 0.17, 0.27 * 0.17, estimate.Config())
        n = len(value)
        return pa.table({"user_id": pa.array([table["user_id"][0].as_py()] * n, pa.int64()), "idx": pa.array(np.arange(n)), "travel": travel, "velocity": velocity})

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
    out = e.groupBy("user_id").applyInArrow(run, "user_id long, idx long, travel double, velocity double")
    return out.select("user_id", "idx", F.round("travel", 6).alias("travel"), F.round("velocity", 6).alias("velocity"))


# ---- heart rate, rollups, probes, diagnostics ----
@query("heart_rate", f"WITH {_U_SQL} SELECT user_id, i AS idx, 1704067200000 + user_id + round(us / 1e6 * 1000) AS wall_ms, value FROM u WHERE k = 'click'")
def _heart(spark, sf_dir):
    """Beats by wall clock: a session for each user, its clicks as heart rate at times of their own."""
    e = _by_user_events(spark, sf_dir).withColumn("channel_id", F.lit("HR_BPM"))
    data = SessionSet.from_samples(e, {"HR_BPM": 0.0})
    data.sessions = e.select("session_id").distinct().withColumn("timestamp_utc_ms", 1_704_067_200_000 + F.col("session_id").cast("long"))
    out = Engine(spark, data).heart_rate().join(e.select("session_id", "idx", (1_704_067_200_000 + F.col("session_id").cast("long") + F.round(F.col("t") * 1000)).alias("t"), "value"), ["session_id", "t", "value"])
    return out.select(F.col("session_id").cast("long").alias("user_id"), "idx", F.col("t").alias("wall_ms"), "value")


def _by_user_events(spark, sf_dir) -> DataFrame:
    """Clicks of each user at their own times, in seconds of 2024."""
    from .operators.blocked import dense_index

    e = _events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").cast("string").alias("session_id"), "event_id", "us", "value")
    return dense_index(e, ["session_id"], "event_id").select("session_id", F.lit("click").alias("channel_id"), "idx", (F.col("us") / 1e6).alias("t"), "value")


@query("fit_rollup", f"WITH {_FIT_SQL}, h AS (SELECT *, CASE WHEN k % 2 = 0 THEN CAST(60 + k % 100 AS BIGINT) END AS hr FROM r) SELECT user_id, CAST(max(ms) - min(ms) AS DOUBLE) / 1000 AS elapsed_s, round(max(m), 2) AS distance_m, round(avg(value / 3.6), 6) AS avg_speed, round(max(value / 3.6), 6) AS max_speed, CAST(floor(sum(hr) / count(hr)) AS BIGINT) AS avg_hr, max(hr) AS max_hr, count(*) AS fixes FROM h GROUP BY user_id")
def _rollup(spark, sf_dir):
    from .operators.blocked import dense_index

    f = fixes(spark, sf_dir).drop("session_id").join(_events(spark, sf_dir).select("event_id", "user_id", "value"), F.col("idx") == F.col("event_id"))
    own = f.select(F.col("user_id").cast("string").alias("session_id"), "idx", "timestamp_ms", "lat", "lon", F.col("value").alias("speed"))
    records = dense_index(fit.activity_records(own).drop("hr"), ["session_id"], "idx", "k")
    out = fit.session_rollup(records.drop("idx").withColumnRenamed("k", "idx").withColumn("hr", F.when(F.col("idx") % 2 == 0, 60 + F.col("idx") % 100)))
    mean = F.round(F.col("avg_speed") * 1e6) / 1e6  # of the scaled double, as the SQL rounds: means of cents end in halves
    return out.select(F.col("session_id").cast("long").alias("user_id"), "elapsed_s", F.round("distance_m", 2).alias("distance_m"), mean.alias("avg_speed"), F.round("max_speed", 6).alias("max_speed"), "avg_hr", "max_hr", "fixes")


_PROBE = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1", "side_data_list": [{"rotation": -90}]}], "format": {"duration": "12.5"}}


@query("video_probe", "SELECT * FROM (VALUES ('probe', 1920::DOUBLE, 1080::DOUBLE, round(30000 / 1001.0, 6), 12.5::DOUBLE, 270::DOUBLE, 1::DOUBLE), ('clip', 2.0, 10.0, 300.0, NULL, NULL, NULL), ('clip_past', 10.0, 10.0, 0.0, NULL, NULL, NULL), ('time', 1704166205500.0, NULL, NULL, NULL, NULL, NULL)) v(what, a, b, c, d, e, f)")
def _video_probe(spark, sf_dir):
    p = video.parse_probe(json.dumps(_PROBE))
    clip, past = video.clip_range(2.0, None, 10.0), video.clip_range(11.0, 12.0, 10.0)
    rows = [("probe", float(p["width"]), float(p["height"]), round(p["fps"], 6), p["duration_s"], float(p["rotation"]), float(p["has_audio"]))]
    rows += [(n, *c, float(video.frame_count(37.5, c[1] - c[0])), None, None, None) for n, c in (("clip", clip), ("clip_past", past))]
    rows.append(("time", float(video.gps_time(b"240102033005.500")), None, None, None, None, None))
    return spark.createDataFrame(rows, "what string, a double, b double, c double, d double, e double, f double")


_DIAGNOSTICS = """==== BOOT reason=BROWNOUT heap=1200 ====
t=12 EVT IMU0 spi drains=10 pairs=200 ovr=3 read_us=40/90 tot_us=55/120
t=14 EVT IMU cycle_max_us=700 writer_drops=1 poll_ms=5 cap=64
t=16 heap=1 min=2 heap=3
==== BOOT reason=POWERON reason=X ===="""


@query("diagnostic_lines", "SELECT * FROM (VALUES ('boot', NULL, 'BROWNOUT', NULL, NULL::BIGINT, NULL::BIGINT, NULL), ('drain', '12', NULL, 'IMU0', 3, 90, 'overruns'), ('cycle', '14', NULL, NULL, NULL, NULL, 'writer_drops'), ('boot', NULL, 'POWERON', NULL, NULL, NULL, NULL)) v(kind, t, reason, imu, ovr, read_max_us, flag)")
def _diagnostics(spark, sf_dir):
    from .operators.synthesis import diagnostic_report

    lines = spark.createDataFrame([(x,) for x in _DIAGNOSTICS.split("\n")], "value string")
    return diagnostic_report(lines).select("kind", "t", "reason", "imu", "ovr", "read_max_us", "flag")
