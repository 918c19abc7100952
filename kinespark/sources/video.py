"""Video containers: ISO base media boxes, GoPro telemetry, ffprobe and ffmpeg arguments."""

from __future__ import annotations

import datetime
import json
import math
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError

#: Seconds from 1904, the container's epoch, to 1970.
EPOCH_1904 = 2_082_844_800
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """(type, first byte of the body, end) of the boxes in a range; 64-bit and to-the-end sizes included."""
    end = len(data) if end is None else end
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            return
        yield kind, body, at + size
        at += size


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    stts: list[tuple[int, int]] = field(default_factory=list)
    stsc: list[tuple[int, int, int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)


@dataclass
class Info:
    width: int
    height: int
    fps: float
    duration_s: float
    creation_ms: int | None
    has_telemetry: bool
    tracks: list[Track]


def _pairs(data: bytes, at: int, form: str) -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, at)
    step = struct.calcsize(">" + form)
    return [struct.unpack_from(">" + form, data, at + 4 + i * step) for i in range(n)]


def _track(data: bytes, start: int, end: int, t: Track) -> Track:
    for kind, a, b in boxes(data, start, end):
        if kind in _CONTAINERS:
            _track(data, a, b, t)
        elif kind == b"tkhd":
            t.width, t.height = (x >> 16 for x in struct.unpack_from(">II", data, b - 8))
        elif kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        elif kind == b"hdlr":
            t.handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd" and b - a >= 16:
            t.codec = data[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stts":
            t.stts = _pairs(data, a + 4, "II")
        elif kind == b"stsc":
            t.stsc = _pairs(data, a + 4, "III")
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", data, a + 4)
            t.sizes = [each] * n if each else list(struct.unpack_from(f">{n}I", data, a + 12))
        elif kind == b"stco":
            t.offsets = [x[0] for x in _pairs(data, a + 4, "I")]
        elif kind == b"co64":
            t.offsets = [x[0] for x in _pairs(data, a + 4, "Q")]
    return t


def read_info(data: bytes) -> Info:
    """Size, frame rate (samples over media duration), duration and creation time of an MP4."""
    created, scale, length, tracks = None, 0, 0, []
    moov = next(((a, b) for kind, a, b in boxes(data) if kind == b"moov"), None)
    if moov is None:
        raise InputError("parse", "no moov box")
    for kind, a, b in boxes(data, *moov):
        if kind == b"mvhd":
            made, _, scale, length = struct.unpack_from(">QQIQ", data, a + 4) if data[a] else struct.unpack_from(">IIII", data, a + 4)
            created = (made - EPOCH_1904) * 1000 if made > EPOCH_1904 else None
        elif kind == b"trak":
            tracks.append(_track(data, a, b, Track()))
    video = next((t for t in tracks if t.handler == "vide"), None)
    if video is None:
        raise InputError("parse", "no video track")
    seconds = video.duration / video.timescale if video.timescale else 0.0
    frames = sum(n for n, _ in video.stts)
    return Info(video.width, video.height, frames / seconds if seconds else 0.0, length / scale if scale else seconds, created, any(t.codec == "gpmd" for t in tracks), tracks)


def telemetry_samples(data: bytes, t: Track) -> list[tuple[float, bytes]]:
    """(start in s, payload) of a track's samples, from its time, chunk and size tables."""
    times, at = [], 0
    for n, delta in t.stts:
        for _ in range(n):
            times.append(at / t.timescale)
            at += delta
    out, sample = [], 0
    for chunk, offset in enumerate(t.offsets, 1):
        per = next((n for first, n, _ in reversed(t.stsc) if first <= chunk), 0)
        for _ in range(per):
            if sample >= len(t.sizes):
                break
            size = t.sizes[sample]
            out.append((times[sample] if sample < len(times) else 0.0, data[offset : offset + size]))
            offset += size
            sample += 1
    return out


def klv(data: bytes):
    """(key, type, size of a structure, value) of GPMF items, padded to 4 bytes."""
    at = 0
    while at + 8 <= len(data):
        key, kind, size, count = struct.unpack_from(">4scBH", data, at)
        if key == b"\0\0\0\0":
            return
        n = size * count
        if at + 8 + n > len(data):
            raise InputError("parse", f"GPMF item {key!r} runs past its payload")
        yield key, kind, size, data[at + 8 : at + 8 + n]
        at += 8 + (n + 3) // 4 * 4


def gps_time(text: bytes) -> int | None:
    """Epoch ms of yymmddhhmmss.sss."""
    s = text.decode("ascii", "replace").rstrip("\0").strip()
    try:
        day = datetime.datetime(2000 + int(s[0:2]), int(s[2:4]), int(s[4:6]), tzinfo=datetime.UTC)
        return int(day.timestamp()) * 1000 + int((int(s[6:8]) * 60 + int(s[8:10])) * 60_000 + float(s[10:]) * 1000)
    except ValueError:
        return None


def _streams(payload: bytes):
    for key, _, _, value in klv(payload):
        if key == b"DEVC":
            yield from _streams(value)
        elif key == b"STRM":
            rows, scale, when, nine = [], [], None, False
            for k, kind, size, v in klv(value):
                if k == b"GPS5" and kind == b"l" and size == 20:
                    rows, nine = [struct.unpack_from(">5i", v, i) for i in range(0, len(v) - 19, 20)], False
                elif k == b"GPS9" and size >= 36 and not rows:
                    rows, nine = [struct.unpack_from(">9i", v, i) for i in range(0, len(v) - size + 1, size)], True
                elif k == b"SCAL" and kind == b"l":
                    scale = [x[0] for x in struct.iter_unpack(">i", v[: len(v) // 4 * 4])]
                elif k == b"GPSU" and kind in (b"U", b"c"):
                    when = gps_time(v)
            if rows:
                yield rows, scale, when, nine


def telemetry(samples: list[tuple[float, bytes]]):
    """(fixes (t_s, lat, lon, m/s), (video s, epoch ms) of the first payload with a time, or None). The rows of a payload
    are spread evenly up to the next one; the last takes the span before it, a lone one a second."""
    fixes, anchor = [], None
    for i, (t, payload) in enumerate(samples):
        if not payload:
            continue
        span = max(0.0, samples[i + 1][0] - t) if i + 1 < len(samples) else max(0.0, t - samples[i - 1][0]) if i else 1.0
        for rows, scale, when, nine in _streams(payload):
            if when is None and nine:
                per = scale[6] if len(scale) > 6 else 1000.0
                when = (10_957 + rows[0][5]) * 86_400_000 + int(rows[0][6] / per * 1000.0)
            if anchor is None and when is not None:
                anchor = (t, when)
            s = lambda k: float(scale[k]) if len(scale) > k and scale[k] else 1.0  # noqa: B023, E731
            fixes += [(t + span * j / len(rows), r[0] / s(0), r[1] / s(1), r[3] / s(3)) for j, r in enumerate(rows)]
    return fixes, anchor


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, lat, lon, mps) of the fixes in MP4 files, a task per file."""

    def run(batches):
        for batch in batches:
            for p, c in zip(batch.column(0), batch.column(1), strict=True):
                data = c.as_py()
                rows = [f for t in read_info(data).tracks if t.codec == "gpmd" for f in telemetry(telemetry_samples(data, t))[0]]
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]], ["path", "t", "lat", "lon", "mps"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, t double, lat double, lon double, mps double")


def parse_probe(text: str) -> dict:
    """Size, frame rate, duration, rotation and audio of ffprobe's JSON; the average rate, else the nominal one."""
    doc = json.loads(text)
    video = next((s for s in doc.get("streams", []) if s.get("codec_type") == "video"), None)
    if video is None:
        raise InputError("parse", "no video stream")

    def rate(key):
        a, _, b = video.get(key, "0/0").partition("/")
        return float(a) / float(b) if b and float(b) else 0.0

    turn = next((int(x["rotation"]) for x in video.get("side_data_list", []) if "rotation" in x), int(video.get("tags", {}).get("rotate", 0)))
    return {"width": video["width"], "height": video["height"], "fps": rate("avg_frame_rate") or rate("r_frame_rate"), "duration_s": float(doc.get("format", {}).get("duration", video.get("duration", 0.0))), "rotation": turn % 360, "has_audio": any(s.get("codec_type") == "audio" for s in doc["streams"])}


def frame_count(fps: float, duration_s: float) -> int:
    return math.ceil(fps * duration_s)


def clip_range(start: float, end: float | None, duration_s: float) -> tuple[float, float]:
    """A clip within the video."""
    a = min(max(0.0, start), duration_s)
    return a, min(max(a, duration_s if end is None else end), duration_s)


def encode_arguments(source: str, target: str, probe: dict, clip: tuple[float, float], canvas: tuple[int, int]) -> list[str]:
    """ffmpeg arguments that lay raw RGBA frames of stdin over a clip; the target is written beside and renamed."""
    w, h = (probe["height"], probe["width"]) if probe["rotation"] in (90, 270) else (probe["width"], probe["height"])
    out = ["-y", "-ss", f"{clip[0]:.6f}", "-t", f"{clip[1] - clip[0]:.6f}", "-i", source, "-f", "rawvideo", "-pix_fmt", "rgba", "-s", f"{canvas[0]}x{canvas[1]}", "-r", f"{probe['fps']:.6f}", "-i", "-", "-filter_complex", f"[1:v]scale={w}:{h}[o];[0:v][o]overlay=0:0"]
    return out + (["-c:a", "copy"] if probe["has_audio"] else []) + ["-c:v", "libx264", "-f", "mp4", f"{target}.part"]


#: Frames drawn at once before they are handed on in order; bytes of ffmpeg's last words that an error quotes.
CHUNK, TAIL = 32, 2000


def export_video(frames, target: str, arguments: list[str], ffmpeg: str = "ffmpeg", cancelled=lambda: False, progress=lambda done: None) -> int:
    """Feed RGBA frames, an iterable in order, to ffmpeg's standard input; returns how many. The file appears under its
    own name only when ffmpeg has ended well; a failed or cancelled export leaves nothing behind."""
    import os
    import subprocess
    import tempfile

    part, done = f"{target}.part", 0
    with tempfile.TemporaryFile() as words:
        try:
            run = subprocess.Popen([ffmpeg, *arguments], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=words)
        except FileNotFoundError:
            raise InputError("io", f"no ffmpeg at {ffmpeg!r}") from None
        problem = None
        try:
            for frame in frames:
                if done % CHUNK == 0:
                    progress(done)
                    if cancelled():
                        problem = "cancelled"
                        break
                run.stdin.write(frame)
                done += 1
            run.stdin.close()
        except BrokenPipeError:
            problem = "ffmpeg closed its input"
        if problem == "cancelled":
            run.kill()
        code = run.wait()
        if problem or code:
            words.seek(max(0, words.seek(0, 2) - TAIL))
            tail = words.read().decode("utf-8", "replace").strip()
            if os.path.exists(part):
                os.remove(part)
            raise InputError("io", f"{problem or f'ffmpeg ended with {code}'}: {tail}")
    os.replace(part, target)
    return done
