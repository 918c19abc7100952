"""Lap against lap: a channel minus the same channel of a reference lap, at equal place or equal distance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError
from ..kernels.projection import Projector
from ..model import SessionSet

_METRES = 111_320.0


@dataclass
class Reference:
    """The reference lap in its own east-north frame, with the channel of its session."""

    e: np.ndarray
    n: np.ndarray
    t_lap: np.ndarray
    start_s: float
    lat0: float
    lon0: float
    lon_scale: float
    channel: np.ndarray
    rate: float


@dataclass
class Overlay:
    """The reference lap of another session: (start, end) in epoch ms, its start in session seconds."""

    data: SessionSet
    session_id: str
    lap_ms: tuple[float, float]
    start_s: float


def degrees(x: np.ndarray) -> np.ndarray:
    """Values beyond 1000 are degrees x 1e7."""
    return np.where(np.abs(x) > 1000.0, x / 1e7, x)


def _fetch(data: SessionSet, session: str, channel: str) -> tuple[np.ndarray, float]:
    frame = data.frame(channel)
    if frame is None:
        return np.empty(0), 0.0
    t = frame.where(F.col("session_id") == session).select("idx", "value").toArrow()
    t = t.sort_by("idx")
    info = data.info.get(channel)
    return t["value"].to_numpy(), info.rate if info else getattr(data, "derived_info", {}).get(channel, (0.0,))[0]


def reference(overlay: Overlay, channel: str) -> Reference | None:
    """None without GPS or with under two fixes in the lap. One session's channels, the size that kernels take whole."""
    lat, _ = _fetch(overlay.data, overlay.session_id, "GPS_Latitude")
    lon, _ = _fetch(overlay.data, overlay.session_id, "GPS_Longitude")
    epoch, rate = _fetch(overlay.data, overlay.session_id, "GPS_EpochMs")
    n = min(len(lat), len(lon), len(epoch))
    inside = np.flatnonzero((epoch[:n] >= overlay.lap_ms[0]) & (epoch[:n] <= overlay.lap_ms[1]))
    if len(inside) < 2:
        return None
    la, lo = degrees(lat[inside]), degrees(lon[inside])
    scale = _METRES * math.cos(la.mean() * math.pi / 180.0)
    values, own = _fetch(overlay.data, overlay.session_id, channel)
    return Reference((lo - lo[0]) * scale, (la - la[0]) * _METRES, inside / rate - overlay.start_s, overlay.start_s, float(la[0]), float(lo[0]), scale, values, own)


def positions(lat: np.ndarray, lon: np.ndarray, heading: np.ndarray, r: Reference):
    """East, north and mathematical heading of fixes in the frame of the reference lap; the heading is GPS_Heading
    (compass degrees) where it covers all fixes, else towards the next fix (the last: towards the one before it)."""
    n = min(len(lat), len(lon))
    e, no = (degrees(lon[:n]) - r.lon0) * r.lon_scale, (degrees(lat[:n]) - r.lat0) * _METRES
    if len(heading) >= n:
        return e, no, (90.0 - heading[:n]) * math.pi / 180.0
    j = np.append(np.arange(1, n), n - 2)
    return e, no, np.arctan2(no[j] - no, e[j] - e)


def arc(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(e), np.diff(n)))]) if len(e) else np.empty(0)


def by_time(values: np.ndarray, rate: float, window: tuple[float, float], e, n, heading, r: Reference) -> np.ndarray:
    """values minus the reference channel at the time the reference lap was at the same place. NaN outside the
    window (where it has a length), without a match, and past the reference channel."""
    out = np.full(len(values), np.nan)
    if not len(e):
        return out
    follow = Projector(r.e, r.n, r.t_lap)
    step = max(1, len(values) // len(e))
    for i, v in enumerate(values):
        t = i / rate
        if window[0] < window[1] and not window[0] <= t < window[1]:
            continue
        j = min(i // step, len(e) - 1)
        hit = follow.project(e[j], n[j], heading[j])
        if hit is None:
            continue
        f = (r.start_s + hit[1]) * r.rate
        k = math.floor(f)
        part = f - k
        if 0 <= k < len(r.channel) and (part == 0 or k + 1 < len(r.channel)):
            out[i] = v - (r.channel[k] if part == 0 else r.channel[k] * (1 - part) + r.channel[k + 1] * part)
    return out


def by_distance(values: np.ndarray, rate: float, window: tuple[float, float], e, n, r: Reference) -> np.ndarray:
    """values minus the reference channel at the same arc length, interpolated; NaN outside the window or the
    reference's arc. Channels of other rates are picked by floor(position / length ratio)."""
    out = np.full(len(values), np.nan)
    own, ref = arc(e, n), arc(r.e, r.n)
    if not len(own) or not len(ref) or not len(r.channel):
        return out
    pick = lambda x, m: x[np.minimum((np.arange(m) / (m / len(x))).astype(int), len(x) - 1)]
    at = pick(own, len(values))
    ratio = len(r.channel) / len(ref)
    there = r.channel[np.minimum((np.arange(len(ref)) * ratio).astype(int), len(r.channel) - 1)]
    t = np.arange(len(values)) / rate
    ok = (at >= ref[0]) & (at <= ref[-1])
    if window[0] < window[1]:
        ok &= (t >= window[0]) & (t < window[1])
    out[ok] = values[ok] - np.interp(at[ok], ref, there)
    return out


def variance(data: SessionSet, channel: str, rate: float, overlay: Overlay, window: tuple[float, float], mode: str) -> DataFrame:
    """(session_id, idx, value): every session of ``data`` against one reference lap, sessions in parallel. The
    reference is one lap of fixes and one channel, and travels with the task."""
    r = reference(overlay, channel)
    if r is None:
        raise EvalError("runtime", f"{mode}: the overlay session's lap has no GPS fixes")
    if not len(r.channel):
        raise EvalError("runtime", f"{mode}: no channel [{channel}] in the overlay session")
    wanted = [channel, "GPS_Latitude", "GPS_Longitude", "GPS_Heading"]
    base = data.samples.where(F.col("channel_id").isin(wanted))
    if channel not in data.load_info():
        base = base.unionByName(data.derived[channel].select("session_id", F.lit(channel).alias("channel_id"), "idx", (F.col("idx") / rate).alias("t"), "value"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        kind = np.array(table["channel_id"].to_pylist())
        value = table["value"].to_numpy()
        lat, lon, heading = (value[kind == k] for k in ("GPS_Latitude", "GPS_Longitude", "GPS_Heading"))
        own = value[kind == channel]
        n = min(len(lat), len(lon))
        if n < 2:
            out = np.full(len(own), np.nan)
        else:
            e, no, h = positions(lat, lon, heading, r)
            out = by_time(own, rate, window, e, no, h, r) if mode == "variance_time" else by_distance(own, rate, window, e, no, r)
        return pa.table({"session_id": pa.array([table["session_id"][0].as_py()] * len(out), pa.string()), "idx": pa.array(np.arange(len(out))), "value": pa.array(out)})

    return base.select("session_id", "channel_id", "idx", "value").groupBy("session_id").applyInArrow(run, "session_id string, idx long, value double")


def attach(compiler, mode: str, ch):
    """variance_time and variance_dist inside an expression."""
    from ..plans.compile import Chan

    laps = compiler.laps
    window = laps.bounds[laps.main_lap - 1] if 0 < laps.main_lap <= len(laps.bounds) else (0.0, 0.0)
    for need in ("GPS_Latitude", "GPS_Longitude"):
        if need not in compiler.data.load_info():
            raise EvalError("runtime", f"{mode}: the main session has no {need}")
    made = variance(compiler.data, ch.name, ch.rate, laps.overlay, window, mode)
    compiler.n += 1
    name = f"x{compiler.n}"
    compiler.frame = compiler.frame.join(made.withColumnRenamed("value", name), ["session_id", "idx"], "left")
    return Chan(F.col(name), ch.rate, ch.length)


def variance_traces(data: SessionSet, channel: str, rate: float, overlay: Overlay, windows: dict[str, tuple[float, float]], mode: str) -> DataFrame:
    """(session_id, idx, value) of several targets against one reference: ``windows`` holds each session's lap."""
    out = None
    for session, window in windows.items():
        one = SessionSet(data.samples.where(F.col("session_id") == session), data.channels.where(F.col("session_id") == session), info=data.load_info(), derived=data.derived)
        made = variance(one, channel, rate, overlay, window, mode)
        out = made if out is None else out.unionByName(made)
    return out
