"""Suspension estimates: one recurrence per session, sessions in parallel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError
from ..kernels import estimate as E
from ..model import SessionSet, column_name, grid
from .blocked import windowed

_AXES = [[f"IMU{i}_{kind}{axis}" for kind in ("Accel", "Gyro") for axis in "XYZ"] for i in range(3)]
GPS = ("GPS_SpeedKmh", "GPS_Heading", "GPS_FixQuality")
OUTPUTS = ("Front travel (mm)", "Front velocity (mm/s)", "Rear travel (mm)", "Rear velocity (mm/s)")


def _session(table: pa.Table, rate: float, gps_rate: float, geometry: E.Geometry, config: E.Config) -> E.Estimate | None:
    table = table.sort_by("idx")
    names, values, times = np.array(table["channel_id"].to_pylist()), table["value"].to_numpy(), table["t"].to_numpy()
    pick = lambda name: values[names == name]
    units = [E.unit([pick(a) for a in axes[:3]], [pick(a) for a in axes[3:]], rate) for axes in _AXES]
    if units[0] is None:
        return None
    n = len(units[0].gyro)
    units = [u if u is None or len(u.gyro) >= n else E.Unit(*(np.pad(v, ((0, n - len(v)), (0, 0)), "edge") for v in (u.gyro, u.accel))) for u in units]
    speed, heading, quality = (pick(g) for g in GPS)
    gps = E.gps_velocity(times[names == GPS[0]], speed, heading, quality if len(quality) else None) if len(speed) and len(heading) else None
    return E.run(1.0 / rate, *units, gps, geometry, config)


def _input(data: SessionSet) -> tuple[DataFrame, float]:
    info = data.load_info()
    known = [c for axes in _AXES for c in axes if c in info]
    if not any(c in info for c in _AXES[0]):
        raise EvalError("runtime", "the session has no IMU0 channels to estimate from")
    rate = info[known[0]].rate
    if not rate > 0:
        raise EvalError("runtime", "the IMU0 channels have no sample rate")
    return data.samples.where(F.col("channel_id").isin([*known, *GPS])).select("session_id", "channel_id", "idx", "t", "value"), rate


def suspension(data: SessionSet, geometry: E.Geometry | None = None, config: E.Config | None = None) -> DataFrame:
    """Samples (session_id, channel_id, idx, t, value) of travel and velocity, in mm and mm/s."""
    samples, rate = _input(data)
    geometry, config = geometry or E.Geometry(), config or E.Config()

    def run(table: pa.Table) -> pa.Table:
        e = _session(table, rate, 0.0, geometry, config)
        columns = [] if e is None else [e.front_travel, e.front_velocity] + ([e.rear_travel, e.rear_velocity] if geometry.full_suspension else [])
        n = len(columns[0]) if columns else 0
        idx = np.tile(np.arange(n), len(columns))
        return pa.table({"session_id": pa.array([table["session_id"][0].as_py()] * len(idx), pa.string()), "channel_id": pa.array(np.repeat(OUTPUTS[: len(columns)], n).tolist(), pa.string()), "idx": pa.array(idx, pa.int64()), "t": pa.array(idx / rate, pa.float64()), "value": pa.array(np.concatenate(columns) * 1000.0 if columns else np.empty(0), pa.float64())})

    return samples.groupBy("session_id").applyInArrow(run, "session_id string, channel_id string, idx long, t double, value double")


def suspension_trace(data: SessionSet, geometry: E.Geometry | None = None, config: E.Config | None = None) -> DataFrame:
    """Per sample: the drives, norms and flags behind the estimate."""
    samples, rate = _input(data)
    geometry, config = geometry or E.Geometry(), config or E.Config()

    def run(table: pa.Table) -> pa.Table:
        e = _session(table, rate, 0.0, geometry, config)
        n = len(e.front_travel)
        return pa.table({"session_id": pa.array([table["session_id"][0].as_py()] * n, pa.string()), "idx": pa.array(np.arange(n)), "t": pa.array(np.arange(n) / rate), "front_drive": e.front_drive, "rear_drive": e.rear_drive, "accel_norm": e.accel_norm, "front_diff": e.front_diff, "rear_diff": e.rear_diff, "stationary": pa.array(e.stationary), "airborne": pa.array(e.airborne)})

    return samples.groupBy("session_id").applyInArrow(run, "session_id string, idx long, t double, front_drive double, rear_drive double, accel_norm double, front_diff double, rear_diff double, stationary boolean, airborne boolean")


def suspension_ledger(data: SessionSet, geometry: E.Geometry | None = None, config: E.Config | None = None) -> DataFrame:
    """(session_id, component, confidence_sd, source) and the dynamic sags in mm."""
    samples, rate = _input(data)
    geometry, config = geometry or E.Geometry(), config or E.Config()

    def run(table: pa.Table) -> pa.Table:
        e = _session(table, rate, 0.0, geometry, config)
        sag = [None if s is None else s * 1000.0 for s in (e.dynamic_sag(e.front_travel), e.dynamic_sag(e.rear_travel))]
        k = len(e.ledger)
        return pa.table({"session_id": pa.array([table["session_id"][0].as_py()] * k, pa.string()), "component": [x[0] for x in e.ledger], "confidence_sd": [x[1] for x in e.ledger], "source": [x[2] for x in e.ledger], "front_sag_mm": pa.array([sag[0]] * k, pa.float64()), "rear_sag_mm": pa.array([sag[1]] * k, pa.float64())})

    return samples.groupBy("session_id").applyInArrow(run, "session_id string, component string, confidence_sd double, source string, front_sag_mm double, rear_sag_mm double")


def axle_forces(data: SessionSet, front_arm: float = 0.835, rear_arm: float = -0.445) -> DataFrame:
    """(session_id, idx, front, rear): vertical force at the axles, in m/s2, from the frame's vertical force and its
    pitch acceleration over the axles' arms."""
    info = data.load_info()
    rate = info["IMU0_AccelZ"].rate
    g = grid(data.samples, ["IMU0_AccelZ", "IMU0_GyroY"])
    w = g.withColumn("__w", F.col(column_name("IMU0_GyroY")) * (np.pi / 180.0))

    def make(win):
        before, after, v = F.lag("__w").over(win), F.lead("__w").over(win), F.col("__w")
        return {"__a": F.coalesce((after - before) * rate / 2, (after - v) * rate, (v - before) * rate, F.lit(0.0))}

    d = windowed(w, ["session_id"], "idx", 1, 1, make)
    z = F.col(column_name("IMU0_AccelZ")) * E.GRAVITY
    return d.select("session_id", "idx", (z + front_arm * F.col("__a")).alias("front"), (z + rear_arm * F.col("__a")).alias("rear"))
