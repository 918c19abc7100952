"""Suspension travel from inertial units: an error-state Kalman filter and a fixed-interval smoother.

The state has a rotation (errors 0..2) and 21 additive numbers. Measurements are rows of a Jacobian with a
residual (measured minus predicted) and a noise; every one goes through the same update.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import declip as _declip
from . import rotation as R

#: Gravity of the estimator, and durations that close and sustain airborne runs.
GRAVITY, MAX_GAP_S, MIN_AIR_S = 9.81, 0.10, 0.05
FROZEN = 1e-12
#: Components: symbol, first error index, size; and those that need rear suspension or steering.
COMPONENTS = (("R_chassis", 0, 3), ("v_chassis", 3, 3), ("b_g0", 6, 3), ("b_a0", 9, 3), ("b_g1", 12, 3), ("b_g2", 15, 3), ("w_f", 18, 1), ("dw_f", 19, 1), ("w_r", 20, 1), ("dw_r", 21, 1), ("psi", 22, 1), ("dpsi", 23, 1))
REAR, STEER = {"b_g2", "w_r", "dw_r"}, {"psi", "dpsi"}
N = 24
V, BG0, BA0, BG1, BG2, WF, DWF, WR, DWR = 3, 6, 9, 12, 15, 18, 19, 20, 21


@dataclass(frozen=True)
class Pose:
    mount: np.ndarray
    lever: np.ndarray


def _tilted() -> np.ndarray:
    off = np.radians(90.0 - 63.5)
    return np.array([-np.sin(off), 0.0, np.cos(off)])


@dataclass(frozen=True)
class Geometry:
    """A bike; the defaults are the reference bike's fixed values. ``imu2`` and ``rear_path`` None: a hardtail."""

    front_axis: np.ndarray = field(default_factory=_tilted)
    front_max: float = 0.170
    front_sag: float = 0.27
    rear_max: float = 0.160
    rear_sag: float = 0.27
    rear_path: tuple | None = ((0.000, (0.000, 0.0, 0.000)), (0.040, (-0.008, 0.0, 0.040)), (0.080, (-0.013, 0.0, 0.080)), (0.120, (-0.010, 0.0, 0.120)), (0.160, (-0.004, 0.0, 0.160)))
    imu0: Pose = field(default_factory=lambda: Pose(R.exp(np.array([0.0, 0.0, np.pi])), np.zeros(3)))
    imu1: Pose = field(default_factory=lambda: Pose(R.from_quaternion(-4.78101903822033492e-1, -5.01109229357781349e-1, 5.18398525639093610e-1, -5.01568617867397371e-1), np.array([0.835, 0.0, -0.4])))
    imu2: Pose | None = field(default_factory=lambda: Pose(R.from_quaternion(-7.08515127451586846e-1, -7.00155077592052089e-1, 6.73954169987484863e-2, -5.69827979472209215e-2), np.array([-0.445, 0.0, -0.4])))

    @property
    def full_suspension(self) -> bool:
        return self.imu2 is not None

    def rear_tangent(self, travel: float) -> np.ndarray:
        """Unit direction of the path piece that holds ``travel``."""
        s = np.array([p[0] for p in self.rear_path])
        i = int(np.clip(np.searchsorted(s[1:-1], travel, "left"), 0, len(s) - 2))
        step = np.subtract(self.rear_path[i + 1][1], self.rear_path[i][1])
        return step / np.linalg.norm(step)


@dataclass(frozen=True)
class Config:
    """Settings of the estimator; their defaults are fixed values of the reference bike and its sensors."""

    estimate_steering: bool = False
    gyro_arw: float = 0.003
    accel_vrw: float = 0.05
    gyro_bias_rw: float = 1e-4
    accel_bias_rw: float = 1e-3
    gyro1_bias_rw: float = 1e-4
    gyro2_bias_rw: float = 1e-4
    wheel_vel_rw: float = 5.0
    wheel_pos_rw: float = 1e-3
    steer_rate_rw: float = 1.0
    init_attitude: float = float(np.radians(5.0))
    init_velocity: float = 1.0
    init_gyro_bias: float = 0.05
    init_accel_bias: float = 0.5
    init_travel: float = 0.05
    init_wheel_velocity: float = 1.0
    init_steer: float = 0.2
    init_steer_rate: float = 1.0
    iterations: int = 1
    zupt_window: int = 20
    zupt_accel_std: float = 0.1
    zupt_gyro: float = 0.05
    zupt_sigma: float = 0.02
    zaru_sigma: float = 1e-3
    gravity_sigma: float = 0.05
    gps_sigma: float = 0.5
    sag_sigma: float = 0.5
    use_sag_prior: bool = False
    barrier_sigma: float = 0.005
    airborne_accel: float = 2.5
    airborne_diff: float = 5.0
    topout_sigma: float = 0.01
    gps_latency_s: float = 0.2
    gps_min_speed: float = 0.5
    refine_mounts: bool = False
    smooth: bool = True


@dataclass
class Unit:
    gyro: np.ndarray  # rad/s, n x 3
    accel: np.ndarray  # m/s2, n x 3


def unit(accel_g: list, gyro_dps: list, rate: float) -> Unit | None:
    """A unit from its six axes in g and degrees a second; a missing axis (None) counts as zeros, all are cut to the
    shortest, pinned accelerations are repaired. None without any axis."""
    there = [a for a in (*accel_g, *gyro_dps) if a is not None and len(a)]
    if not there:
        return None
    n = min(map(len, there))
    take = lambda a: np.asarray(a[:n], float) if a is not None and len(a) else np.zeros(n)
    accel = np.stack([_declip.declip(take(a), rate) for a in accel_g], axis=1) * GRAVITY
    return Unit(np.stack([take(a) for a in gyro_dps], axis=1) * (np.pi / 180.0), accel)


def gps_velocity(t: np.ndarray, speed_kmh: np.ndarray, heading_cdeg: np.ndarray, quality: np.ndarray | None = None):
    """(times, north-west-up velocities) of fixes; those with a quality under 1 are left out."""
    n = min(len(t), len(speed_kmh), len(heading_cdeg))
    course = np.radians(heading_cdeg[:n] / 100.0)
    v = (speed_kmh[:n] / 3.6)[:, None] * np.stack([np.cos(course), -np.sin(course), np.zeros(n)], axis=1)
    ok = np.ones(n, bool)
    if quality is not None:
        m = min(n, len(quality))
        ok[:m] = ~(quality[:m] < 1.0)
    return t[:n][ok], v[ok]


# ---- flags ----
def _rolling(x: np.ndarray, w: int):
    """Causal mean and population deviation over up to w samples."""
    w = max(1, w)
    mean, std = np.empty(len(x)), np.empty(len(x))
    for i in range(len(x)):
        part = x[max(0, i - w + 1) : i + 1]
        mean[i], std[i] = part.mean(), part.std()
    return mean, std


def stationary(accel: np.ndarray, gyro: np.ndarray, c: Config) -> np.ndarray:
    _, deviation = _rolling(np.linalg.norm(accel, axis=1), c.zupt_window)
    mean, _ = _rolling(np.linalg.norm(gyro, axis=1), c.zupt_window)
    return (deviation < c.zupt_accel_std) & (mean < c.zupt_gyro)


def _runs(flags: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def close_gaps(flags: np.ndarray, most: int) -> np.ndarray:
    out = flags.copy()
    runs = _runs(flags)
    for (_, end), (start, _) in zip(runs, runs[1:], strict=False):
        if start - end <= most:
            out[end:start] = True
    return out


def sustained(flags: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros_like(flags)
    for a, b in _runs(flags):
        if b - a >= least:
            out[a:b] = True
    return out


def central_difference(v: np.ndarray, dt: float) -> np.ndarray:
    return np.gradient(v, dt, axis=0, edge_order=1) if len(v) > 1 else np.zeros_like(v)


# ---- filter ----
@dataclass
class Belief:
    rot: np.ndarray
    x: np.ndarray  # 24 numbers, the first three unused
    p: np.ndarray

    def moved(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.x + d
        x[:3] = 0.0
        return self.rot @ R.exp(d[:3]), x


class Filter:
    def __init__(self, c: Config, active: dict[str, bool], dt: float):
        self.c, self.dt = c, dt
        q = np.zeros(N)
        w = lambda s: s * s * dt
        rates = {"R_chassis": c.gyro_arw, "v_chassis": c.accel_vrw, "b_g0": c.gyro_bias_rw, "b_a0": c.accel_bias_rw, "b_g1": c.gyro1_bias_rw, "b_g2": c.gyro2_bias_rw, "w_f": c.wheel_pos_rw, "dw_f": c.wheel_vel_rw, "w_r": c.wheel_pos_rw, "dw_r": c.wheel_vel_rw, "psi": c.wheel_pos_rw, "dpsi": c.steer_rate_rw}
        for name, i, n in COMPONENTS:
            q[i : i + n] = w(rates[name]) if active[name] else 0.0
        self.q = np.diag(q)

    def predict(self, b: Belief, gyro: np.ndarray, accel: np.ndarray, front: float, rear: float) -> None:
        dt = self.dt
        phi = (gyro - b.x[BG0 : BG0 + 3]) * dt
        force = accel - b.x[BA0 : BA0 + 3]
        f = np.eye(N)
        f[:3, :3] = R.exp(-phi)
        f[:3, BG0 : BG0 + 3] = -R.right_jacobian(phi) * dt
        f[V : V + 3, :3] = -(b.rot @ R.skew(force)) * dt
        f[V : V + 3, BA0 : BA0 + 3] = -b.rot * dt
        f[WF, DWF] = f[WR, DWR] = f[22, 23] = dt
        b.p = f @ b.p @ f.T + self.q
        x = b.x.copy()
        x[V : V + 3] += (b.rot @ force - [0.0, 0.0, GRAVITY]) * dt
        x[WF] += b.x[DWF] * dt
        x[DWF] += front * dt
        x[WR] += b.x[DWR] * dt
        x[DWR] += rear * dt
        x[22] += b.x[23] * dt
        b.x, b.rot = x, b.rot @ R.exp(phi)

    def update(self, b: Belief, measure, sigma: float) -> None:
        """``measure(rot, x)`` gives (residual, Jacobian). Singular or non-finite steps leave the belief as it is."""
        rot, x, last = b.rot, b.x, None
        for _ in range(max(1, self.c.iterations)):
            r, h = measure(rot, x)
            moved = np.concatenate([R.log(b.rot.T @ rot), (x - b.x)[3:]])
            noise = sigma * sigma * np.eye(len(r))
            try:
                k = b.p @ h.T @ np.linalg.inv(h @ b.p @ h.T + noise)
            except np.linalg.LinAlgError:
                return
            step = k @ (h @ moved - r)
            if not np.isfinite(step).all():
                return
            rot, x = b.moved(step)
            last = (k, h, noise)
            if np.linalg.norm(step - moved) < 1e-9:
                break
        k, h, noise = last
        keep = np.eye(N) - k @ h
        b.rot, b.x, b.p = rot, x, keep @ b.p @ keep.T + k @ noise @ k.T


def _direct(at: list[int], target):
    """Measurement of additive components."""
    h = np.zeros((len(at), N))
    h[range(len(at)), at] = -1.0
    target = np.asarray(target, float)
    return lambda rot, x: (target - x[at], h)


def _barrier(at: int, most: float):
    def measure(rot, x):
        h = np.zeros((2, N))
        h[0, at], h[1, at] = (-1.0 if x[at] < 0 else 0.0), (1.0 if x[at] > most else 0.0)
        return np.array([max(-x[at], 0.0), max(x[at] - most, 0.0)]), h

    return measure


def _gravity(accel: np.ndarray):
    """Two tilt angles from the direction of the measured force."""

    def measure(rot, x):
        m = accel - x[BA0 : BA0 + 3]
        n = np.linalg.norm(m)
        h = np.zeros((2, N))
        if not n > 1e-9:
            return np.zeros(2), h
        u = m / n
        h[:, :3] = -(rot @ R.skew(u))[:2]
        h[:, BA0 : BA0 + 3] = -(rot @ (np.eye(3) - np.outer(u, u)) / n)[:2]
        return (rot @ u)[:2], h

    return measure


@dataclass
class Estimate:
    front_travel: np.ndarray
    front_velocity: np.ndarray
    rear_travel: np.ndarray
    rear_velocity: np.ndarray
    stationary: np.ndarray
    airborne: np.ndarray
    front_drive: np.ndarray
    rear_drive: np.ndarray
    accel_norm: np.ndarray
    front_diff: np.ndarray
    rear_diff: np.ndarray
    ledger: list[tuple[str, float, str]]
    belief: Belief

    def dynamic_sag(self, travel: np.ndarray) -> float | None:
        riding = travel[~self.stationary]
        return float(np.median(riding)) if len(riding) else None


def run(dt: float, imu0: Unit, imu1: Unit | None = None, imu2: Unit | None = None, gps: tuple | None = None, geometry: Geometry = Geometry(), c: Config = Config()) -> Estimate:
    """Estimate one recording. ``gps`` is (times, velocities)."""
    n = len(imu0.gyro)
    active = {name: not ((name in REAR and not geometry.full_suspension) or (name in STEER and not c.estimate_steering)) for name, _, _ in COMPONENTS}
    accel, gyro = imu0.accel @ geometry.imu0.mount.T, imu0.gyro @ geometry.imu0.mount.T
    still = stationary(imu0.accel, imu0.gyro, c) if n else np.zeros(0, bool)
    first = _runs(still)
    lo, hi = (first[0] if len(first) else (0, min(n, 50)))
    window_mean = lambda v: v[lo:hi].mean(axis=0) if v is not None and len(v[lo:hi]) else np.zeros(3)
    level = window_mean(accel)
    up = level if np.linalg.norm(level) > 1e-6 else np.array([0.0, 0.0, 1.0])
    bias0 = window_mean(gyro)

    def mounted(u: Unit | None, pose: Pose | None):
        if u is None or pose is None:
            return None, None
        mount = pose.mount
        if c.refine_mounts and len(u.accel[lo:hi]):
            mount = R.between(mount @ u.accel[lo:hi].mean(axis=0), up) @ mount
        return u.accel[:n] @ mount.T, u.gyro[:n] @ mount.T

    accel1, gyro1 = mounted(imu1, geometry.imu1)
    accel2, gyro2 = mounted(imu2, geometry.imu2)

    x0 = np.zeros(N)
    x0[BG0 : BG0 + 3] = bias0
    x0[BG1 : BG1 + 3] = window_mean(imu1.gyro if imu1 else None)
    x0[BG2 : BG2 + 3] = window_mean(imu2.gyro if imu2 else None)
    start = {"R_chassis": c.init_attitude, "v_chassis": c.init_velocity, "b_g0": c.init_gyro_bias, "b_g1": c.init_gyro_bias, "b_g2": c.init_gyro_bias, "b_a0": c.init_accel_bias, "w_f": c.init_travel, "w_r": c.init_travel, "dw_f": c.init_wheel_velocity, "dw_r": c.init_wheel_velocity, "psi": c.init_steer, "dpsi": c.init_steer_rate}
    p0 = np.zeros(N)
    for name, i, k in COMPONENTS:
        p0[i : i + k] = start[name] ** 2 if active[name] else FROZEN
    b = Belief(R.between(level, np.array([0.0, 0.0, 1.0])), x0, np.diag(p0))

    # per-sample quantities that don't depend on the state
    alpha, omega = central_difference(gyro, dt), gyro - bias0
    apart = lambda a, pose: a - accel - R.lever_arm(np.zeros_like(accel), alpha, omega, pose.lever)
    front = apart(accel1, geometry.imu1) if accel1 is not None else np.zeros((n, 3))
    rear = apart(accel2, geometry.imu2) if accel2 is not None else np.zeros((n, 3))
    norm, front_diff, rear_diff = (np.linalg.norm(v, axis=1) for v in (accel, front, rear))
    quiet = (norm < c.airborne_accel) & ((accel1 is None) | (front_diff < c.airborne_diff)) & ((accel2 is None) | (rear_diff < c.airborne_diff))
    air = sustained(close_gaps(quiet, max(1, int(np.floor(MAX_GAP_S / dt + 0.5)))), max(1, int(np.floor(MIN_AIR_S / dt + 0.5))))
    fix: dict[int, np.ndarray] = {}
    if gps is not None:
        for t, v in zip(*gps, strict=True):
            at = t - c.gps_latency_s
            if np.hypot(v[0], v[1]) >= c.gps_min_speed and at >= 0:
                fix[int(np.floor(at / dt + 0.5))] = v

    f = Filter(c, active, dt)
    has_rear = geometry.rear_path is not None
    front_drive = front @ geometry.front_axis if accel1 is not None else np.zeros(n)
    rear_drive = np.zeros(n)
    track = np.zeros((n, 4))
    for i in range(n):
        if accel2 is not None and has_rear:
            rear_drive[i] = rear[i] @ geometry.rear_tangent(float(np.clip(b.x[WR], 0.0, geometry.rear_max)))
        f.predict(b, gyro[i], accel[i], front_drive[i], rear_drive[i])
        if still[i]:
            f.update(b, _direct([V, V + 1, V + 2], np.zeros(3)), c.zupt_sigma)
            for at, rate in ((BG0, gyro), (BG1, gyro1), (BG2, gyro2)):
                if rate is not None:
                    f.update(b, _direct([at, at + 1, at + 2], rate[i]), c.zaru_sigma)
            for at, there in ((DWF, accel1 is not None), (DWR, has_rear)):
                if there:
                    f.update(b, _direct([at], [0.0]), c.zupt_sigma)
        if not air[i]:
            f.update(b, _gravity(accel[i]), c.gravity_sigma)
        for at, speed, most, sag, there in ((WF, DWF, geometry.front_max, geometry.front_sag, True), (WR, DWR, geometry.rear_max, geometry.rear_sag, has_rear)):
            if not there:
                continue
            if air[i]:
                f.update(b, _direct([at], [0.0]), c.topout_sigma)
                f.update(b, _direct([speed], [0.0]), c.zupt_sigma)
            elif not still[i] and c.use_sag_prior:
                f.update(b, _direct([at], [sag * most]), c.sag_sigma)
            f.update(b, _barrier(at, most), c.barrier_sigma)
        if i in fix:
            f.update(b, _direct([V, V + 1], fix[i][:2]), c.gps_sigma)
        track[i] = b.x[WF : WR + 2]

    ledger = []
    for name, i, k in COMPONENTS:
        sd, sd0 = (float(np.sqrt(np.diag(p)[i : i + k].mean())) for p in (b.p, np.diag(p0)))
        ledger.append((name, sd, "frozen" if not active[name] else "pinned" if sd < 0.5 * sd0 else "relative_only"))
    if c.smooth and n:
        track[:, 0], track[:, 1] = smooth_wheel(front_drive, still if accel1 is not None else np.zeros(n, bool), air, dt, geometry.front_max, geometry.front_sag * geometry.front_max, c)
        if has_rear:
            track[:, 2], track[:, 3] = smooth_wheel(rear_drive, still, air, dt, geometry.rear_max, geometry.rear_sag * geometry.rear_max, c)
    return Estimate(*track.T, still, air, front_drive, rear_drive, norm, front_diff, rear_diff, ledger, b)


def smooth_wheel(drive: np.ndarray, still: np.ndarray, air: np.ndarray, dt: float, most: float, sag: float, c: Config, variances: bool = False):
    """Travel and velocity of one wheel: a two-state filter forwards, then a Rauch-Tung-Striebel pass backwards."""
    n = len(drive)
    f = np.array([[1.0, dt], [0.0, 1.0]])
    q = np.diag([c.wheel_pos_rw**2 * dt, c.wheel_vel_rw**2 * dt])
    x, p = np.zeros(2), np.diag([c.init_travel**2, c.init_wheel_velocity**2])
    means, covs = np.empty((n, 2)), np.empty((n, 2, 2))

    def one(x, p, k, target, sigma):
        h = np.zeros(2)
        h[k] = 1.0
        s = p[k, k] + sigma * sigma
        gain = p[:, k] / s
        keep = np.eye(2) - np.outer(gain, h)
        moved, cov = x + gain * (target - x[k]), keep @ p @ keep.T + np.outer(gain, gain) * sigma * sigma
        return (moved, cov) if s > 0 and np.isfinite(moved).all() and np.isfinite(cov).all() else (x, p)

    for i in range(n):
        x = f @ x + [0.0, drive[i] * dt]
        p = f @ p @ f.T + q
        if still[i]:
            x, p = one(x, p, 1, 0.0, c.zupt_sigma)
        if air[i]:
            x, p = one(x, p, 0, 0.0, c.topout_sigma)
            x, p = one(x, p, 1, 0.0, c.zupt_sigma)
        elif not still[i] and c.use_sag_prior:
            x, p = one(x, p, 0, sag, c.sag_sigma)
        if x[0] < 0 or x[0] > most:  # outside, the barrier pulls to the nearer end
            x, p = one(x, p, 0, 0.0 if x[0] < 0 else most, c.barrier_sigma)
        means[i], covs[i] = x, p
    out, cov = means.copy(), covs.copy()
    for k in range(n - 2, -1, -1):
        ahead = f @ means[k] + [0.0, drive[k + 1] * dt]
        spread = f @ covs[k] @ f.T + q
        if np.linalg.det(spread) <= 1e-300:
            continue
        gain = covs[k] @ f.T @ np.linalg.inv(spread)
        out[k] = means[k] + gain @ (out[k + 1] - ahead)
        cov[k] = covs[k] + gain @ (cov[k + 1] - spread) @ gain.T
    return (out[:, 0], out[:, 1], covs[:, 0, 0], cov[:, 0, 0]) if variances else (out[:, 0], out[:, 1])
