"""Repair of samples pinned at a sensor's rail: a two-sided pulse is fitted to the unclipped shoulders.

The grid search runs as whole-array arithmetic over all (peak time, amplitude) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Params:
    rail: float = 32.0
    eps: float = 0.05
    shoulder: int = 24
    shape: str = "sech2"  # or gaussian, lorentzian
    sharpness: float = 2.0


#: Samples at each outer end of the shoulders that the baseline goes through; search grid and refinement.
ANCHOR, TIME_STEPS, AMP_STEPS, REFINE = 4, 24, 48, 3


def runs(x: np.ndarray, rail: float = 32.0, eps: float = 0.05) -> list[tuple[int, int]]:
    """Inclusive index ranges of samples with abs(x) >= rail - eps."""
    pinned = np.concatenate([[False], np.abs(x) >= rail - eps, [False]])
    edges = np.flatnonzero(pinned[1:] != pinned[:-1])
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


def pulse(u: np.ndarray, p: Params) -> np.ndarray:
    if p.shape == "sech2":
        return 1 / np.cosh(u) ** 2
    return np.exp(-np.abs(u) ** p.sharpness) if p.shape == "gaussian" else 1 / (1 + u * u)


def inverse(y: np.ndarray, p: Params) -> np.ndarray:
    """Positive u with pulse(u) = y; NaN where there is none."""
    with np.errstate(all="ignore"):
        ok = (y > 0) & (y < 1)
        if p.shape == "sech2":
            u = np.arccosh(1 / np.sqrt(y))
        elif p.shape == "gaussian":
            u = (-np.log(y)) ** (1 / p.sharpness)
        else:
            u = np.sqrt(1 / y - 1)
        return np.where(ok & np.isfinite(u) & (u > 0), u, np.nan)


def _fit(near: np.ndarray, lo: int, n: int, a: int, b: int, p: Params):
    """(value(t)) of the fitted pulse on a baseline, or None with under two shoulder samples. ``near`` are the samples from
    lo on of n, clipped upwards."""
    x = _From(near, lo)
    left, right = np.arange(max(0, a - p.shoulder), a), np.arange(b + 1, min(n, b + 1 + p.shoulder))
    where = np.concatenate([left, right])
    if len(where) < 2:
        return None
    origin = max(0, a - p.shoulder)
    anchors = np.concatenate([left[:ANCHOR], right[max(0, len(right) - ANCHOR) :]])
    ax, ay = (anchors - origin).astype(float), x[anchors]
    normal = np.array([[(ax * ax).sum(), ax.sum()], [ax.sum(), len(ax)]])
    slope, level = np.linalg.solve(normal, [(ax * ay).sum(), ay.sum()]) if np.linalg.det(normal) != 0 else (0.0, ay.mean())
    base = lambda t: slope * (t - origin) + level
    rise = x[a - 1] - x[a - 2] if a >= 2 else 0.0
    fall = x[b + 1] - x[b + 2] if b + 2 < n else 0.0
    cross_l = float(np.clip(a - 1 + (p.rail - x[a - 1]) / rise, a - 1, a)) if rise > 1e-6 else a - 0.5
    cross_r = float(np.clip(b + 1 - (p.rail - x[b + 1]) / fall, b, b + 1)) if fall > 1e-6 else b + 0.5
    t, v = where.astype(float), x[where]

    def score(t0: np.ndarray, amp: np.ndarray):
        """(sum of squares, rise and fall widths) for arrays of candidates; infinite where a pulse is impossible."""
        u = inverse((p.rail - base(t0)) / amp, p)
        wr, wf = (t0 - cross_l) / u, (cross_r - t0) / u
        ok = (wr > 0) & (wf > 0)
        with np.errstate(all="ignore"):
            width = np.where(t < t0[:, None], wr[:, None], wf[:, None])
            model = base(t) + amp[:, None] * pulse((t - t0[:, None]) / width, p)
            return np.where(ok, ((model - v) ** 2).sum(axis=1), np.inf), wr, wf

    mid = (a + b) / 2
    low = max(p.rail - base(mid), 1e-3) * 1.01
    steep = max(rise, 0.0) + max(fall, 0.0)
    wide = b - a + 1.0
    cap = p.rail + wide * wide * steep / (8 * (wide + 1)) if steep > 1e-6 else base(mid) + low
    high = max(min(low * 6, max(cap - base(mid), low)), low)
    t0s = cross_l + (cross_r - cross_l) * np.arange(TIME_STEPS + 1) / TIME_STEPS
    amps = low + (high - low) * np.arange(AMP_STEPS + 1) / AMP_STEPS
    gt, ga = (g.ravel() for g in np.meshgrid(t0s, amps, indexing="ij"))
    sse, wr, wf = score(gt, ga)
    k = int(np.argmin(sse))
    best = (sse[k], gt[k], ga[k], wr[k], wf[k]) if np.isfinite(sse[k]) else (np.inf, mid, low, 1.0, 1.0)
    dt, da = (cross_r - cross_l) / TIME_STEPS / 4, (high - low) / AMP_STEPS / 4
    for i in range(-REFINE, REFINE + 1):  # each step is taken from the best so far
        t0 = best[1] + dt * i
        steps = np.arange(-REFINE, REFINE + 1)
        while len(steps):  # all at once up to the first that is better
            amp = best[2] + da * steps
            s, r, f = score(np.full(len(steps), t0), amp)
            better = np.flatnonzero(s < best[0])
            if not len(better):
                break
            k = better[0]
            best = (s[k], t0, amp[k], r[k], f[k])
            steps = steps[k + 1 :]
    _, t0, amp, wr, wf = best
    wr, wf = max(wr, 1e-3), max(wf, 1e-3)
    return lambda s: base(s) + amp * pulse((s - t0) / np.where(s < t0, wr, wf), p)


class _From:
    """Samples by their positions in the whole."""

    def __init__(self, x: np.ndarray, lo: int):
        self.x, self.lo = x, lo

    def __getitem__(self, at):
        return self.x[at - self.lo]


def windows(x: np.ndarray, params: Params = Params()):
    """(lo, a, b, samples from lo on): every pinned run with what its repair looks at."""
    for a, b in runs(x, params.rail, params.eps):
        lo = max(0, a - params.shoulder)
        yield lo, a, b, x[lo : b + 1 + params.shoulder]


def repair(near: np.ndarray, lo: int, n: int, a: int, b: int, params: Params = Params()) -> np.ndarray:
    """Values in place of the run a to b of n samples, of which ``near`` are those from lo on."""
    near = np.asarray(near, np.float64)
    side = -1.0 if near[a - lo] < 0 else 1.0
    value = _fit(side * near, lo, n, a, b, params)
    if value is None:
        return near[a - lo : b + 1 - lo]
    work = _From(side * near, lo)
    t = np.arange(a, b + 1, dtype=float)
    miss_l = work[a - 1] - value(np.array([a - 1.0]))[0] if a > 0 else 0.0
    miss_r = work[b + 1] - value(np.array([b + 1.0]))[0] if b + 1 < n else 0.0
    part = (t - a) / (b - a) if b > a else np.array([0.5])
    return side * (value(t) + miss_l * (1 - part) + miss_r * part)


def declip(x: np.ndarray, rate: float = 0.0, params: Params = Params()) -> np.ndarray:
    """x with every pinned run replaced by its fitted pulse, joined to the neighbours by a linear taper. A run's
    sign is that of its first sample; runs with under two shoulder samples stay as they are."""
    x = np.asarray(x, np.float64)
    out = x.copy()
    for lo, a, b, near in windows(x, params):
        out[a : b + 1] = repair(near, lo, len(x), a, b, params)
    return out
