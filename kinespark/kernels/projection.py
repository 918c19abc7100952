"""Projection of a moving point onto a reference lap, following it from segment to segment."""

from __future__ import annotations

import numpy as np

#: Segments searched on either side of the last hit; squared length under which a segment is skipped.
RADIUS, SHORT = 10, 1e-12


class Projector:
    """Nearest point on the reference among segments whose heading is within a quarter turn of the sample's.

    The first call looks at every segment; later ones at RADIUS on each side of the last hit. A miss keeps it.
    """

    def __init__(self, e: np.ndarray, n: np.ndarray, t: np.ndarray):
        self.e, self.n, self.t = (np.asarray(v, float) for v in (e, n, t))
        self.de, self.dn = np.diff(self.e), np.diff(self.n)
        self.sq = self.de**2 + self.dn**2
        self.arc = np.concatenate([[0.0], np.cumsum(np.sqrt(self.sq))])
        self.heading = np.arctan2(self.dn, self.de)
        self.last: int | None = None

    def project(self, e: float, n: float, heading: float):
        """(arc position, reference time, distance, segment), or None."""
        count = len(self.sq)
        if count < 1:
            return None
        lo, hi = (0, count) if self.last is None else (max(0, self.last - RADIUS), min(count, self.last + RADIUS + 1))
        de, dn, sq = self.de[lo:hi], self.dn[lo:hi], self.sq[lo:hi]
        turn = np.remainder(heading - self.heading[lo:hi] + np.pi, 2 * np.pi) - np.pi
        ok = (sq >= SHORT) & (np.abs(turn) <= np.pi / 2)
        if not ok.any():
            return None
        with np.errstate(all="ignore"):
            tau = np.clip(((e - self.e[lo:hi]) * de + (n - self.n[lo:hi]) * dn) / sq, 0.0, 1.0)
        d2 = (e - self.e[lo:hi] - tau * de) ** 2 + (n - self.n[lo:hi] - tau * dn) ** 2
        k = int(np.argmin(np.where(ok, d2, np.inf)))
        at = self.last = lo + k
        u = tau[k]
        return self.arc[at] + u * (self.arc[at + 1] - self.arc[at]), self.t[at] + u * (self.t[at + 1] - self.t[at]), float(np.sqrt(d2[k])), at
