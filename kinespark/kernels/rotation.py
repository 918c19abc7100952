"""Rotations in three dimensions as 3 x 3 matrices and rotation vectors."""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    """Matrix of the cross product with v."""
    x, y, z = v
    return np.array([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])


def vee(m: np.ndarray) -> np.ndarray:
    return np.array([m[2, 1], m[0, 2], m[1, 0]])


def exp(phi: np.ndarray) -> np.ndarray:
    """Rotation of a rotation vector (Rodrigues)."""
    angle = float(np.linalg.norm(phi))
    k = skew(phi)
    if angle < 1e-8:
        return np.eye(3) + k + 0.5 * k @ k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def log(r: np.ndarray) -> np.ndarray:
    """Rotation vector of length up to pi."""
    c = np.clip((np.trace(r) - 1) / 2, -1.0, 1.0)
    w = vee(r - r.T) / 2
    s = float(np.linalg.norm(w))
    angle = float(np.arctan2(s, c))
    if s > 1e-9:
        return w * (angle / s)
    if c > 0:
        return w
    axis = np.sqrt(np.maximum((np.diag(r) + 1) / 2, 0.0))  # half a turn: the axis from the symmetric part
    k = int(np.argmax(axis))
    axis = r[:, k] + np.eye(3)[:, k]
    return axis / np.linalg.norm(axis) * angle


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least rotation that takes direction a to b; half a turn about a perpendicular where they oppose."""
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if na == 0 or nb == 0:
        return np.eye(3)
    u, v = a / na, b / nb
    axis, c = np.cross(u, v), float(u @ v)
    s = float(np.linalg.norm(axis))
    if s < 1e-12:
        if c > 0:
            return np.eye(3)
        side = np.cross(u, [1.0, 0.0, 0.0])
        if np.linalg.norm(side) <= 1e-6:
            side = np.cross(u, [0.0, 1.0, 0.0])
        return exp(side / np.linalg.norm(side) * np.pi)
    return exp(axis / s * np.arctan2(s, c))


def adjoint(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """6 x 6 adjoint of the rigid motion (r, t), rotation first."""
    out = np.zeros((6, 6))
    out[:3, :3] = out[3:, 3:] = r
    out[3:, :3] = skew(t) @ r
    return out


def right_jacobian(phi: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(phi))
    k = skew(phi)
    if angle < 1e-8:
        return np.eye(3) - 0.5 * k
    return np.eye(3) - (1 - np.cos(angle)) / angle**2 * k + (angle - np.sin(angle)) / angle**3 * k @ k


def from_quaternion(w: float, x: float, y: float, z: float) -> np.ndarray:
    q = np.array([w, x, y, z], float)
    w, *v = q / np.linalg.norm(q)
    v = np.array(v)
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * skew(v)


def swing_twist(r: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(swing, twist) with r = swing @ twist and the twist about ``axis``."""
    u = axis / np.linalg.norm(axis)
    half = np.linalg.norm(log(r)) / 2
    direction = log(r)
    n = np.linalg.norm(direction)
    along = float(direction @ u) / n * np.sin(half) if n > 0 else 0.0
    twist = exp(u * 2 * np.arctan2(along, np.cos(half)))
    return r @ twist.T, twist


def lever_arm(accel: np.ndarray, alpha: np.ndarray, omega: np.ndarray, arm: np.ndarray) -> np.ndarray:
    """Acceleration at the end of an arm; rows of arrays are samples."""
    return accel + np.cross(alpha, arm) + np.cross(omega, np.cross(omega, arm))


def from_gravity(mean_accel: np.ndarray) -> np.ndarray:
    """Row-major matrix that takes the measured gravity to +Z."""
    return between(mean_accel, np.array([0.0, 0.0, 1.0])).ravel()


def bias(samples: np.ndarray) -> np.ndarray:
    """Mean of static samples by axis; without samples an error."""
    if not len(samples):
        raise ValueError("no static samples")
    return np.asarray(samples, float).mean(axis=0)
