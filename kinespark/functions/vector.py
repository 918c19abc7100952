"""Three-vectors as triples of columns, and their algebra."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def add(a: Vec, b: Vec) -> Vec:
    return Vec(*(p + q for p, q in zip(a, b, strict=True)))


def sub(a: Vec, b: Vec) -> Vec:
    return Vec(*(p - q for p, q in zip(a, b, strict=True)))


def scale(a: Vec, s: Column) -> Vec:
    return Vec(*(p * s for p in a))


def cross(a: Vec, b: Vec) -> Vec:
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def dot(a: Vec, b: Vec) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """Unit vector by the reciprocal of the norm; a zero vector gives NaN components."""
    n = norm(a)
    r = F.when(n == 0.0, F.lit(float("nan"))).otherwise(F.lit(1.0) / F.when(n != 0.0, n))
    return scale(a, r)


def angle(a: Vec, b: Vec) -> Column:
    return F.atan2(norm(cross(a, b)), dot(a, b))


def rotate_matrix(a: Vec, m: list) -> Vec:
    """Row-major 3 x 3."""
    return Vec(*(a.x * m[3 * i] + a.y * m[3 * i + 1] + a.z * m[3 * i + 2] for i in range(3)))


def axis_matrix(ax: float, ay: float, az: float, theta: float) -> list[float]:
    """Rotation by theta about an axis, which need not have unit length but must not be zero."""
    n = math.sqrt(ax * ax + ay * ay + az * az)
    if n == 0:
        raise ValueError("zero rotation axis")
    x, y, z = ax / n, ay / n, az / n
    c, s = math.cos(theta), math.sin(theta)
    t = 1 - c
    return [t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x, t * x * z - s * y, t * y * z + s * x, t * z * z + c]


def rotate_euler(a: Vec, roll: Column, pitch: Column, yaw: Column) -> Vec:
    """Rz(yaw) Ry(pitch) Rx(roll); the angles may differ from row to row."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    m = [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]
    return rotate_matrix(a, m)


def lever_arm(accel: Vec, alpha: Vec, omega: Vec, arm: Vec) -> Vec:
    """Acceleration at the end of a lever arm: a + alpha x L + omega x (omega x L)."""
    return add(add(accel, cross(alpha, arm)), cross(omega, cross(omega, arm)))
