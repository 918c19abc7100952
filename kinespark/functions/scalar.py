"""Element-wise functions as Catalyst columns, with IEEE rules for NaN, infinities and signed zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def finite(x: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def truth(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _present(out: Column, *args: Column) -> Column:
    """NULL where an operand is NULL (no sample there)."""
    missing = args[0].isNull()
    for a in args[1:]:
        missing = missing | a.isNull()
    return F.when(~missing, out)


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison to 1.0 or 0.0: with a NaN only != holds (Spark orders NaN last and equal to itself)."""
    odd = F.isnan(a) | F.isnan(b)
    plain = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return _present(truth(odd | plain if op == "!=" else ~odd & plain), a, b)


def nonzero(a: Column) -> Column:
    """Truthiness: any value but zero, NaN included."""
    return F.isnan(a) | (a != 0.0)


def logical(op: str, a: Column, b: Column) -> Column:
    return _present(truth(nonzero(a) & nonzero(b) if op == "and" else nonzero(a) | nonzero(b)), a, b)


def negate(a: Column) -> Column:
    return F.lit(-1.0) * a


def sign(a: Column) -> Column:
    return F.when(F.isnan(a), nan()).when(a > 0, 1.0).when(a < 0, -1.0).when(a.isNotNull(), 0.0)


def _whole(f, a: Column) -> Column:
    """floor and ceil stay doubles; NaN, infinities and numbers without fraction pass as they are."""
    keep = F.isnan(a) | (F.abs(a) >= float(1 << 52)) | (a == 0.0)
    return F.when(keep, a).otherwise(f(F.when(keep, F.lit(0.0)).otherwise(a)).cast("double"))


def floor(a: Column) -> Column:
    return _whole(F.floor, a)


def ceil(a: Column) -> Column:
    return _whole(F.ceil, a)


def round_half_away(a: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    keep = F.isnan(a) | (F.abs(a) >= float(1 << 52))
    near = F.floor(F.abs(F.when(keep, F.lit(0.0)).otherwise(a))).cast("double")
    up = F.when(F.abs(a) - near >= 0.5, near + 1.0).otherwise(near)
    return F.when(keep, a).otherwise(F.when(a < 0, -up).otherwise(up))


def power(a: Column, b: Column) -> Column:
    """C's pow: 1 to any power and -1 to an infinite one are 1, even for NaN exponents of 1."""
    return F.when(a == 1.0, 1.0).when((a == -1.0) & (F.abs(b) == float("inf")), 1.0).otherwise(F.pow(a, b))


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(_present(F.least(a, b), a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(_present(F.greatest(a, b), a, b))


def clamp(a: Column, lo: Column, hi: Column) -> Column:
    return F.when(F.isnan(a), a).when(a < lo, lo).when(a > hi, hi).otherwise(a)


#: One-argument functions by name.
UNARY = {
    "abs": F.abs,
    "sqrt": F.sqrt,
    "sign": sign,
    "floor": floor,
    "ceil": ceil,
    "round": round_half_away,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "deg2rad": lambda a: a * math.pi / 180.0,
    "rad2deg": lambda a: a * 180.0 / math.pi,
}

#: Two-argument functions by name.
BINARY = {"pow": power, "min": least, "max": greatest, "atan2": F.atan2}
