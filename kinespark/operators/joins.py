"""Positional, nearest, as-of, interpolating and interval joins over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nan
from .blocked import fill_forward


def positional(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of equal position; the shorter side ends the result."""
    return left.join(right, keys or ["session_id", "idx"])


def nearest_fixed(points: DataFrame, samples: DataFrame, rate: float, t: str = "t", out: str = "value") -> DataFrame:
    """The sample at round(t * rate) of the channel; NaN outside. One equi-join."""
    at = points.withColumn("__i", F.floor(F.col(t) * rate + 0.5).cast("long"))
    right = samples.select("session_id", F.col("idx").alias("__i"), F.col("value").alias(out))
    return at.join(right, ["session_id", "__i"], "left").withColumn(out, F.coalesce(out, nan())).drop("__i")


def interpolate_fixed(points: DataFrame, samples: DataFrame, rate: float, t: str = "t", out: str = "value") -> DataFrame:
    """Linear interpolation at t of a fixed-rate channel; NULL before the first and after the last sample."""
    x = F.col(t) * rate
    at = points.withColumn("__x", x).withColumn("__i", F.floor(x).cast("long"))
    a = samples.select("session_id", F.col("idx").alias("__i"), F.col("value").alias("__a"))
    b = samples.select("session_id", (F.col("idx") - 1).alias("__i"), F.col("value").alias("__b"))
    part = F.col("__x") - F.col("__i")
    value = F.when(part == 0, F.col("__a")).otherwise(F.col("__a") * (1 - part) + F.col("__b") * part)
    return at.join(a, ["session_id", "__i"], "left").join(b, ["session_id", "__i"], "left").withColumn(out, F.when(F.col("__x") >= 0, value)).drop("__x", "__i", "__a", "__b")


def as_of(points: DataFrame, samples: DataFrame, t: str = "t", out: str = "value", keys: tuple[str, ...] = ("session_id",), seconds_per_block: float = 3600.0, time: bool = False) -> DataFrame:
    """The last sample at or before t, of equal times the one of greatest ``idx`` (where the samples have it); NULL before
    the first. Points and samples are merged and carried forward within blocks of time, so a long session is many tasks."""
    tie = F.col("idx") if "idx" in samples.columns else F.lit(0)
    p = points.withColumn("__side", F.lit(1)).withColumn("__tie", F.lit(0).cast("long")).withColumn("__v", F.lit(None).cast("struct<v:double,t:double>"))
    s = samples.select(*keys, F.col("t").alias(t), F.lit(0).alias("__side"), tie.cast("long").alias("__tie"), F.struct(F.col("value").cast("double").alias("v"), F.col("t").cast("double").alias("t")).alias("__v"))
    both = p.unionByName(s, allowMissingColumns=True)
    filled = fill_forward(both, list(keys), [t, "__side", "__tie"], F.floor(F.col(t) / seconds_per_block).cast("long"), ["__v"])
    found = filled.where("__side = 1").withColumn(out, F.col("__v.v"))
    return (found.withColumn(f"{out}_t", F.col("__v.t")) if time else found).drop("__side", "__tie", "__v")


def _mirrored(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with those of ``columns`` that it has negated: the first sample at or after t is the last one at or before it
    on the mirrored axis, and of equal times the one of smallest idx."""
    return df.withColumns({c: -F.col(c) for c in columns if c in df.columns})


def nearest_event(points: DataFrame, samples: DataFrame, t: str = "t", out: str = "value", keys: tuple[str, ...] = ("session_id",), seconds_per_block: float = 3600.0) -> DataFrame:
    """The sample nearest in time of an event-driven channel; the earlier on a tie; the end ones beyond the ends.
    Of samples of one time, the last (by idx) stands for it from t on, the first before."""
    back = as_of(points, samples, t, "__back", keys, seconds_per_block, time=True)
    both = _mirrored(as_of(_mirrored(back, t), _mirrored(samples, "t", "idx"), t, "__fore", keys, seconds_per_block, time=True), t)
    fore_t = -F.col("__fore_t")
    earlier = F.col("__fore").isNull() | (F.col("__back").isNotNull() & (F.col(t) - F.col("__back_t") <= fore_t - F.col(t)))
    return both.withColumn(out, F.when(earlier, F.col("__back")).otherwise(F.col("__fore"))).drop("__back", "__back_t", "__fore", "__fore_t")


def in_interval(t: Column, windows: list[tuple[float, float]]) -> Column:
    """0-based number of the first half-open window that holds t, NULL in none. The windows are literals of the
    plan (laps of one session), so the join is an expression and needs no shuffle."""
    out = None
    for i, (a, b) in enumerate(windows):
        hit = (t >= F.lit(float(a))) & (t < F.lit(float(b)))
        out = F.when(hit, F.lit(i).cast("long")) if out is None else out.when(hit, F.lit(i).cast("long"))
    return F.lit(None).cast("long") if out is None else out


def interval_join(points: DataFrame, windows: DataFrame, t: str = "t", start: str = "start_s", end: str = "end_s", bucket: float = 60.0) -> DataFrame:
    """Points with the windows that hold them, start <= t < end, per session: an equi-join on buckets of time, to
    which a window that spans several is copied."""
    w = windows.withColumn("__k", F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("long"), F.floor(F.col(end) / bucket).cast("long"))))
    p = points.withColumn("__k", F.floor(F.col(t) / bucket).cast("long"))
    return p.join(w, ["session_id", "__k"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("__k")


def epoch_to_time(points: DataFrame, fixes: DataFrame, gps_rate: float, epoch: str = "epoch_ms", out: str = "t", ms_per_block: int = 3_600_000) -> DataFrame:
    """Session seconds of wall-clock milliseconds by interpolating between fixes (session_id, idx, value: epoch of the
    fix at position idx); clamped to the first and last fix."""
    s = fixes.where("value > 0").select("session_id", "idx", F.col("value").cast("double").alias("t"), (F.col("idx") / gps_rate).alias("value"))
    p = points.withColumn("__e", F.col(epoch).cast("double"))
    both = as_of(p, s, "__e", "__b", seconds_per_block=float(ms_per_block), time=True)
    both = _mirrored(as_of(_mirrored(both, "__e"), _mirrored(s, "t", "idx"), "__e", "__f", seconds_per_block=float(ms_per_block), time=True), "__e")
    span = -F.col("__f_t") - F.col("__b_t")
    part = F.when(span > 0, (F.col("__e") - F.col("__b_t")) / F.when(span > 0, span)).otherwise(0.0)
    between = F.col("__b") + (F.col("__f") - F.col("__b")) * part
    return both.withColumn(out, F.coalesce(between, "__b", "__f")).drop("__e", "__b", "__b_t", "__f", "__f_t")


def last_by(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value of the greatest ``order`` for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


__all__ = ["as_of", "epoch_to_time", "in_interval", "interpolate_fixed", "interval_join", "last_by", "nearest_event", "nearest_fixed", "positional"]
