"""Slicing, statistics and display reductions of one or two channels."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, nan
from ..kernels import spectral
from .blocked import windowed

KEYS = ["session_id", "channel_id"]


# ---- slices ----
def slice_by_time(samples: DataFrame, t0: float, t1: float, rate: float | None) -> DataFrame:
    """Samples of [t0, t1], both ends included, with 1e-9 of a sample's tolerance at fixed rate; rate 0 or None is
    event-driven and compares times. The bounds are literals, so they reach the Parquet scan."""
    if t1 < t0:
        return samples.limit(0)
    if not rate:
        return samples.where(F.col("t").between(t0, t1))
    return samples.where(F.col("idx").between(max(0, math.ceil(t0 * rate - 1e-9)), math.floor(t1 * rate + 1e-9)))


def slice_by_index(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open range of positions."""
    return samples.where((F.col("idx") >= max(0, start)) & (F.col("idx") < end))


def value_at(samples: DataFrame, i: int) -> DataFrame:
    """The sample at position i of each channel; none out of range."""
    return samples.where(F.col("idx") == i)


def finite_range(samples: DataFrame) -> DataFrame:
    """Least and greatest finite value of each channel (NULL without any)."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return samples.groupBy(*KEYS).agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"))


# ---- differences, flags and runs ----
def central_difference(samples: DataFrame, rate: float, out: str = "value") -> DataFrame:
    """Two-sided difference inside, one-sided at the ends; 0 for a single sample."""
    dt = F.lit(1.0 / rate)

    def make(w):
        before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        both = (after - before) / (2 * dt)
        return {"__d": F.coalesce(both, (after - v) / dt, (v - before) / dt, F.lit(0.0))}

    return windowed(samples, KEYS, "idx", 1, 1, make).withColumn(out, F.col("__d")).drop("__d")


def stationary(grid: DataFrame, accel: str, gyro: str, width: int, accel_std: float, gyro_mean: float, keys: list[str] | None = None, out: str = "stationary") -> DataFrame:
    """True where the causal rolling deviation of ``accel`` and rolling mean of ``gyro`` are both under their limits."""
    k = max(1, width) - 1

    def make(w):
        frame = w.rowsBetween(-k, 0)
        a, g = F.stddev_pop(accel).over(frame), F.avg(gyro).over(frame)
        return {out: (a < accel_std) & ~F.isnan(a) & (g < gyro_mean) & ~F.isnan(g)}

    return windowed(grid, keys or ["session_id"], "idx", k, 0, make)


def islands(df: DataFrame, keys: list[str], flag: Column, idx: str = "idx") -> DataFrame:
    """Maximal runs of equal ``flag`` over consecutive rows: keys, flag, start, end (inclusive), n.

    Only rows where the flag changes are ordered against each other; runs come from neighbouring changes."""
    marked = df.select(*keys, F.col(idx).alias("__i"), F.coalesce(flag, F.lit(False)).alias("flag"))
    step = windowed(marked, keys, "__i", 1, 0, lambda w: {"__p": F.lag("flag").over(w)})
    starts = step.where(F.col("__p").isNull() | (F.col("__p") != F.col("flag")))
    ends = marked.groupBy(*keys).agg(F.max("__i").alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__i")
    out = starts.withColumn("__n", F.lead("__i").over(w)).join(ends, keys)
    end = F.coalesce(F.col("__n") - 1, F.col("__last"))
    return out.select(*keys, "flag", F.col("__i").alias("start"), end.alias("end"), (end - F.col("__i") + 1).alias("n"))


def clip_runs(samples: DataFrame, rail: float = 32.0, eps: float = 0.05) -> DataFrame:
    """Inclusive runs of samples with abs(value) >= rail - eps."""
    return islands(samples, KEYS, F.abs("value") >= rail - eps).where("flag").drop("flag")


def close_short_gaps(runs: DataFrame, keys: list[str], most: int) -> DataFrame:
    """True runs after every false run of at most ``most`` rows between two true runs is filled (runs of ``islands``)."""
    w = Window.partitionBy(*keys).orderBy("start")
    inner = F.lag("flag").over(w).isNotNull() & F.lead("flag").over(w).isNotNull()
    filled = runs.select("*", (F.col("flag") | (inner & (F.col("n") <= most))).alias("__f"))
    edge = filled.select("*", F.lag("__f").over(w).alias("__p"))
    group = F.sum(F.when(F.col("__p").isNull() | (F.col("__p") != F.col("__f")), 1).otherwise(0)).over(w)
    return edge.withColumn("__g", group).where("__f").groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__g")


def sustained(runs: DataFrame, least: int) -> DataFrame:
    """Runs of at least ``least`` rows."""
    return runs.where(F.col("n") >= least)


# ---- histograms, scatter, tiles ----
def _spine(n: int, name: str, like: DataFrame) -> DataFrame:
    return like.sparkSession.range(n).select(F.col("id").alias(name))


def histogram(samples: DataFrame, bins: int, symmetric: bool = False, bounds: tuple[float, float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, lo, hi, n): equal-width counts of finite values, all bins present; the top edge counts in the last
    bin. ``bounds`` beats ``symmetric``; a range without width gives no rows."""
    keys = keys or KEYS
    v = samples.where(finite(F.col("value"))).select(*keys, "value")
    if bins <= 0:
        return v.limit(0).select(*keys, F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"))
    if bounds:
        limits = samples.groupBy(*keys).agg(F.lit(float(bounds[0])).alias("a"), F.lit(float(bounds[1])).alias("b"))
    else:
        limits = v.groupBy(*keys).agg(F.min("value").alias("a"), F.max("value").alias("b"))
        if symmetric:
            m = F.greatest(F.abs("a"), F.abs("b"))
            limits = limits.select(*keys, (-m).alias("a"), m.alias("b"))
    limits = limits.where("b > a")
    place = F.least(F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    counts = v.join(limits, keys).where("value >= a and value <= b").groupBy(*keys, place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    width = (F.col("b") - F.col("a")) / bins
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pair_finite(x: DataFrame, y: DataFrame, color: DataFrame | None = None) -> DataFrame:
    """(session_id, idx, x, y[, color]): samples paired by position over the shorter length, both finite; a missing
    colour is NaN."""
    out = x.select("session_id", "idx", F.col("value").alias("x")).join(y.select("session_id", "idx", F.col("value").alias("y")), ["session_id", "idx"])
    out = out.where(finite(F.col("x")) & finite(F.col("y")))
    if color is not None:
        out = out.join(color.select("session_id", "idx", F.col("value").alias("color")), ["session_id", "idx"], "left").withColumn("color", F.coalesce("color", nan()))
    return out


def scatter_points(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs thinned to at most ``most`` for each session by a uniform stride; x_min..y_max are those of all pairs."""
    from .blocked import dense_index

    extent = pairs.groupBy("session_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count(F.lit(1)).alias("__n"))
    stride = F.greatest(F.ceil(F.col("__n") / most), F.lit(1))
    placed = dense_index(pairs, ["session_id"], "idx", "__k")
    return placed.join(extent, "session_id").where(F.col("__k") % stride == 0).drop("__k", "__n")


def scatter_density(pairs: DataFrame, bins: int, equal_aspect: bool = False) -> DataFrame:
    """(session_id, row, col, n) over a bins x bins grid with every cell; row is y. With ``equal_aspect`` both axes
    share one range, symmetric about 0 where the data lies on both sides; an axis without width is cell 0."""
    bins = max(1, bins)
    e = pairs.groupBy("session_id").agg(F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
    if equal_aspect:
        lo, hi = F.least("xa", "ya"), F.greatest("xb", "yb")
        both = (lo < 0) & (hi > 0)
        m = F.greatest(-lo, hi)
        a, b = F.when(both, -m).otherwise(lo), F.when(both, m).otherwise(hi)
        e = e.select("session_id", a.alias("xa"), b.alias("xb"), a.alias("ya"), b.alias("yb"))

    def cell(v: str, a: str, b: str) -> Column:
        at = F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * bins)
        return F.when(F.col(b) <= F.col(a), F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("long")

    counts = pairs.join(e, "session_id").groupBy("session_id", cell("y", "ya", "yb").alias("row"), cell("x", "xa", "xb").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    every = F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")
    spine = e.select("session_id", F.explode(every).alias("row")).select("*", F.explode(every).alias("col"))
    return spine.join(counts, ["session_id", "row", "col"], "left").select("session_id", "row", "col", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Buckets of a tile; a tier's bucket holds 8 ** tier samples.
TILE = 1024


def tiles(samples: DataFrame, tier: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, tile, bucket, min_value, max_value) of every bucket that has samples at a tier: all tiles at once, with
    partial aggregation; NaN where a bucket has no finite sample."""
    size = 8**tier
    v = F.when(finite(F.col("value")), F.col("value"))
    at = F.floor(F.col("idx") / size).cast("long")
    out = samples.groupBy(*(keys or KEYS), at.alias("__b")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    return out.select(*(keys or KEYS), F.floor(F.col("__b") / TILE).cast("long").alias("tile"), (F.col("__b") % TILE).alias("bucket"), F.coalesce("lo", nan()).alias("min_value"), F.coalesce("hi", nan()).alias("max_value"))


def tile(samples: DataFrame, tier: int, number: int, keys: list[str] | None = None) -> DataFrame:
    """One tile with all of its 1024 buckets, NaN past the end. The index range reaches the scan."""
    keys = keys or KEYS
    size = 8**tier
    start = number * TILE * size
    made = tiles(slice_by_index(samples, start, start + TILE * size), tier, keys)
    spine = samples.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1)).cast("array<bigint>")))
    return spine.join(made.drop("tile"), [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("min_value", nan()).alias("min_value"), F.coalesce("max_value", nan()).alias("max_value"))


def tile_pyramid(lower: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The tier above one made by ``tiles``: each bucket from eight, without reading the samples again."""
    at = F.floor((F.col("tile") * TILE + F.col("bucket")) / 8).cast("long")
    out = lower.groupBy(*(keys or KEYS), at.alias("__b")).agg(F.min(F.when(~F.isnan("min_value"), F.col("min_value"))).alias("lo"), F.max(F.when(~F.isnan("max_value"), F.col("max_value"))).alias("hi"))
    return out.select(*(keys or KEYS), F.floor(F.col("__b") / TILE).cast("long").alias("tile"), (F.col("__b") % TILE).alias("bucket"), F.coalesce("lo", nan()).alias("min_value"), F.coalesce("hi", nan()).alias("max_value"))


# ---- spectra ----
#: Frames that one call transforms.
FRAMES = 256


def _frames(samples: DataFrame, rate: float, window: str, nperseg: int, noverlap: int, trend: str) -> DataFrame:
    """(keys, frame, start, size, w2, bin, power): unscaled power of overlapping frames, the segment's length and the sum of
    its window's squares.

    Each sample goes to the frames that hold it (at most ceil(nperseg / hop)); blocks of frames are transformed on
    their own, so a long channel spreads over all tasks. A segment of 0, or of at least the channel, is the whole
    of that channel in one frame."""
    import numpy as np

    spans = samples.groupBy(*KEYS).agg(F.min("idx").alias("__first"), F.max("idx").alias("__end"))
    n = F.col("__end") - F.col("__first") + 1
    size = F.when((n <= nperseg) | F.lit(nperseg == 0), n).otherwise(nperseg)
    spans = spans.select(*KEYS, "__first", n.alias("__n"), size.alias("__size")).withColumn("__hop", F.col("__size") - F.least(F.lit(noverlap), F.col("__size") - 1))
    at = samples.join(spans, KEYS).withColumn("__i", F.col("idx") - F.col("__first"))
    last = F.floor((F.col("__n") - F.col("__size")) / F.col("__hop")).cast("long")
    lo = F.greatest(F.ceil((F.col("__i") - F.col("__size") + 1) / F.col("__hop")).cast("long"), F.lit(0).cast("long"))
    hi = F.least(F.floor(F.col("__i") / F.col("__hop")).cast("long"), last)
    placed = at.where(hi >= lo).withColumn("frame", F.explode(F.sequence(lo, hi))).select(*KEYS, F.floor(F.col("frame") / FRAMES).alias("__block"), "frame", "__i", "__size", "__hop", "value")

    def transform(key, table):
        table = table.sort_by([("frame", "ascending"), ("__i", "ascending")])
        size, hop = table["__size"][0].as_py(), table["__hop"][0].as_py()
        x = table["value"].to_numpy().reshape(-1, size)
        w = spectral.weights(size, window)
        power = np.abs(np.fft.rfft(spectral.detrend_rows(x, trend) * w, axis=1)) ** 2
        m, bins = power.shape
        frame = np.repeat(table["frame"].to_numpy()[::size], bins)
        return pa.table({"session_id": [key[0].as_py()] * len(frame), "channel_id": [key[1].as_py()] * len(frame), "frame": frame, "start": frame * hop, "size": np.full(len(frame), size), "w2": np.full(len(frame), float((w * w).sum())), "bin": np.tile(np.arange(bins), m), "power": power.ravel()})

    return placed.groupBy(*KEYS, "__block").applyInArrow(transform, "session_id string, channel_id string, frame long, start long, size long, w2 double, bin long, power double")


def _scaled(power: Column, rate: float, scaling: str) -> Column:
    """Magnitude: root of the power. Density: by rate and window, doubled but for DC and an even segment's last bin."""
    if scaling == "magnitude":
        return F.sqrt(power)
    return power / (F.lit(float(rate)) * F.col("w2")) * F.when((F.col("bin") == 0) | (F.col("bin") * 2 == F.col("size")), 1.0).otherwise(2.0)


def spectrogram(samples: DataFrame, rate: float, window: str = "hann", nperseg: int = 256, noverlap: int = 128, trend: str = "none", scaling: str = "density", t0: float = 0.0) -> DataFrame:
    """(keys, frame, t, bin, freq, power) of overlapping frames; t is the middle of the frame. A channel no longer than a
    segment is one frame of its own length."""
    f = _frames(samples, rate, window, nperseg, noverlap, trend)
    return f.select(*KEYS, "frame", (F.lit(float(t0)) + (F.col("start") + F.col("size") / 2) / rate).alias("t"), "bin", (F.col("bin") * F.lit(float(rate)) / F.col("size")).alias("freq"), _scaled(F.col("power"), rate, scaling).alias("power"))


def welch(samples: DataFrame, rate: float, window: str = "hann", nperseg: int = 256, noverlap: int = 128, trend: str = "none", average: str = "mean", scaling: str = "density") -> DataFrame:
    """(keys, bin, freq, power): mean or median over the frames of a spectrogram, then scaled."""
    f = _frames(samples, rate, window, nperseg, noverlap, trend)
    combine = F.avg("power") if average == "mean" else F.percentile("power", F.lit(0.5))
    out = f.groupBy(*KEYS, "size", "w2", "bin").agg(combine.alias("power"))
    return out.select(*KEYS, "bin", (F.col("bin") * F.lit(float(rate)) / F.col("size")).alias("freq"), _scaled(F.col("power"), rate, scaling).alias("power"))
