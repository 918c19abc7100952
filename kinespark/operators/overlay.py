"""What an overlay shows at each video frame: gauges, trace strips, map position and the lap panel."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import raster
from . import joins

#: Most points of a trace strip; seconds after which a map position is stale; most points of the map's line.
TRACE_POINTS, STALE_S, MAP_POINTS = 256, 5.0, 1024


def frame_clock(spark: SparkSession, session_id: str, fps: float, duration_s: float, clip_start: float = 0.0, offset: float = 0.0) -> DataFrame:
    """(session_id, frame, t): frames of the clip and the session time each shows."""
    n = math.ceil(fps * duration_s)
    return spark.range(n).select(F.lit(session_id).alias("session_id"), F.col("id").alias("frame"), (F.lit(clip_start) + F.col("id") / fps + offset).alias("t"))


def gauge(frames: DataFrame, samples: DataFrame, rate: float, out: str = "value") -> DataFrame:
    """A channel's value at each frame: interpolated at fixed rate, carried forward if event-driven; NULL without data."""
    return joins.interpolate_fixed(frames, samples, rate, "t", out) if rate > 0 else joins.as_of(frames, samples, "t", out)


def trace(frames: DataFrame, samples: DataFrame, rate: float, window_s: float) -> DataFrame:
    """(session_id, frame, k, x, y): the channel's samples of the trailing window, thinned to TRACE_POINTS by a stride;
    x is the place in the window, y the value between the session's least and greatest (0.5 if those are equal)."""
    from .series import finite_range

    limits = finite_range(samples).select("session_id", "min_value", "max_value")
    span = frames.withColumn("start_s", F.col("t") - window_s).withColumn("end_s", F.col("t"))
    if rate > 0:
        lo, hi = F.greatest(F.ceil(F.col("start_s") * rate), F.lit(0)).cast("long"), F.floor(F.col("end_s") * rate).cast("long")
        last = samples.groupBy("session_id").agg(F.max("idx").alias("__last"))
        f = span.join(last, "session_id").withColumn("__lo", lo).withColumn("__hi", F.least(hi, F.col("__last"))).where("__hi >= __lo")
        stride = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / TRACE_POINTS), F.lit(1)).cast("long")
        each = f.select("session_id", "frame", "start_s", F.posexplode(F.sequence(F.col("__lo"), F.col("__hi"), stride)).alias("k", "idx"))
        got = each.join(samples.select("session_id", "idx", "value"), ["session_id", "idx"]).withColumn("ts", F.col("idx") / rate)
    else:
        from pyspark.sql import Window

        inside = joins.interval_join(samples.select("session_id", F.col("t").alias("ts"), "value"), span.select("session_id", "frame", "start_s", (F.col("end_s") + 1e-12).alias("end_s")), "ts")
        w = Window.partitionBy("session_id", "frame")
        n = F.count(F.lit(1)).over(w)
        at = inside.withColumn("__k", F.row_number().over(w.orderBy("ts")) - 1).withColumn("__s", F.greatest(F.ceil(n / TRACE_POINTS), F.lit(1)))
        got = at.where(F.col("__k") % F.col("__s") == 0).withColumn("k", (F.col("__k") / F.col("__s")).cast("int"))
    flat = F.col("min_value").isNull() | (F.col("max_value") <= F.col("min_value"))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    y = F.when(flat, 0.5).otherwise(unit((F.col("value") - F.col("min_value")) / (F.col("max_value") - F.col("min_value"))))
    return got.join(limits, "session_id", "left").select("session_id", "frame", "k", unit((F.col("ts") - F.col("start_s")) / window_s).alias("x"), y.alias("y"))


def normalised_map(fixes: DataFrame) -> DataFrame:
    """Fixes (session_id, idx, t, lat, lon) with x and y in the unit box of the session, y up: each axis by its own range,
    whatever its unit; 0.5 on an axis without width."""
    box = fixes.groupBy("session_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    unit = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.5)
    return fixes.join(box, "session_id").select("session_id", "idx", "t", unit("lon", "c", "d").alias("x"), unit("lat", "a", "b").alias("y"))


def map_line(normalised: DataFrame) -> DataFrame:
    """At most MAP_POINTS points of the map's line, by a uniform stride."""
    n = normalised.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n"))
    return normalised.join(n, "session_id").where(F.col("idx") % F.greatest(F.ceil(F.col("__n") / MAP_POINTS), F.lit(1)) == 0).drop("__n")


def map_position(frames: DataFrame, normalised: DataFrame) -> DataFrame:
    """(.., x, y) of the last fix at or before each frame; NULL before the first and once it is stale."""
    x = joins.as_of(frames, normalised.select("session_id", "t", F.col("x").alias("value")), "t", "x", time=True)
    both = joins.as_of(x, normalised.select("session_id", "t", F.col("y").alias("value")), "t", "y")
    fresh = F.col("t") - F.col("x_t") <= STALE_S
    return both.withColumn("x", F.when(fresh, F.col("x"))).withColumn("y", F.when(fresh, F.col("y"))).drop("x_t")


def lap_panel(frames: DataFrame, laps: list[tuple[int, float, float, int]]) -> DataFrame:
    """Frames with current_lap (NULL outside), lap_elapsed_s, last_lap_ms and best_lap_ms. ``laps``: (number, start_s,
    end_s, lap_time_ms) of one session, literals of the plan."""
    t = F.col("t")
    if not laps:
        nothing = F.lit(None).cast("long")
        return frames.select("*", nothing.alias("current_lap"), F.lit(0.0).alias("lap_elapsed_s"), nothing.alias("last_lap_ms"), nothing.alias("best_lap_ms"))
    number, start, end, ms = ([kind(x) for x in column] for kind, column in zip((int, float, float, int), zip(*sorted(laps, key=lambda x: x[1]), strict=True), strict=True))
    of = lambda column, k: F.get(F.lit(column), k)
    every = F.sequence(F.lit(0), F.lit(len(laps) - 1))
    current = F.try_element_at(F.filter(every, lambda k: (of(start, k) <= t) & (t < of(end, k))), F.lit(-1))
    over = F.filter(every, lambda k: of(end, k) <= t)
    out = frames.select("*", current.alias("__c"), over.alias("__o"))
    times = F.transform("__o", lambda k: of(ms, k).cast("long"))
    return out.select(
        *frames.columns,
        of(number, F.col("__c")).cast("long").alias("current_lap"),
        F.coalesce(t - of(start, F.col("__c")), F.lit(0.0)).alias("lap_elapsed_s"),
        F.try_element_at(times, F.lit(-1)).alias("last_lap_ms"),
        F.array_min(times).alias("best_lap_ms"),
    )


def _text(form) -> Callable[[Column], Column]:
    """A column of texts by a Python format, which rounds a number's exact value (the JVM's rounds its shortest decimals)."""

    def of(column: Column) -> Column:
        @F.pandas_udf("string")
        def shown(x: pd.Series) -> pd.Series:
            return x.map(form, na_action="ignore")

        return shown(column)

    return of


def elapsed_text(seconds: Column) -> Column:
    """m:ss.d, rounded within the minute."""
    return _text(raster.elapsed)(seconds.cast("double"))


def lap_text(ms: Column) -> Column:
    """m:ss.dd of milliseconds."""
    return _text(lambda x: raster.lap_time(int(x)))(ms.cast("long"))


def value_text(v: Column) -> Column:
    """One decimal from 10 up, two below."""
    return _text(raster.number)(v.cast("double"))


def sync(utc_anchor: tuple[float, float] | None, creation_ms: float | None, duration_s: float, session_start_ms: float, session_s: float) -> tuple[float, str, float]:
    """(offset_s, method, confidence) of a video: from (video seconds, epoch ms) of its telemetry, else from the
    container's creation time. The video must overlap the session."""
    from ..errors import InputError

    if utc_anchor is not None:
        offset, method, sure = (utc_anchor[1] - session_start_ms) / 1000.0 - utc_anchor[0], "gpmf", 0.9
    elif creation_ms is not None:
        offset, method, sure = (creation_ms - session_start_ms) / 1000.0, "creation_time", 0.3
    else:
        raise InputError("parse", "no sync anchor: neither telemetry time nor creation time; give an offset")
    if offset + duration_s < 0 or offset > session_s:
        raise InputError("no_overlap", f"the video spans [{offset:.1f}, {offset + duration_s:.1f}] of a session of {session_s:.1f} s")
    return offset, method, sure


def rendered(frames: DataFrame, layout, columns: dict[str, str], size: tuple[int, int], traces: dict | None = None, line=None) -> DataFrame:
    """(frame, pixels): straight RGBA pictures of an overlay, rows top down, drawn in parallel by frame.

    ``frames`` has a column per gauge (``columns``: channel to column name) and, as the layout needs them, x and y of the
    map, and current_lap, lap_elapsed_s, last_lap_ms and best_lap_ms. ``traces``: (channel, window in seconds), or channel, to the column that holds an
    array of (x, y) structs; ``line``: the map's points, the same for all frames."""
    import pyarrow as pa

    elements, traces, line = list(layout.elements), dict(traces or {}), list(line or [])

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.array([raster.draw(elements, row, columns, size, traces, line).tobytes() for row in rows], pa.binary())], ["frame", "pixels"])

    return frames.mapInArrow(run, "frame long, pixels binary")
