"""Track visits: which known track a session was on, and when."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocked import BLOCK, fill_forward, running_sum, windowed

#: Metres per degree, for coordinates in degrees x 1e7.
METRES = 111_320.0 / 1e7


def candidates(fixes: DataFrame, tracks: dict[str, list[tuple[float, float]]]) -> list[str]:
    """The tracks whose box meets that of a session with two fixes or more; those of less than two points never do."""
    box = fixes.groupBy("session_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    usable = {k: v for k, v in tracks.items() if len(v) >= 2}
    if not usable:
        return []
    meets = [F.max((F.col("a") <= max(p[0] for p in v)) & (F.col("b") >= min(p[0] for p in v)) & (F.col("c") <= max(p[1] for p in v)) & (F.col("d") >= min(p[1] for p in v))) for v in usable.values()]
    return [k for k, hit in zip(usable, box.agg(*meets).first(), strict=True) if hit]


def visits(fixes: DataFrame, tracks: dict[str, list[tuple[float, float]]], threshold_m: float = 30.0, gap_s: float = 5.0, least_s: float = 30.0) -> DataFrame:
    """(session_id, track_id, start_ms, end_ms).

    Each fix belongs to the track whose polyline is nearest, if strictly within ``threshold_m`` (tracks whose box
    does not meet the session's are left out). A visit ends where the track changes, or at an off-track fix more
    than ``gap_s`` after the last on-track one; a silent gap alone ends nothing. Visits shorter than ``least_s`` go.
    The polylines are literals of the plan: the join to segments is an expression per fix.
    """
    spark = fixes.sparkSession
    usable = {k: v for k, v in tracks.items() if len(v) >= 2}
    empty = spark.createDataFrame([], "session_id string, track_id string, start_ms long, end_ms long")
    if not usable:
        return empty
    box = fixes.groupBy("session_id").agg(F.min("lat").alias("__a"), F.max("lat").alias("__b"), F.min("lon").alias("__c"), F.max("lon").alias("__d"), F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    scale = F.abs(F.cos((F.col("__a") + F.col("__b")) / 2 / 1e7 * math.pi / 180.0)) * METRES
    f = fixes.join(box.withColumn("__s", scale), "session_id").withColumn("__x", F.col("lat") * METRES).withColumn("__y", F.col("lon") * F.col("__s"))
    options = []
    for order, (name, line) in enumerate(usable.items()):
        lats, lons = [p[0] for p in line], [p[1] for p in line]
        line_points = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in line])

        def square(i):
            p, q = F.get(line_points, i), F.get(line_points, i + 1)
            ax, ay = p["a"] * METRES, p["b"] * F.col("__s")
            dx, dy = q["a"] * METRES - ax, q["b"] * F.col("__s") - ay
            length = dx * dx + dy * dy
            u = F.when(length > 0, F.least(F.greatest(((F.col("__x") - ax) * dx + (F.col("__y") - ay) * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
            ex, ey = F.col("__x") - ax - u * dx, F.col("__y") - ay - u * dy
            return ex * ex + ey * ey

        near = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(line) - 2)), square))
        meets = (F.col("__a") <= max(lats)) & (F.col("__b") >= min(lats)) & (F.col("__c") <= max(lons)) & (F.col("__d") >= min(lons))
        options.append(F.when(meets & (near < threshold_m * threshold_m), F.struct(near.alias("d"), F.lit(order).alias("o"), F.lit(name).alias("track"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    on = f.select("session_id", "idx", "timestamp_ms", best["track"].alias("track"))
    # for an on-track fix: the last on-track fix before it, and whether an off-track fix since then came too late
    own, block = ["session_id"], F.floor(F.col("idx") / BLOCK).cast("long")
    before = lambda df, c: windowed(df, own, "idx", 1, 0, lambda w: {f"{c}_before": F.lag(c).over(w)})
    here = F.when(F.col("track").isNotNull(), F.struct("timestamp_ms", "track", "idx"))
    marked = before(fill_forward(on.withColumn("__l", here), own, ["idx"], block, ["__l"]), "__l")
    late = F.col("track").isNull() & (F.col("timestamp_ms") - F.col("__l_before.timestamp_ms") > int(round(gap_s * 1000)))
    marked = before(fill_forward(marked.withColumn("__late", F.when(late, F.col("idx"))), own, ["idx"], block, ["__late"]), "__late").where("track is not null")
    cut = F.col("__l_before").isNull() | (F.col("__l_before.track") != F.col("track")) | (F.coalesce("__late_before", F.lit(-1)) > F.col("__l_before.idx"))
    numbered = running_sum(marked, own, "idx", cut.cast("int"), "__g")
    grouped = numbered.groupBy("session_id", "track", "__g").agg(F.min_by("timestamp_ms", "idx").alias("start_ms"), F.max_by("timestamp_ms", "idx").alias("end_ms"))
    return grouped.where(F.col("end_ms") - F.col("start_ms") >= int(round(least_s * 1000))).select("session_id", F.col("track").alias("track_id"), "start_ms", "end_ms")
