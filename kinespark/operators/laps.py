"""Gates, laps, sectors and neutral zones.

Fixes are (session_id, idx, timestamp_ms, lat, lon) with coordinates in degrees x 1e7. Crossings are found in
one pass over neighbouring fixes; everything after works on crossings, which are few.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocked import dense_index, previous


@dataclass(frozen=True)
class Gate:
    lat1: float
    lon1: float
    lat2: float
    lon2: float


@dataclass(frozen=True)
class Zone:
    name: str
    enter: Gate
    exit: Gate


@dataclass(frozen=True)
class Timing:
    """kind circuit (one gate) or point_to_point (start and finish)."""

    kind: str
    start: Gate
    finish: Gate | None = None


@dataclass(frozen=True)
class Layout:
    timing: Timing
    sectors: tuple[tuple[str, Gate], ...] = ()
    zones: tuple[Zone, ...] = field(default=())


def gps_track(grid: DataFrame, lat: str, lon: str, epoch: str, extra: tuple[str, ...] = (), place: str | None = None) -> DataFrame:
    """Fixes of a grid: rows that have all three channels, without (0, 0), numbered anew; with the columns ``extra`` and,
    under the name ``place``, the position in the grid."""
    has = grid.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(epoch).isNotNull() & ~((F.col(lat) == 0) & (F.col(lon) == 0)))
    made = has.select("session_id", F.col("idx").alias("__o"), F.col(epoch).cast("long").alias("timestamp_ms"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), *extra)
    numbered = dense_index(made, ["session_id"], "__o")
    return numbered.withColumnRenamed("__o", place) if place else numbered.drop("__o")


def _crossing(gate: Gate) -> Column:
    """Time of the crossing between a fix (a_lat, a_lon, a_ms) and the next, or NULL.

    With the gate P + s R and the step A + u S: s in [0, 1], u in (0, 1], and not parallel."""
    rx, ry = gate.lat2 - gate.lat1, gate.lon2 - gate.lon1
    sx, sy = F.col("lat") - F.col("a_lat"), F.col("lon") - F.col("a_lon")
    det = F.lit(rx) * sy - F.lit(ry) * sx
    dx, dy = F.col("a_lat") - gate.lat1, F.col("a_lon") - gate.lon1
    safe = F.when(F.abs(det) >= 1e-15, det)
    s, u = (dx * sy - dy * sx) / safe, (dx * ry - dy * rx) / safe
    ok = (s >= 0) & (s <= 1) & (u > 0) & (u <= 1)
    part = u * (F.col("timestamp_ms") - F.col("a_ms"))
    rounded = F.when(part < 0, -F.floor(F.abs(part) + 0.5)).otherwise(F.floor(part + 0.5))
    return F.when(ok, F.col("a_ms") + rounded.cast("long"))


def crossings(fixes: DataFrame, gates: dict[str, Gate]) -> DataFrame:
    """(session_id, idx, gate, ms): every crossing of every gate, idx being the later fix of the step."""
    steps = previous(fixes, ["session_id"], "idx", {"a_lat": F.col("lat"), "a_lon": F.col("lon"), "a_ms": F.col("timestamp_ms")}).where("a_ms is not null")
    each = F.array(*[F.struct(F.lit(name).alias("gate"), _crossing(g).alias("ms")) for name, g in gates.items()])
    hit = F.filter(each, lambda x: x["ms"].isNotNull())
    return steps.select("session_id", "idx", F.explode(hit).alias("x")).select("session_id", "idx", "x.gate", "x.ms")


def circuit_laps(fixes: DataFrame, gate: Gate) -> DataFrame:
    """(session_id, lap, start_ms, end_ms): the first lap starts at the first fix, each crossing ends one."""
    first = fixes.groupBy("session_id").agg(F.min_by("timestamp_ms", "idx").alias("first_ms"))
    w = Window.partitionBy("session_id").orderBy("idx")
    hits = crossings(fixes, {"lap": gate}).join(first, "session_id")
    return hits.select("session_id", F.row_number().over(w).cast("long").alias("lap"), F.coalesce(F.lag("ms").over(w), F.col("first_ms")).alias("start_ms"), F.col("ms").alias("end_ms"))


def point_to_point_laps(fixes: DataFrame, start: Gate, finish: Gate) -> DataFrame:
    """Laps from the last start crossing before a finish crossing. A start re-arms; a finish counts only when armed
    by an earlier start; at the same time a start comes first, and such a finish leaves the lap armed."""
    hits = crossings(fixes, {"start": start, "finish": finish}).withColumn("__k", F.when(F.col("gate") == "start", 0).otherwise(1))
    w = Window.partitionBy("session_id").orderBy("idx", "ms", "__k")
    armed = hits.withColumn("__s", F.last(F.when(F.col("__k") == 0, F.col("ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a finish after its start ends the lap; it counts if no finish before it has ended the same start's lap
    done = armed.withColumn("__arm", F.sum(F.when(F.col("__k") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("__k") == 1) & F.col("__s").isNotNull() & (F.col("ms") > F.col("__s")))
    first = Window.partitionBy("session_id", "__arm").orderBy("idx", "ms")
    kept = done.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "ms")).cast("long").alias("lap"), F.col("__s").alias("start_ms"), F.col("ms").alias("end_ms"))


def sectors(fixes: DataFrame, laps: DataFrame, gates: tuple[tuple[str, Gate], ...]) -> DataFrame:
    """(session_id, lap, sector, name, start_ms, end_ms): boundaries are the lap's start, the first crossing of each
    sector gate within the lap in the order of the gates (missed gates are left out), and its end. Names go by
    position, S{n} beyond the list. Steps that leave the lap's fixes don't count."""
    if not gates:
        return laps.select("session_id", "lap", F.lit(0).cast("long").alias("sector"), F.lit("").alias("name"), "start_ms", "end_ms").limit(0)
    hits = crossings(fixes, {str(i): g for i, (_, g) in enumerate(gates)})
    step = previous(fixes, ["session_id"], "idx", {"a_ms": F.col("timestamp_ms")}).select("session_id", "idx", "a_ms", F.col("timestamp_ms").alias("b_ms"))
    hits = hits.join(step, ["session_id", "idx"])
    inside = hits.join(laps, "session_id").where("a_ms >= start_ms and b_ms <= end_ms")
    firsts = inside.groupBy("session_id", "lap", F.col("gate").cast("int").alias("g")).agg(F.min_by("ms", "idx").alias("ms"))
    marks = firsts.groupBy("session_id", "lap").agg(F.sort_array(F.collect_list(F.struct("g", "ms"))).alias("m"))
    cut = laps.join(marks, ["session_id", "lap"], "left").withColumn("edges", F.concat(F.array("start_ms"), F.coalesce(F.transform("m", lambda x: x["ms"]), F.array().cast("array<bigint>")), F.array("end_ms")))
    names = F.array(*[F.lit(n) for n, _ in gates])
    parts = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: F.struct(i.cast("long").alias("sector"), F.coalesce(F.get(names, i), F.concat(F.lit("S"), (i + 1).cast("string"))).alias("name"), F.get("edges", i).alias("start_ms"), F.get("edges", i + 1).alias("end_ms")))
    return cut.select("session_id", "lap", F.explode(parts).alias("s")).select("session_id", "lap", "s.*")


def pair_visits(enters: Column, exits: Column) -> Column:
    """Pairs (enter_ms, exit_ms) of two time-ordered arrays: each enter takes the first exit after it and after the
    exits taken before; a fold over the enters."""
    start = F.struct(F.array().cast("array<struct<enter_ms:bigint,exit_ms:bigint>>").alias("out"), F.lit(0).alias("j"))

    def step(acc, e):
        rest = F.filter(exits, lambda x, i: (i >= acc["j"]) & (x > e))
        exit_ = F.get(rest, F.lit(0))
        at = F.array_min(F.filter(F.transform(exits, lambda x, i: F.when((i >= acc["j"]) & (x > e), i)), lambda i: i.isNotNull()))
        return F.when(exit_.isNull(), F.struct(acc["out"].alias("out"), F.size(exits).alias("j"))).otherwise(F.struct(F.concat(acc["out"], F.array(F.struct(e.alias("enter_ms"), exit_.alias("exit_ms")))).alias("out"), (at + 1).alias("j")))

    return F.aggregate(enters, start, step, lambda acc: acc["out"])


def neutral_visits(fixes: DataFrame, laps: DataFrame, zones: tuple[Zone, ...]) -> DataFrame:
    """(session_id, lap, zone, enter_ms, exit_ms) of the visits to neutral zones within each lap's window."""
    gates = {f"{k}{i}": g for i, z in enumerate(zones) for k, g in (("e", z.enter), ("x", z.exit))}
    hits = crossings(fixes, gates).withColumn("__z", F.substring("gate", 2, 9).cast("int"))
    inside = hits.join(laps, "session_id").where("ms >= start_ms and ms <= end_ms")
    pick = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.substring("gate", 1, 1) == k, F.struct("idx", "ms")))), lambda x: x["ms"])
    lists = inside.groupBy("session_id", "lap", "__z").agg(pick("e").alias("enters"), pick("x").alias("exits"))
    found = lists.select("session_id", "lap", "__z", F.explode(pair_visits(F.col("enters"), F.col("exits"))).alias("v"))
    return found.select("session_id", "lap", F.get(F.array(*[F.lit(z.name) for z in zones]), F.col("__z")).alias("zone"), "v.enter_ms", "v.exit_ms")


def detect_laps(fixes: DataFrame, layout: Layout, window_ms: tuple[int, int] | None = None, origin: DataFrame | None = None) -> DataFrame:
    """(session_id, lap, start_ms, end_ms, raw_elapsed_ms, lap_time_ms, start_s, end_s, sectors, visits).

    ``window_ms`` keeps only fixes of a visit, both ends included. lap_time_ms is without neutral zones. Seconds
    are since ``origin(session_id, origin_ms)``, by default the first fix. Sessions of one fix have no laps."""
    if window_ms:
        fixes = dense_index(fixes.where(F.col("timestamp_ms").between(*window_ms)).withColumnRenamed("idx", "__o"), ["session_id"], "__o").drop("__o")
    t = layout.timing
    laps = circuit_laps(fixes, t.start) if t.kind == "circuit" else point_to_point_laps(fixes, t.start, t.finish)
    start = origin if origin is not None else fixes.groupBy("session_id").agg(F.min("timestamp_ms").alias("origin_ms"))
    out = laps.withColumn("raw_elapsed_ms", F.col("end_ms") - F.col("start_ms")).join(start, "session_id")
    own = ["session_id", "lap"]
    if layout.zones:
        v = neutral_visits(fixes, laps, layout.zones)
        out = out.join(v.groupBy(*own).agg(F.sum(F.col("exit_ms") - F.col("enter_ms")).alias("__off"), F.sort_array(F.collect_list(F.struct("enter_ms", "exit_ms", "zone"))).alias("visits")), own, "left")
    else:
        out = out.withColumn("__off", F.lit(0).cast("long")).withColumn("visits", F.lit(None).cast("array<struct<enter_ms:bigint,exit_ms:bigint,zone:string>>"))
    if layout.sectors:
        s = sectors(fixes, laps, layout.sectors)
        out = out.join(s.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("sector", "name", "start_ms", "end_ms"))).alias("sectors")), own, "left")
    else:
        out = out.withColumn("sectors", F.lit(None).cast("array<struct<sector:bigint,name:string,start_ms:bigint,end_ms:bigint>>"))
    seconds = lambda c: (F.col(c) - F.col("origin_ms")) / 1000.0
    return out.select(*own, "start_ms", "end_ms", "raw_elapsed_ms", (F.col("raw_elapsed_ms") - F.coalesce("__off", F.lit(0))).alias("lap_time_ms"), seconds("start_ms").alias("start_s"), seconds("end_ms").alias("end_s"), "sectors", "visits")


#: Mean radius of the earth in metres.
EARTH_RADIUS = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2.0 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cumulative_distance(fixes: DataFrame, scale: float = 1e-7) -> DataFrame:
    """Fixes with distance_m, the great-circle length up to each; ``idx`` may have gaps."""
    from .blocked import running_sum

    lat, lon = F.col("lat") * scale, F.col("lon") * scale
    step = previous(fixes, ["session_id"], "idx", {"__a": lat, "__o": lon})
    far = F.coalesce(haversine(F.col("__a"), F.col("__o"), lat, lon), F.lit(0.0))
    return running_sum(step, ["session_id"], "idx", far, "distance_m").drop("__a", "__o")
