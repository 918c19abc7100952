"""Channels made from others: the Time ramp, Distance, and the shared grid of inertial units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocked import dense_index, greatest_before, running_sum, windowed
from .quantiles import order_statistics


def time_base(channels: DataFrame) -> DataFrame:
    """(session_id, rate_hz, len) of the Time ramp: the greatest fixed rate and the longest channel at it."""
    fixed = channels.where("rate_hz > 0")
    top = fixed.groupBy("session_id").agg(F.max("rate_hz").alias("rate_hz"))
    return fixed.join(top, ["session_id", "rate_hz"]).groupBy("session_id", "rate_hz").agg(F.max("len").alias("len"))


#: Positions made by one task of the ramp.
RAMP_BLOCK = 1 << 20


def time_ramp(channels: DataFrame) -> DataFrame:
    """Samples of the Time channel, value = t = idx / rate; sessions without a fixed-rate channel have none."""
    base = time_base(channels).where("len > 0")
    blocks = base.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / RAMP_BLOCK).cast("long"))))
    lo = F.col("b") * RAMP_BLOCK
    rows = blocks.withColumn("idx", F.explode(F.sequence(lo, F.least(lo + RAMP_BLOCK, F.col("len")) - 1)))
    t = F.col("idx") / F.col("rate_hz")
    return rows.select("session_id", F.lit("Time").alias("channel_id"), "idx", t.alias("t"), t.alias("value"))


def distance(samples: DataFrame, channels: DataFrame, speed: str = "GPS_SpeedKmh") -> DataFrame:
    """Samples of the Distance channel: the trapezoid integral of speed / 3.6 at its rate, interpolated onto the Time
    ramp; 0 at or before time 0, the last value past the end."""
    own = channels.where(F.col("channel_id") == speed).select("session_id", F.col("rate_hz").alias("base_rate"))
    v = samples.where(F.col("channel_id") == speed).join(own, "session_id")
    step = windowed(v, ["session_id"], "idx", 1, 0, lambda w: {"__s": F.coalesce((F.lag("value").over(w) + F.col("value")) / 3.6 * 0.5 / F.col("base_rate"), F.lit(0.0))})
    base = running_sum(step, ["session_id"], "idx", F.col("__s"), "d").select("session_id", "idx", "d")
    last = base.groupBy("session_id").agg(F.max("idx").alias("__last"), F.max_by("d", "idx").alias("__end"))
    ramp = time_ramp(channels).join(own, "session_id").join(last, "session_id")
    f = F.col("t") * F.col("base_rate")
    at = ramp.withColumn("__f", f).withColumn("__k", F.floor(f).cast("long"))
    a = base.select("session_id", F.col("idx").alias("__k"), F.col("d").alias("__a"))
    b = base.select("session_id", (F.col("idx") - 1).alias("__k"), F.col("d").alias("__b"))
    part = F.col("__f") - F.col("__k")
    value = F.when(F.col("__f") <= 0, 0.0).when(F.col("__f") >= F.col("__last"), F.col("__end")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * part)
    joined = at.join(a, ["session_id", "__k"], "left").join(b, ["session_id", "__k"], "left")
    return joined.select("session_id", F.lit("Distance").alias("channel_id"), "idx", "t", value.alias("value"))


def rebuild_imu_grid(records: DataFrame, period_us: int) -> tuple[DataFrame, DataFrame]:
    """(samples, gaps) of inertial records on one shared grid.

    ``records(session_id, imu, channel_id, slot, first_us, raw)``: kept records with their slot since the unit's first
    sample. The grid starts at the earliest first sample; a unit's leading and trailing slots repeat its first and last
    value, inner ones are linear between their neighbours, in whole raw counts with halves away from zero. Channels
    of under two records stay as they are.
    """
    start = records.groupBy("session_id").agg(F.min("first_us").alias("__start"))
    sizes = records.groupBy("session_id", "channel_id").agg(F.count(F.lit(1)).alias("__n"))
    r = records.join(start, "session_id").join(sizes, ["session_id", "channel_id"])
    r = r.withColumn("__lead", F.floor((F.col("first_us") - F.col("__start")) / period_us + 0.5).cast("long"))
    r = r.withColumn("idx", F.when(F.col("__n") > 1, F.col("slot") + F.col("__lead")).otherwise(F.col("slot"))).drop("__start", "__n", "__lead")
    length = r.groupBy("session_id").agg((F.max("idx") + 1).alias("__len"))
    # neighbours by position among the channel's records, so that any gap between two of them is one step
    r = dense_index(r.join(length, "session_id"), ["session_id", "channel_id"], "idx", "__p")
    r = windowed(r, ["session_id", "channel_id"], "__p", 1, 1, lambda w: {"__next": F.lead("idx").over(w), "__v": F.lead("raw").over(w), "__prev": F.lag("idx").over(w)}).drop("__p")
    many = F.col("__next").isNotNull() | F.col("__prev").isNotNull()
    from_ = F.when(F.col("__prev").isNull() & many, F.lit(0).cast("long")).otherwise(F.col("idx"))
    to = F.when(F.col("__next").isNotNull(), F.col("__next") - 1).when(many, F.col("__len") - 1).otherwise(F.col("idx"))
    each = r.withColumn("__i", F.explode(F.sequence(from_, to)))
    part = (F.col("__i") - F.col("idx")) / (F.col("__next") - F.col("idx"))
    line = F.col("raw") + (F.col("__v") - F.col("raw")) * part
    rounded = F.when(line < 0, -F.floor(F.abs(line) + 0.5)).otherwise(F.floor(line + 0.5))
    value = F.when((F.col("__i") <= F.col("idx")) | F.col("__next").isNull(), F.col("raw").cast("double")).otherwise(rounded.cast("double"))
    samples = each.select("session_id", "channel_id", F.col("__i").alias("idx"), (F.col("__i") * period_us / 1e6).alias("t"), value.alias("value"))
    spans = r.select("session_id", "channel_id", F.explode(F.array_compact(F.array(F.when(many & F.col("__prev").isNull() & (F.col("idx") > 0), F.struct(F.lit(0).cast("long").alias("start"), F.col("idx").alias("len"))), F.when(F.col("__next") - F.col("idx") > 1, F.struct((F.col("idx") + 1).alias("start"), (F.col("__next") - F.col("idx") - 1).alias("len"))), F.when(F.col("__next").isNull() & many & (F.col("idx") < F.col("__len") - 1), F.struct((F.col("idx") + 1).alias("start"), (F.col("__len") - 1 - F.col("idx")).alias("len")))))).alias("g"))
    return samples, spans.select("session_id", "channel_id", "g.start", "g.len")


def place_slots(records: DataFrame, period_us: int) -> DataFrame:
    """Records (session_id, imu, seq, ts_us) with slot, high and kept: the slot is the rounded number of periods since the
    unit's first record, high the greatest slot before, and a record counts only if its slot is beyond that."""
    own = ["session_id", "imu"]
    first = records.groupBy(*own).agg(F.min_by("ts_us", "seq").alias("first_us"))
    s = records.join(first, own).withColumn("slot", F.floor((F.col("ts_us") - F.col("first_us")) / period_us + 0.5).cast("long"))
    s = greatest_before(s, own, "seq", "slot", "high")
    return s.withColumn("kept", F.col("high").isNull() | (F.col("slot") > F.col("high")))


def drop_report(records: DataFrame, period_us: int) -> DataFrame:
    """Per unit: received, kept, collisions (same slot), backsteps, fills, and gaps by missing slots 1, 2-3, 4-9, 10-49, 50+."""
    p = place_slots(records, period_us).withColumnRenamed("high", "__h")
    miss = F.when(F.col("kept") & F.col("__h").isNotNull(), F.col("slot") - F.col("__h") - 1).otherwise(0)
    count = lambda c: F.count_if(c).alias
    p = p.withColumn("__m", miss)
    m = F.col("__m")
    return p.groupBy("session_id", "imu").agg(
        F.count(F.lit(1)).alias("received"), count(F.col("kept"))("kept"), count(~F.col("kept") & (F.col("slot") == F.col("__h")))("collisions"), count(~F.col("kept") & (F.col("slot") < F.col("__h")))("backsteps"),
        F.sum("__m").alias("fills"), count(m == 1)("gaps_1"), count(m.between(2, 3))("gaps_2_3"), count(m.between(4, 9))("gaps_4_9"), count(m.between(10, 49))("gaps_10_49"), count(m >= 50)("gaps_50"),
    )


def sag_stats(values: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Per group: n, mean, population deviation, skewness and nearest-rank quantiles of finite values."""
    from ..functions.scalar import finite

    v = values.where(finite(F.col(value))).select(by, F.col(value).cast("double").alias(value))
    n = v.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.skewness(value).alias("skew"))
    at = lambda q: F.least(F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)), F.col("n"))
    found = order_statistics(v, [by], value, {f"q{int(q * 100):02d}": at(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)})
    return n.join(found, by)


def diagnostic_report(lines: DataFrame) -> DataFrame:
    """What the recorder's diagnostic log says, from its text lines (column value), a row for each line of interest:
    kind (boot, drain, cycle or brownout), t, and of a boot: reason; of a drain: imu, bus, drains, pairs, ovr, reuse, unk,
    read_avg_us, read_max_us, total_avg_us, total_max_us; of a cycle: cycle_max_us, writer_drops, poll_ms, cap. flag says
    overruns, unknown_tags or writer_drops. A key that a line repeats has its first value; what is missing is NULL."""
    line = F.trim(F.col("value"))
    key = lambda k: F.nullif(F.regexp_extract(line, rf"(?:^|\s){k}=(\S*)", 1), F.lit(""))
    number = lambda k: key(k).try_cast("long")
    part = lambda k, i: F.get(F.split(key(k), "/"), F.lit(i)).try_cast("long")
    drain = line.contains("EVT IMU") & line.contains("drains=")
    cycle = line.contains("EVT IMU cycle_max_us=")
    kind = F.when(line.startswith("==== BOOT"), "boot").when(drain, "drain").when(cycle, "cycle").when(line.contains("BROWNOUT"), "brownout")
    token = lambda i: F.nullif(F.regexp_extract(line, r"EVT\s+(\S+)\s+(\S+)", i), F.lit(""))
    only = lambda k, c, name: F.when(F.col("kind") == k, c).alias(name)
    found = lines.select("value", kind.alias("kind")).where("kind is not null")
    flag = F.when((F.col("kind") == "drain") & (number("ovr") != 0), "overruns").when((F.col("kind") == "drain") & (number("unk") != 0), "unknown_tags").when((F.col("kind") == "cycle") & (number("writer_drops") != 0), "writer_drops")
    return found.select(
        "kind", key("t").alias("t"), only("boot", key("reason"), "reason"), only("drain", token(1), "imu"), only("drain", token(2), "bus"),
        *[only("drain", number(k), k) for k in ("drains", "pairs", "ovr", "reuse", "unk")],
        *[only("drain", part(k, i), f"{name}_{of}_us") for k, name in (("read_us", "read"), ("tot_us", "total")) for i, of in enumerate(("avg", "max"))],
        *[only("cycle", number(k), k) for k in ("cycle_max_us", "writer_drops", "poll_ms", "cap")], flag.alias("flag"),
    )


def boots(report: DataFrame) -> DataFrame:
    """(reason, boots) of a ``diagnostic_report``."""
    return report.where("kind = 'boot'").groupBy(F.coalesce("reason", F.lit("?")).alias("reason")).agg(F.count(F.lit(1)).alias("boots"))
