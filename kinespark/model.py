"""The data model: sessions, channels, samples and gaps as DataFrames.

``samples`` is long: (session_id, channel_id, idx, t, value), one row per sample, ordered by idx within a
channel. A *grid* is the wide form (session_id, idx, one column per channel) on which expressions run: one
shuffle by (session_id, idx) whatever the number of channels, and no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSIONS = "session_id string, device_id string, timestamp_utc_ms long, config_checksum string, truncation_warning string"
CHANNELS = "session_id string, channel_id string, ord int, rate_hz double, len long, is_event_driven boolean, synthesized boolean, data_type byte, scale double, offset double, units string"
SAMPLES = "session_id string, channel_id string, idx long, t double, value double"
GAPS = "session_id string, channel_id string, start long, len long"

#: Type codes of raw columns, their names and widths in bytes.
TYPE_CODES = {0: ("u8", 1), 1: ("u16", 2), 2: ("u32", 4), 3: ("i8", 1), 4: ("i16", 2), 5: ("i32", 4), 6: ("f32", 4), 7: ("f64", 8)}


def widen(raw, scale: float, offset: float, data_type: int):
    """Physical value of a raw column: scaled and offset, but doubles as they are (which keeps -0.0)."""
    return raw.cast("double") if data_type == 7 else raw.cast("double") * F.lit(float(scale)) + F.lit(float(offset))


def column_name(channel: str) -> str:
    """Name of a channel's column in a grid."""
    return "ch_" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in channel)


def grid(samples: DataFrame, channels: list[str]) -> DataFrame:
    """(session_id, idx, one column per channel): a channel without a sample at idx is NULL there."""
    one = [F.max(F.when(F.col("channel_id") == c, F.col("value"))).alias(column_name(c)) for c in channels]
    return samples.where(F.col("channel_id").isin(channels)).groupBy("session_id", "idx").agg(*one)


@dataclass(frozen=True)
class ChannelInfo:
    rate: float
    length: int | None  # None: differs between sessions


@dataclass
class SessionSet:
    """Base frames and the registry of derived channels (base channels win on lookup)."""

    samples: DataFrame
    channels: DataFrame
    sessions: DataFrame | None = None
    gaps: DataFrame | None = None
    derived: dict[str, DataFrame] = field(default_factory=dict)  # name -> samples-shaped frame
    info: dict[str, ChannelInfo] = field(default_factory=dict)

    @staticmethod
    def from_samples(samples: DataFrame, rates: dict[str, float] | float, event_driven: tuple[str, ...] = ()) -> SessionSet:
        """Channel metadata from the samples: length is the count of rows; ``rates`` by channel, or one for all."""
        found = samples.groupBy("session_id", "channel_id").agg(F.count(F.lit(1)).alias("len"))
        if isinstance(rates, dict):
            rate = F.coalesce(*[F.when(F.col("channel_id") == k, F.lit(float(v))) for k, v in rates.items()], F.lit(0.0))
        else:
            rate = F.when(F.col("channel_id").isin(list(event_driven)), F.lit(0.0)).otherwise(F.lit(float(rates)))
        out = found.select("session_id", "channel_id", F.lit(0).alias("ord"), rate.alias("rate_hz"), "len", (rate == 0).alias("is_event_driven"), F.lit(False).alias("synthesized"), F.lit(7).cast("byte").alias("data_type"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit("").alias("units"))
        return SessionSet(samples, out)

    def load_info(self) -> dict[str, ChannelInfo]:
        """Rates and lengths by channel name, for plan-time checks: a row for each distinct name."""
        if not self.info:
            rows = self.channels.groupBy("channel_id").agg(F.min("rate_hz"), F.max("rate_hz"), F.min("len"), F.max("len")).collect()
            self.info = {r[0]: ChannelInfo(r[1] if r[1] == r[2] else float("nan"), r[3] if r[3] == r[4] else None) for r in rows}
        return self.info

    def same_length(self, a: str, b: str) -> bool:
        """Whether two channels have one length in every session that has both."""
        if (x := self.load_info().get(a)) and (y := self.info.get(b)) and x.length is not None and y.length is not None:
            return x.length == y.length
        both = self.channels.where(F.col("channel_id").isin(a, b)).groupBy("session_id").agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
        return both.where("lo <> hi").isEmpty()

    def frame(self, name: str) -> DataFrame | None:
        if name in self.load_info():
            return self.samples.where(F.col("channel_id") == name)
        return self.derived.get(name)

    def store(self, name: str, frame: DataFrame) -> None:
        """Register (or replace) a derived channel; base channels of that name still win on lookup."""
        self.derived[name] = frame

    def retain_derived(self, names: set[str]) -> None:
        for k in [k for k in self.derived if k not in names]:
            del self.derived[k]

    def slice_lap(self, channel: str, role: str, lap: int, t0: float, t1: float) -> tuple[str, int]:
        """Store the samples of [t0, t1] under a name of their own, numbered anew; (name, samples). The same channel, role
        and lap replace each other; an empty slice stores nothing."""
        from .operators.series import slice_by_time

        name = f"\x01{channel}\x01{role}\x01{lap}"
        info = self.load_info().get(channel)
        rate = info.rate if info else getattr(self, "derived_info", {}).get(channel, (0.0,))[0]
        base = self.frame(channel)
        if base is None:
            return name, 0
        if "t" not in base.columns:
            base = base.withColumn("t", F.col("idx") / rate)
        cut = slice_by_time(base, t0, t1, rate)
        first = cut.groupBy("session_id").agg(F.min("idx").alias("__0"))
        made = cut.join(first, "session_id").select("session_id", (F.col("idx") - F.col("__0")).alias("idx"), "value")
        n = made.count()
        if n:
            self.store(name, made)
            if not hasattr(self, "derived_info"):
                self.derived_info = {}
            self.derived_info[name] = (rate, name)
        return name, n

    def metadata(self) -> DataFrame:
        """channels with duration_ms: fixed rate round(len / rate * 1000); event-driven the last time, rounded, or 0."""
        last = self.samples.groupBy("session_id", "channel_id").agg(F.max("t").alias("last"))
        event = F.coalesce(F.round(F.col("last") * 1000), F.lit(0.0))
        return self.channels.join(last, ["session_id", "channel_id"], "left").withColumn("duration_ms", F.when(F.col("rate_hz") > 0, F.round(F.col("len") / F.col("rate_hz") * 1000)).otherwise(event).cast("long")).drop("last")
