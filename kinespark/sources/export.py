"""CSV and JSON exports of channels, as DataFrames that any Spark writer can store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..model import SessionSet


def select_channels(data: SessionSet, names: list[str] | None) -> list[str]:
    """The wanted channels in the order asked for; all in channel order without a list. Unknown names are errors."""
    known = data.load_info()
    if names is None:
        order = data.channels.groupBy("channel_id").agg(F.min("ord").alias("o")).orderBy("o", "channel_id").collect()
        return [r[0] for r in order]
    for n in names:
        if n not in known and n not in data.derived:
            raise InputError("unknown_channel", f"unknown channel {n!r}")
    return list(dict.fromkeys(names))


def export_rows(data: SessionSet, names: list[str] | None = None) -> DataFrame:
    """(channel, time_s, value), ordered by channel as selected and by position, for one session or all."""
    chosen = select_channels(data, names)
    rank = F.array_position(F.array(*[F.lit(n) for n in chosen]), F.col("channel_id"))
    base = data.samples.where(F.col("channel_id").isin(chosen)).select("session_id", "channel_id", "idx", "t", "value")
    for n in chosen:
        if n not in data.load_info():
            rate = getattr(data, "derived_info", {}).get(n, (0.0,))[0]
            t = F.col("idx") / rate if rate else F.lit(0.0)
            base = base.unionByName(data.derived[n].select("session_id", F.lit(n).alias("channel_id"), "idx", t.alias("t"), "value"))
    return base.orderBy("session_id", rank, "idx").select(F.col("channel_id").alias("channel"), F.col("t").alias("time_s"), "value")


def write_csv(data: SessionSet, path: str, names: list[str] | None = None) -> None:
    export_rows(data, names).write.option("header", True).csv(path)


def export_json(data: SessionSet, names: list[str] | None = None) -> DataFrame:
    """(session_id, json): one nested document per session with its channels' samples. A channel must fit in a row."""
    chosen = select_channels(data, names)
    s = data.samples.where(F.col("channel_id").isin(chosen))
    lists = s.groupBy("session_id", "channel_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value", "t"))).alias("v"))
    c = data.channels.select("session_id", "channel_id", "ord", "rate_hz", "synthesized", "is_event_driven")
    rank = F.array_position(F.array(*[F.lit(n) for n in chosen]), F.col("channel_id"))
    one = F.struct(rank.alias("rank"), F.col("channel_id"), F.col("rate_hz").alias("sample_rate_hz"), "synthesized", "is_event_driven", F.transform("v", lambda x: x["value"]).alias("samples"), F.when(F.col("is_event_driven"), F.transform("v", lambda x: x["t"])).alias("sample_times_secs"))
    docs = lists.join(c, ["session_id", "channel_id"]).groupBy("session_id").agg(F.sort_array(F.collect_list(one)).alias("channels"))
    if data.sessions is not None:
        docs = docs.join(data.sessions, "session_id", "left")
    else:
        docs = docs.select("*", F.lit("").alias("device_id"), F.lit(None).cast("long").alias("timestamp_utc_ms"), F.lit("").alias("config_checksum"))
    channels = F.transform("channels", lambda x: x.dropFields("rank"))
    return docs.select("session_id", F.to_json(F.struct(F.struct("session_id", "device_id", "timestamp_utc_ms", "config_checksum").alias("session"), channels.alias("channels"))).alias("json"))


def infer_format(path: str | None, flag: str | None = None) -> str:
    """csv or json: the flag, else the file's extension, else csv without a file."""
    if flag in ("csv", "json"):
        return flag
    if path is None:
        return "csv"
    for kind in ("csv", "json"):
        if path.lower().endswith(f".{kind}"):
            return kind
    raise ValueError(f"can't tell the export format of {path!r}; name one")
