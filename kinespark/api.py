"""One method for each command of a recording's analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InputError, envelope
from .kernels import estimate
from .model import TYPE_CODES, SessionSet, column_name, grid
from .operators import joins, laps, overlay, series, suspension, tables, tracks
from .plans.compile import LapContext, apply_definitions, evaluate
from .sources import config, export, fit, log, video


class Engine:
    """Analysis of a set of sessions."""

    def __init__(self, spark: SparkSession, data: SessionSet):
        self.spark, self.data = spark, data

    @staticmethod
    def open(spark: SparkSession, path: str, pattern: str = "*") -> Engine:
        """Logs under a path."""
        return Engine(spark, log.read_logs(spark, path, pattern))

    @staticmethod
    def from_samples(spark: SparkSession, samples: DataFrame, rates) -> Engine:
        return Engine(spark, SessionSet.from_samples(samples, rates))

    # ---- metadata ----
    def sessions(self) -> DataFrame:
        """Sessions with their duration: that of the longest channel."""
        longest = self.data.metadata().groupBy("session_id").agg(F.max("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("channels"))
        return longest if self.data.sessions is None else self.data.sessions.join(longest, "session_id", "left")

    def channels(self) -> DataFrame:
        return self.data.metadata()

    # ---- expressions ----
    def evaluate(self, text: str, context: LapContext | None = None) -> DataFrame:
        return evaluate(self.data, text, context)[0]

    def apply_workbook(self, text: str, context: LapContext | None = None) -> list[tuple[str, Exception]]:
        """Store a workbook's math channels; returns the failures."""
        return apply_definitions(self.data, config.read_workbook(text).math_channels, context)

    # ---- export ----
    def export(self, path: str, names: list[str] | None = None, kind: str | None = None) -> None:
        if export.infer_format(path, kind) == "csv":
            export.write_csv(self.data, path, names)
        else:
            export.export_json(self.data, names).select("json").write.text(path)

    def fixes(self, extra: dict[str, str] | None = None, place: str | None = None) -> DataFrame:
        """GPS fixes (session_id, idx, timestamp_ms, lat, lon) and, of ``extra``, channels of the same positions by the name
        of their column; ``place`` names a column for the position in the GPS channels."""
        extra = extra or {}
        need = ["GPS_Latitude", "GPS_Longitude", "GPS_EpochMs"]
        missing = [n for n in need if n not in self.data.load_info()]
        if missing:
            raise InputError("parse", f"no GPS: {', '.join(missing)}")
        g = grid(self.data.samples, [*need, *extra])
        f = laps.gps_track(g, *[column_name(n) for n in need], tuple(column_name(n) for n in extra), place)
        return f.withColumnsRenamed({column_name(n): c for n, c in extra.items()})

    def activity(self) -> DataFrame:
        """FIT record fields of every fix, with altitude and speed of the same position, and heart rate, where the session
        has them."""
        info = self.data.load_info()
        return fit.activity_records(self.fixes({n: c for n, c in (("GPS_Altitude", "alt"), ("GPS_SpeedKmh", "speed")) if n in info}), self.heart_rate())

    def timed_fixes(self) -> DataFrame:
        """``fixes`` with t, the recording's seconds: a fix's own position over the GPS rate, as several fixes may have one
        epoch; without a rate, by ``session_time``."""
        rate = self.data.load_info()["GPS_EpochMs"].rate
        return self.fixes(place="__p").withColumn("t", F.col("__p") / rate).drop("__p") if rate > 0 else self.session_time(self.fixes())

    def session_time(self, points: DataFrame, epoch: str = "timestamp_ms") -> DataFrame:
        """``points`` with t, the recording's seconds at an epoch: between the GPS channel's samples, or from the session's
        start where that channel has no rate."""
        info = self.data.load_info()["GPS_EpochMs"]
        if info.rate > 0:
            return joins.epoch_to_time(points, self.data.frame("GPS_EpochMs"), info.rate, epoch)
        start = self.data.sessions.select("session_id", F.coalesce("timestamp_utc_ms", F.lit(0)).alias("__s"))
        return points.join(start, "session_id").withColumn("t", (F.col(epoch) - F.col("__s")) / 1000.0).drop("__s")

    def heart_rate(self) -> DataFrame | None:
        """(session_id, t: wall-clock ms, value) of the beats: the session's start plus each beat's time; beats without a
        time are one a second."""
        info = self.data.load_info().get("HR_BPM")
        if info is None or self.data.sessions is None:
            return None
        start = self.data.sessions.select("session_id", F.coalesce("timestamp_utc_ms", F.lit(0)).alias("__s"))
        beats = self.data.samples.where("channel_id = 'HR_BPM'").join(start, "session_id")
        return beats.select("session_id", (F.col("__s") + F.round(F.col("t") * 1000)).cast("double").alias("t"), "value")

    def write_fit(self, path: str, sport: int = 0) -> None:
        """One FIT file's bytes for each session, as Parquet (session_id, content)."""
        fit.fit_files(self.activity(), sport).write.parquet(path)

    def at_fixes(self, name: str) -> DataFrame:
        """A channel's value at every fix (session_id, idx, value): the nearest sample in time."""
        samples, rate = self._channel(name)
        points = self.timed_fixes().select("session_id", "idx", "t")
        s = samples.select("session_id", "idx", "t", "value")
        if rate > 0:
            return joins.nearest_fixed(points, s, rate).select("session_id", "idx", "value")
        return joins.nearest_event(points, s).select("session_id", "idx", "value")

    def resident_bytes(self) -> DataFrame:
        """(session_id, bytes) that the raw columns hold; made channels hold none."""
        width = F.coalesce(*[F.when(F.col("data_type") == k, w) for k, (_, w) in TYPE_CODES.items()], F.lit(8))
        return self.data.channels.groupBy("session_id").agg(F.sum(F.when(F.col("synthesized"), 0).otherwise(F.col("len") * width)).alias("bytes"))

    # ---- laps and tracks ----
    def laps(self, track_text: str, window_ms: tuple[int, int] | None = None) -> DataFrame:
        artifact = config.read_track(track_text)
        if artifact.layout is None:
            raise InputError("parse", "the track has no lap timing")
        return laps.detect_laps(self.fixes(), artifact.layout, window_ms)

    def visits(self, track_texts: list[str], **limits) -> DataFrame:
        found = [config.read_track(t) for t in track_texts]
        return tracks.visits(self.fixes(), {t.id: t.polyline for t in found}, **limits)

    # ---- spectra ----
    def _channel(self, name: str) -> tuple[DataFrame, float]:
        info = self.data.load_info()
        if name not in info:
            raise InputError("unknown_channel", f"unknown channel {name!r}; there are: {', '.join(sorted(info))}")
        return self.data.frame(name), info[name].rate

    def welch(self, name: str, window_s: tuple[float, float] | None = None, **options) -> DataFrame:
        samples, rate = self._channel(name)
        return series.welch(series.slice_by_time(samples, *window_s, rate) if window_s else samples, rate, **options)

    def spectrogram(self, name: str, window_s: tuple[float, float] | None = None, **options) -> DataFrame:
        samples, rate = self._channel(name)
        cut = series.slice_by_time(samples, *window_s, rate) if window_s else samples
        return series.spectrogram(cut, rate, t0=window_s[0] if window_s else 0.0, **options)

    # ---- tables ----
    def table_eval(self, workbook_text: str, block_id: str, lap_windows: list[tuple[float, float]] | None = None, baseline_row: int | None = None):
        """(cells, warnings) of a table; rows that name a lap need the laps' windows."""
        table = config.read_workbook(workbook_text).table(block_id).table
        table.baseline_row = baseline_row
        warnings = tables.lap_windows(table, lap_windows or [])
        known = {r[0] for r in self.data.samples.select("session_id").distinct().limit(2).collect()}
        if len(known) == 1:  # a single session is evaluated whatever session its rows name
            for row in table.rows:
                row.session_id = None
        return tables.evaluate_table(self.data, table), warnings

    def table_list(self, workbook_text: str) -> list[dict]:
        return [{"block_id": t.block_id, "worksheet": t.worksheet, "columns": [c[1] for c in t.table.columns], "rows": len(t.table.rows)} for t in config.read_workbook(workbook_text).tables]

    def table_check(self, workbook_text: str, block_id: str, lap_windows: list[tuple[float, float]] | None = None) -> list[tuple[str, int, int]]:
        """Problems of a table; with lap windows its cells are evaluated too, and those that fail are eval_error."""
        table = config.read_workbook(workbook_text).table(block_id).table
        out = tables.validate(table, set(self.data.load_info()) | set(self.data.derived))
        if lap_windows is not None:
            tables.lap_windows(table, lap_windows)
            known = {(r, c) for _, r, c in out}
            cells = tables.evaluate_table(self.data, table)
            out += [("eval_error", r, c) for r, row in enumerate(cells) for c, (_, e) in enumerate(row) if e and (r, c) not in known]
        return out

    # ---- suspension ----
    def estimate_suspension(self, settings: estimate.Config | None = None) -> list[str]:
        """Store travel and velocity channels; returns their names."""
        made = suspension.suspension(self.data, config=settings)
        rate = next(i.rate for n, i in self.data.load_info().items() if n.startswith("IMU0_"))
        if not hasattr(self.data, "derived_info"):
            self.data.derived_info = {}
        for name in suspension.OUTPUTS:
            self.data.store(name, made.where(F.col("channel_id") == name).select("session_id", "idx", "value"))
            self.data.derived_info[name] = (rate, ("suspension", "IMU0"))
        return list(suspension.OUTPUTS)

    # ---- video ----
    def video_probe(self, data: bytes) -> video.Info:
        return video.read_info(data)

    def video_sync(self, data: bytes, session_start_ms: float, session_s: float) -> tuple[float, str, float]:
        info = video.read_info(data)
        track = next((t for t in info.tracks if t.codec == "gpmd"), None)
        anchor = video.telemetry(video.telemetry_samples(data, track))[1] if track else None
        return overlay.sync(anchor, info.creation_ms, info.duration_s, session_start_ms, session_s)

    def overlay_frames(self, session_id: str, layout: config.OverlayLayout, fps: float, duration_s: float, offset: float = 0.0) -> DataFrame:
        """A row per frame with a column for each gauge and attitude channel; channels that are not there are NULL."""
        frames = overlay.frame_clock(self.spark, session_id, fps, duration_s, 0.0, offset)
        info = self.data.load_info()
        out = frames
        for name in layout.channels():
            if name in info:
                value = overlay.gauge(frames, self.data.frame(name).where(F.col("session_id") == session_id), info[name].rate, column_name(name))
                out = out.join(value.select("frame", column_name(name)), "frame")
            else:
                out = out.withColumn(column_name(name), F.lit(None).cast("double"))
        return out

    def overlay_scene(self, frames: DataFrame, session_id: str, layout: config.OverlayLayout) -> tuple[DataFrame, dict[tuple, str], list[tuple[float, float]]]:
        """(frames with a column of points for each strip's channel and, where a map is drawn, the position x and y; these
        columns by (channel, window); the map's line)."""
        info = self.data.load_info()
        kinds = {e["type"] for e in layout.elements}
        traces: dict[tuple, str] = {}
        out = frames
        for e in layout.elements:
            for name in e["channels"] if e["type"] == "trace_strip" else ():
                key = (name, float(e.get("window_s", 10.0)))
                if name in info and key not in traces:
                    column = traces[key] = f"trace_{len(traces)}"
                    points = overlay.trace(frames, self.data.frame(name).where(F.col("session_id") == session_id), info[name].rate, key[1])
                    strip = points.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias(column))  # at most TRACE_POINTS
                    out = out.join(strip, "frame", "left")
        line = []
        if "track_map" in kinds and {"GPS_Latitude", "GPS_Longitude", "GPS_EpochMs"} <= set(info):
            fixes = self.timed_fixes().where(F.col("session_id") == session_id)
            norm = overlay.normalised_map(fixes.select("session_id", "idx", "t", "lat", "lon"))
            out = out.join(overlay.map_position(frames, norm).select("frame", "x", "y"), "frame")
            line = [(r.x, r.y) for r in overlay.map_line(norm).orderBy("idx").collect()]  # at most MAP_POINTS
        return out, traces, line

    # ---- recovery ----
    def recover(self, path: str, sector: int = 512) -> DataFrame:
        return log.scan_images(self.spark, path, sector)


def run_command(command: str, action, warnings: tuple[dict, ...] = ()) -> dict:
    """The JSON envelope of an action: its value, or its error folded into a kind."""
    try:
        return envelope(command, action(), warnings=warnings)
    except Exception as e:  # every failure has a place in the envelope
        return envelope(command, error=e, warnings=warnings)
