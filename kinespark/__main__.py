"""Commands over recordings; every one prints a JSON envelope.

    python -m kinespark info LOG            channels LOG           export LOG -o OUT [--channel C]...
    python -m kinespark math LOG --workbook W [-o OUT]             laps LOG --track T
    python -m kinespark visits LOG --track T...                    fft|spectrogram LOG --channel C ...
    python -m kinespark fit LOG -o OUT      table eval|list|check  video probe|sync
    python -m kinespark overlay LOG --video V --workbook W         recover IMAGE -o OUT   scan IMAGE
"""

from __future__ import annotations

import argparse
import json
import math
import sys


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinespark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, parent=sub):
        out = parent.add_parser(name)
        for f in files:
            out.add_argument(f)
        return out

    command("info", "file")
    command("channels", "file")
    for name in ("export", "math"):
        c = command(name, "file")
        c.add_argument("-o", "--output")
        c.add_argument("--format", choices=("csv", "json"))
        c.add_argument("--channel", action="append")
        if name == "math":
            c.add_argument("--workbook", required=True)
            c.add_argument("--include-base", action="store_true")
    command("laps", "file").add_argument("--track", required=True)
    command("visits", "file").add_argument("--track", action="append", required=True)
    for name in ("fft", "spectrogram"):
        c = command(name, "file")
        c.add_argument("--channel", required=True)
        c.add_argument("--from", dest="start", type=float)
        c.add_argument("--to", dest="end", type=float)
        c.add_argument("--window", default="hann", choices=("hann", "hamming", "rect"))
        c.add_argument("--nperseg", type=int, default=0)
        c.add_argument("--noverlap", type=int, default=0)
        c.add_argument("--detrend", default="mean", choices=("none", "mean", "linear"))
        c.add_argument("--scaling", default="magnitude" if name == "fft" else "density", choices=("magnitude", "density"))
        if name == "fft":
            c.add_argument("--averaging", default="mean", choices=("mean", "median"))
    c = command("fit", "file")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--sport", type=int, default=2)
    c.add_argument("--track")
    t = sub.add_parser("table").add_subparsers(dest="action", required=True)
    for name in ("eval", "list", "check"):
        c = command(name, parent=t)
        c.add_argument("--workbook", required=True)
        if name != "list":
            c.add_argument("--table", required=True)
            c.add_argument("--session", required=name == "eval")
            c.add_argument("--track")
            c.add_argument("--main", type=int)
    v = sub.add_parser("video").add_subparsers(dest="action", required=True)
    command("probe", "video", parent=v)
    command("sync", "file", "video", parent=v)
    c = command("overlay", "file")
    c.add_argument("--video", required=True)
    c.add_argument("--workbook", required=True)
    c.add_argument("--layout")
    c.add_argument("--track")
    c.add_argument("--offset", type=float)
    c.add_argument("--start", type=float, default=0.0)
    c.add_argument("--duration", type=float)
    c.add_argument("-o", "--output")
    c.add_argument("--ffmpeg", default="ffmpeg")
    c = command("recover", "device")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--session-id")
    c = command("scan", "device")
    c.add_argument("-o", "--out-dir")
    return p


def _text(path: str) -> str:
    with open(path) as f:
        return f.read()


def _bytes(path: str):
    """The file's bytes, mapped: of a device or a video of any size, only what is looked at is read."""
    import mmap
    import os

    from .errors import InputError

    with open(path, "rb") as f:
        if f.seek(0, os.SEEK_END) == 0:
            raise InputError("truncated", "the file is empty")
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(spark, a: argparse.Namespace):
    """The data of a command's envelope."""
    from .api import Engine
    from .operators import overlay
    from .sources import config, export, log, video

    if a.command == "table" and a.action == "list":
        return [{"block_id": t.block_id, "worksheet": t.worksheet, "columns": [c[1] for c in t.table.columns], "rows": len(t.table.rows)} for t in config.read_workbook(_text(a.workbook)).tables]
    if a.command == "video" and a.action == "probe":
        i = video.read_info(_bytes(a.video))
        return {"width": i.width, "height": i.height, "fps": i.fps, "duration_s": i.duration_s, "creation_ms": i.creation_ms, "has_telemetry": i.has_telemetry}
    if a.command in ("recover", "scan"):
        data = _bytes(a.device)
        found = log.find_recordings(data, 1 if a.command == "recover" else 512, getattr(a, "session_id", None))
        if a.command == "recover":
            if not found:
                raise config.InputError("parse", "no recording found")
            found = found[:1]
            with open(a.output, "wb") as f:
                f.write(log.extract(data, found[0]))
        elif a.out_dir:
            for k, r in enumerate(found):
                with open(f"{a.out_dir}/{k:03d}-{r.session_id}.log", "wb") as f:
                    f.write(log.extract(data, r))
        return [{"offset": r.offset, "size": r.size, "records": r.records, "session_id": r.session_id, "clean_end": r.clean_end} for r in found]
    if a.command == "table" and a.action == "check" and not a.session:
        from .operators.tables import validate

        return [{"problem": k, "row": r, "column": c} for k, r, c in validate(config.read_workbook(_text(a.workbook)).table(a.table).table)]

    engine = Engine.open(spark, a.session if a.command == "table" else a.file)
    if a.command == "info":
        return _rows(engine.sessions())
    if a.command == "channels":
        return _rows(engine.channels().orderBy("session_id", "ord"))
    if a.command in ("export", "math"):
        failed = engine.apply_workbook(_text(a.workbook)) if a.command == "math" else []
        names = a.channel
        if a.command == "math" and names is None:
            names = [*(export.select_channels(engine.data, None) if a.include_base else []), *engine.data.derived]
        if a.output:
            engine.export(a.output, names, a.format)
            data: object = {"path": a.output}
        else:
            data = _rows(export.export_rows(engine.data, names))
        return {"output": data, "errors": [{"channel": n, "kind": e.kind, "message": str(e)} for n, e in failed]}
    if a.command == "laps":
        return _rows(engine.laps(_text(a.track)).orderBy("session_id", "lap"))
    if a.command == "visits":
        return _rows(engine.visits([_text(t) for t in a.track]).orderBy("session_id", "start_ms"))
    if a.command in ("fft", "spectrogram"):
        window = None if a.start is None and a.end is None else (a.start or 0.0, a.end if a.end is not None else 1e12)
        options = {"window": a.window, "nperseg": a.nperseg, "noverlap": a.noverlap, "trend": a.detrend, "scaling": a.scaling}
        if a.command == "fft":
            return _rows(engine.welch(a.channel, window, average=a.averaging, **options).orderBy("session_id", "bin"))
        return _rows(engine.spectrogram(a.channel, window, **options).orderBy("session_id", "frame", "bin"))
    if a.command == "fit":
        from .sources import fit

        found = fit.fit_files(engine.activity(), a.sport).collect()
        for r in found:
            with open(a.output if len(found) == 1 else f"{a.output}.{r.session_id}", "wb") as f:
                f.write(r.content)
        return {"files": len(found)}
    windows = [(r.start_s, r.end_s) for r in engine.laps(_text(a.track)).orderBy("lap").collect()] if getattr(a, "track", None) else []
    if a.command == "table":
        if a.action == "check":
            return [{"problem": k, "row": r, "column": c} for k, r, c in engine.table_check(_text(a.workbook), a.table, windows)]
        cells, warnings = engine.table_eval(_text(a.workbook), a.table, windows, a.main)
        own = engine.sessions().first().session_id
        rows = config.read_workbook(_text(a.workbook)).table(a.table).table.rows
        warnings += [f"session_mismatch: row {r.id} binds session {r.session_id} but {own} is evaluated" for r in rows if r.session_id and r.session_id != own]
        return {"cells": [[{"value": v, "error": e} for v, e in row] for row in cells], "warnings": warnings}
    session = engine.sessions().first()
    data = _bytes(a.video)
    info = video.read_info(data)
    start_ms, length = float(session.timestamp_utc_ms or 0), session.duration_ms / 1000.0
    if a.command == "video":
        offset, method, sure = engine.video_sync(data, start_ms, length)
        return {"offset_s": offset, "method": method, "confidence": sure}
    offset = a.offset if a.offset is not None else engine.video_sync(data, start_ms, length)[0]
    layout = config.read_workbook(_text(a.workbook)).layout(a.layout)
    clip = video.clip_range(a.start, None if a.duration is None else a.start + a.duration, info.duration_s)
    frames = engine.overlay_frames(session.session_id, layout, info.fps, clip[1] - clip[0], offset + clip[0])
    if windows:
        laps = [(k + 1, s, e, int(round((e - s) * 1000))) for k, (s, e) in enumerate(windows)]
        frames = overlay.lap_panel(frames, laps)
    from .model import column_name

    frames, traces, line = engine.overlay_scene(frames, session.session_id, layout)
    pictures = overlay.rendered(frames, layout, {c: column_name(c) for c in layout.channels()}, layout.size(), traces, line).orderBy("frame")
    if not a.output:
        return {"frames": pictures.count(), "size": layout.size(), "offset_s": offset}
    probe = {"width": info.width, "height": info.height, "fps": info.fps, "rotation": 0, "has_audio": any(t.handler == "soun" for t in info.tracks)}
    args = video.encode_arguments(a.video, a.output, probe, clip, layout.size())
    return {"frames": video.export_video((bytes(r.pixels) for r in pictures.toLocalIterator(prefetchPartitions=True)), a.output, args, a.ffmpeg)}


def clean(x):
    """JSON has no NaN or infinity: they become null."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: clean(v) for k, v in x.items()}
    return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x


def main(argv: list[str] | None = None, spark=None) -> int:
    from .api import run_command

    a = arguments().parse_args(argv)
    own = spark is None
    if own:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("kinespark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out = run_command(a.command, lambda: run(spark, a))
    print(json.dumps(clean(out), default=str))
    if own:
        spark.stop()
    return 0 if out["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
