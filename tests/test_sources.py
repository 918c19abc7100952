import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from fixtures import gps, imu, make_gpmf, make_log, make_mp4, samples, value
from pyspark.sql import functions as F

from kinespark.api import Engine, run_command
from kinespark.errors import EvalError, InputError, envelope
from kinespark.model import SessionSet
from kinespark.sources import config, export, fit, log, video

REGISTRY = [(1, 4, 10, 0.5, 1.0, "Fork", "mm"), (2, 6, 0, 1.0, 0.0, "HeartRate", "bpm"), (3, 1, 10, 2.0, 0.0, "IMU0_AccelX", "g"), (4, 7, 10, 1.0, 0.0, "Raw", "")]


def example():
    recs = [imu(0, 1000, [10, 0, 0, 0, 0, 0]), imu(0, 2250, [20, 0, 0, 0, 0, 0]), imu(0, 6000, [50, 1, 2, 3, 4, 5]), imu(0, 5000, [9] * 6)]
    recs += [gps(0, 1500, 0, 0), gps(1_700_000_000_000, 201_000, 450000000, 60000000, 3600), gps(1_700_000_000_200, 401_000, 450001000, 60000000, 3600)]
    recs += [value(1, 3000, "h", 7), value(1, 4000, "h", -7), value(2, 500_000, "f", 61.0), value(9, 1, "h", 1), (7, b"xx"), value(4, 3000, "d", -0.0)]
    return recs


def test_header_errors():
    for data, kind in ((b"nope", "invalid_magic"), (make_log([], version=2), "unsupported_version"), (make_log([])[:30], "truncated"), (make_log([], REGISTRY)[:100], "truncated")):
        with pytest.raises(InputError) as e:
            log.read_header(data)
        assert e.value.kind == kind


def test_log_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(make_log(example(), REGISTRY, start_ms=0))
    (tmp_path / "b.log").write_bytes(make_log(example(), REGISTRY, start_ms=77, session=bytes(16), end=False)[:-5])
    e = Engine.open(spark, str(tmp_path))
    s = {r.session_id: r for r in e.sessions().collect()}
    assert len(s) == 2
    a, b = (s[bytes(range(16)).hex()], s["00" * 16])
    assert a.timestamp_utc_ms == 1_700_000_000_000 - 201 and b.timestamp_utc_ms == 77  # the first record is at 1 us
    assert a.truncation_warning is None and "ends" in b.truncation_warning
    got = lambda ch: [r.value for r in e.data.samples.where(f"channel_id = '{ch}' and session_id = '{a.session_id}'").orderBy("idx").collect()]
    assert got("Fork") == [4.5, -2.5] and got("HR_BPM") == [61.0] and got("GPS_SpeedKmh") == [0.0, 36.0, 36.0]
    assert got("IMU0_AccelX") == [20.0, 40.0, 60.0, 80.0, 100.0] and got("IMU0_AccelY") == [0.0, 0.0, 0.0, 1.0, 1.0]
    assert str(got("Raw")[0]) == "-0.0"
    ch = {r.channel_id: r for r in e.channels().where(f"session_id = '{a.session_id}'").collect()}
    assert ch["HR_BPM"].is_event_driven and ch["IMU0_AccelX"].rate_hz == 800.0 and ch["Time"].synthesized and ch["Distance"].len == ch["Time"].len
    assert e.data.gaps.where("channel_id = 'IMU0_AccelX'").first().len == 2


def test_recovery(spark, tmp_path):
    one, two = make_log(example(), REGISTRY), make_log(example(), [], session=bytes(16), end=False)
    image = b"\0" * 512 + one + b"\x07" * 31 + b"\0" * (-(512 + len(one) + 31) % 512) + two + b"\xee\xee\xee\xee"
    found = log.find_recordings(image, 512)
    assert [(r.clean_end, r.size, r.records >= 10) for r in found][0] == (True, len(one), False) or found[0].size <= len(one)
    assert len(found) == 2 and image[found[1].offset :][:5] == b"IDL0\x03"
    assert [r.session_id for r in log.find_recordings(image, 512, "00" * 16)] == ["00" * 16]
    (tmp_path / "card.img").write_bytes(image)
    assert log.scan_images(spark, str(tmp_path)).count() == 2


def test_exports(spark, tmp_path):
    data = SessionSet.from_samples(samples(spark, {"b": [1, 2], "a,x": [3.5]}), 10.0)
    assert [tuple(r) for r in export.export_rows(data, ["b", "a,x"]).collect()] == [("b", 0.0, 1.0), ("b", 0.1, 2.0), ("a,x", 0.0, 3.5)]
    export.write_csv(data, f"{tmp_path}/csv", ["a,x"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().channel == "a,x"
    doc = json.loads(export.export_json(data, ["a,x", "b"]).first().json)
    assert [c["channel_id"] for c in doc["channels"]] == ["a,x", "b"] and doc["channels"][1]["samples"] == [1, 2]
    with pytest.raises(InputError):
        export.select_channels(data, ["zz"])
    assert export.infer_format("x.JSON") == "json" and export.infer_format(None) == "csv"
    with pytest.raises(ValueError):
        export.infer_format("x.bin")


def test_values_at_fixes_of_one_epoch(spark):
    """A fix is at its own position in the recording, also where epochs repeat or step back."""
    epochs = [1000, 1000, 1200, 900, 1000, 1400]
    lat = [1.0, 1.0, 0.0, 1.0, 1.0, 1.0]
    data = SessionSet.from_samples(samples(spark, {"GPS_Latitude": lat, "GPS_Longitude": lat, "GPS_EpochMs": epochs, "Fork": list(range(12))}), {"GPS_Latitude": 5.0, "GPS_Longitude": 5.0, "GPS_EpochMs": 5.0, "Fork": 10.0})
    e = Engine(spark, data)
    assert [(r.idx, r.value) for r in e.at_fixes("Fork").orderBy("idx").collect()] == [(0, 0), (1, 2), (2, 6), (3, 8), (4, 10)]
    assert e.fixes().columns == ["session_id", "timestamp_ms", "lat", "lon", "idx"]


def test_mean_speed_is_summed_in_the_order_of_fixes(spark):
    rows = [("s", i, i * 1000, float(v)) for i, v in ((0, 1e16), (2, -1e16), (1, 1))]
    f = spark.createDataFrame(rows, "session_id string, idx long, timestamp_ms long, mps double").coalesce(1)
    roll = fit.session_rollup(f.withColumn("distance_m", F.lit(0.0)).withColumn("hr", F.lit(None).cast("long"))).first()
    assert roll.avg_speed == 0 and roll.fixes == 3  # (1e16 + 1) - 1e16; 1/3 in another order
    none = fit.session_rollup(f.withColumn("mps", F.lit(None).cast("double")).withColumn("distance_m", F.lit(0.0)).withColumn("hr", F.lit(None).cast("long"))).first()
    assert none.avg_speed is None


def test_fit(spark):
    rows = [("s", i, 1_700_000_000_000 + i * 1000, 450000000.0 + i * 1000, 60000000.0, 1000.0, 36.0) for i in range(3)]
    f = spark.createDataFrame(rows, "session_id string, idx long, timestamp_ms long, lat double, lon double, alt double, speed double")
    hr = spark.createDataFrame([("s", 1_700_000_000_500.0, 100.4), ("s", 1_700_000_001_900.0, 300.0)], "session_id string, t double, value double")
    recs = fit.activity_records(f, hr).orderBy("idx").collect()
    assert [r.hr for r in recs] == [None, 100, 254] and recs[0].speed == 10000 and recs[0].altitude == 3000
    assert recs[0].ts == 1_700_000_000 - fit.EPOCH_OFFSET_S and recs[0].lat == round(45 * 2**31 / 180)
    roll = fit.session_rollup(fit.activity_records(f, hr)).first()
    assert (roll.elapsed_s, roll.avg_hr, roll.max_hr, roll.fixes) == (2.0, 177, 254, 3)
    data = bytes(fit.fit_files(fit.activity_records(f, hr)).first().content)
    size = struct.unpack_from("<I", data, 4)[0]
    assert data[8:12] == b".FIT" and len(data) == 14 + size + 2 and fit.crc16(data) == 0 and fit.crc16(data[:14]) == 0
    at, kinds, seen = 14, {}, []
    while at < 14 + size:  # an independent reader
        head = data[at]
        if head & 0x40:
            number, n = struct.unpack_from("<HB", data, at + 3)
            kinds[head & 15] = (number, sum(data[at + 6 + 3 * i + 1] for i in range(n)))
            at += 6 + 3 * n
        else:
            seen.append(kinds[head][0])
            at += 1 + kinds[head][1]
    assert seen == [0, 23, 20, 20, 20, 19, 18, 34]
    with pytest.raises(InputError):
        fit.encode([])


def test_video():
    payloads = [make_gpmf([(450000000, 60000000, 0, 5000, 0), (450000100, 60000000, 0, 5000, 0)]), make_gpmf([(450000200, 60000000, 0, 5000, 0)])]
    data = make_mp4(payloads)
    info = video.read_info(data)
    assert (info.width, info.height, info.fps, info.duration_s, info.has_telemetry) == (640, 360, 30.0, 2.0, True)
    assert info.creation_ms == (3_000_000_000 - video.EPOCH_1904) * 1000
    meta = next(t for t in info.tracks if t.codec == "gpmd")
    found = video.telemetry_samples(data, meta)
    assert [p for _, p in found] == payloads and [t for t, _ in found] == [0.0, 1.0]
    fixes, anchor = video.telemetry(found)
    assert [f[0] for f in fixes] == [0.0, 0.5, 1.0] and fixes[0][1:] == (45.0, 6.0, 5.0)
    assert anchor == (0.0, 1_704_164_645_500)
    assert video.telemetry([(3.0, payloads[0])])[0][1][0] == 3.5
    with pytest.raises(InputError):
        video.read_info(b"\0\0\0\x08free")
    assert video.gps_time(b"bad") is None


def test_video_reader_and_arguments(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(make_mp4([make_gpmf([(450000000, 60000000, 0, 5000, 0)])]))
    assert video.read_telemetry(spark, str(tmp_path)).count() == 1
    probe = video.parse_probe(json.dumps({"streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "side_data_list": [{"rotation": -90}]}, {"codec_type": "audio"}], "format": {"duration": "2.5"}}))
    assert probe["rotation"] == 270 and abs(probe["fps"] - 29.97) < 0.001 and probe["has_audio"]
    args = video.encode_arguments("in.mp4", "out.mp4", probe, video.clip_range(-1, 9, 2.5), (8, 6))
    assert "[1:v]scale=2:4[o];[0:v][o]overlay=0:0" in args and args[-1] == "out.mp4.part"
    assert video.frame_count(29.97, 1.0) == 30


WORKBOOK = {
    "workbook_id": "w", "name": "n", "workbook_version": 2, "other": 1, "math_channels": [{"name": "twice", "expression": "[Fork] * 2"}, {"name": "bad", "expression": "[zz]"}],
    "worksheets": [{"name": "s", "blocks": [{"id": "b1", "placement": "main", "content": {"kind": "table", "table": {"columns": [{"id": "c", "name": "Top", "template": "max([Fork])"}], "rows": [{"id": "r", "context": {"sessionId": "s0", "lapIndex": 0}}], "cells": [[{}]]}}}, {"id": "x", "content": {"kind": "chart"}}]}],
    "overlay_layouts": [{"id": "o", "name": "lay", "canvas": "800 x600", "elements": [{"type": "gauge", "rect": [0, 0, 1, 1], "channel": "Fork"}, {"type": "trace_strip", "rect": [0, 0, 1, 1], "channels": ["Fork", "HR"]}, {"type": "lap_panel", "rect": [0, 0, 0.5, 0.5]}]}],
}


def test_documents():
    w = config.read_workbook(json.dumps(WORKBOOK))
    assert w.math_channels[0] == ("twice", "[Fork] * 2") and len(w.tables) == 1 and w.layout("lay").size() == (800, 600) and w.layout().channels() == ["Fork", "HR"]
    for text, kind in (("{", "parse"), (json.dumps(WORKBOOK | {"workbook_version": 3}), "unsupported_version"), ("{}", "parse")):
        with pytest.raises(InputError) as e:
            config.read_workbook(text)
        assert e.value.kind == kind
    gate = {"lat1_deg": 1e7, "lon1_deg": 2e7, "lat2_deg": 3e7, "lon2_deg": 4e7}
    track = {"track_artifact_version": 1, "track": {"track_id": "t", "lap_timing": {"kind": "circuit", "start_finish": gate}, "sector_gates": [{"name": "a", "gate": gate}], "neutral_zones": [{"enter": gate, "exit": gate}], "reference_polyline": [{"latitude_deg": 45.0, "longitude_deg": 6e7}]}}
    t = config.read_track(json.dumps(track))
    assert t.layout.timing.start.lat2 == 3e7 and t.layout.sectors[0][0] == "a" and t.warnings
    with pytest.raises(InputError):
        config.read_track(json.dumps({"track": {}}))


def test_engine(spark, tmp_path):
    s = samples(spark, {"Fork": range(20)})
    e = Engine.from_samples(spark, s, 10.0)
    text = json.dumps(WORKBOOK)
    assert [n for n, _ in e.apply_workbook(text)] == ["bad"]
    assert e.evaluate("[twice] + 1").count() == 20
    cells, warnings = e.table_eval(text, "b1", [(0.0, 0.5)])
    assert cells == [[(5.0, None)]] and not warnings
    assert e.table_eval(text, "b1", [])[1] and e.table_list(text)[0]["rows"] == 1 and e.table_check(text, "b1") == []
    assert e.sessions().first().duration_ms == 2000
    assert e.welch("Fork", (0.0, 1.0), nperseg=8, noverlap=4).count() == 5 and e.spectrogram("Fork", nperseg=8, noverlap=0).count() == 10
    frames = e.overlay_frames("s0", config.read_workbook(text).layout(), 10, 0.3).orderBy("frame").collect()
    assert [r.ch_Fork for r in frames] == [0, 1, 2] and frames[0].ch_HR is None
    e.export(f"{tmp_path}/out.json")
    assert run_command("fft", lambda: e.welch("nope"))["error"]["kind"] == "not_found"
    assert run_command("info", lambda: 1) == {"schema": 1, "ok": True, "command": "info", "engine": "kinespark", "data": 1, "warnings": []}


def test_envelopes():
    assert envelope("x", error=EvalError("no_lap_context", "m"))["error"] == {"kind": "unsupported", "message": "m", "details": {"eval_kind": "no_lap_context"}}
    for error, kind in ((InputError("truncated", "m"), "invalid_input"), (OSError(), "io"), (ValueError(), "usage"), (RuntimeError(), "internal"), (EvalError("type", "m"), "eval")):
        assert envelope("x", error=error)["error"]["kind"] == kind
    assert np.isfinite(1.0)


def test_video_export(tmp_path):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nfor last; do :; done\ncat > \"$last\"\n")
    tool.chmod(0o755)
    target = str(tmp_path / "out.mp4")
    assert video.export_video((b"abcd" for _ in range(40)), target, ["-x", f"{target}.part"], str(tool)) == 40
    assert (tmp_path / "out.mp4").read_bytes() == b"abcd" * 40
    bad = tmp_path / "bad"
    bad.write_text("#!/bin/sh\necho broken >&2\nexit 3\n")
    bad.chmod(0o755)
    with pytest.raises(InputError, match="broken|closed"):
        video.export_video([b"x"] * 3, str(tmp_path / "no.mp4"), [f"{tmp_path}/no.mp4.part"], str(bad))
    with pytest.raises(InputError, match="cancelled"):
        video.export_video([b"x"] * 3, str(tmp_path / "no.mp4"), [f"{tmp_path}/no.mp4.part"], str(tool), cancelled=lambda: True)
    with pytest.raises(InputError, match="no ffmpeg"):
        video.export_video([], target, [], str(tmp_path / "nothing"))
    assert not (tmp_path / "no.mp4").exists() and not (tmp_path / "no.mp4.part").exists()


def test_recovered_bytes_are_a_log():
    image = b"\0" * 512 + make_log(example(), REGISTRY, end=False) + b"\0" * 64
    region = log.find_recordings(image, 512)[0]
    again = log.extract(image, region)
    assert log.walk(again, 0).clean_end and log.read_header(again).session_id == region.session_id


def test_commands(spark, tmp_path, capsys):
    from kinespark.__main__ import main

    recs = [gps(1_700_000_000_000 + i * 1000, 1_000_000 * i, 450000000 + 1000 * (i if i < 10 else 20 - i), 60000000, 3600) for i in range(20)]
    recs += [value(1, 100_000 * i, "h", i) for i in range(50)]
    (tmp_path / "a.log").write_bytes(make_log(recs, REGISTRY, start_ms=1_700_000_000_000, gps_rate=1))
    (tmp_path / "w.json").write_text(json.dumps(WORKBOOK))
    gate = {"lat1_deg": 450004500.0, "lon1_deg": 59999000.0, "lat2_deg": 450004500.0, "lon2_deg": 60001000.0}
    line = [{"latitude_deg": 450000000.0 + 1000 * k, "longitude_deg": 60000000.0} for k in (0, 10)]
    (tmp_path / "t.json").write_text(json.dumps({"track_artifact_version": 1, "track": {"track_id": "t", "lap_timing": {"kind": "circuit", "start_finish": gate}, "reference_polyline": line}}))
    (tmp_path / "v.mp4").write_bytes(make_mp4([make_gpmf([(450000000, 60000000, 0, 5000, 0)], b"231114221320.000")], created=0))
    (tmp_path / "card").write_bytes(b"\0" * 512 + (tmp_path / "a.log").read_bytes())
    log_, w, t = (str(tmp_path / n) for n in ("a.log", "w.json", "t.json"))

    def call(*args):
        code = main(list(args), spark)
        out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert out["ok"] == (code == 0)
        return out["data"] if out["ok"] else out["error"]

    assert call("info", log_)[0]["device_id"] == "010203040506"
    assert "Distance" in {c["channel_id"] for c in call("channels", log_)}
    assert len(call("export", log_, "--channel", "Fork")["output"]) == 50
    assert call("math", log_, "--workbook", w)["errors"][0]["channel"] == "bad"
    assert [x["lap"] for x in call("laps", log_, "--track", t)] == [1, 2]
    assert call("visits", log_, "--track", t) == []
    assert len(call("fft", log_, "--channel", "Fork", "--nperseg", "16", "--noverlap", "8")) == 9
    assert len(call("spectrogram", log_, "--channel", "Fork", "--nperseg", "16", "--to", "2")) == 9
    assert call("fft", log_, "--channel", "zz")["kind"] == "not_found"
    assert call("fit", log_, "-o", str(tmp_path / "a.fit")) == {"files": 1} and (tmp_path / "a.fit").read_bytes()[8:12] == b".FIT"
    assert call("table", "list", "--workbook", w)[0]["block_id"] == "b1"
    assert call("table", "check", "--workbook", w, "--table", "b1") == []
    assert call("table", "eval", "--workbook", w, "--table", "b1", "--session", log_, "--track", t)["cells"][0][0]["value"] is not None  # one session is evaluated whatever its rows name
    assert call("video", "probe", str(tmp_path / "v.mp4"))["fps"] == 30.0
    assert call("video", "sync", log_, str(tmp_path / "v.mp4"))["method"] == "gpmf"
    assert call("overlay", log_, "--video", str(tmp_path / "v.mp4"), "--workbook", w, "--track", t)["frames"] == 60
    assert len(call("scan", str(tmp_path / "card"), "-o", str(tmp_path))) == 1
    assert call("recover", str(tmp_path / "card"), "-o", str(tmp_path / "r.log"))[0]["clean_end"]
    assert call("info", str(tmp_path / "none"))["kind"] in ("internal", "io")
    e = Engine.open(spark, log_)
    assert e.at_fixes("Fork").count() == 20 and e.resident_bytes().first().bytes > 0


def test_inertial_records_as_arrays():
    """Runs of records read as arrays give what the record by record decoder gives, whatever their number of axes."""
    records = [imu(i % 3, 1000 * i, list(range(-i, -i + (6, 4, 1, 0)[i % 4]))) for i in range(60)] + [value(1, 5, "h", 7), imu(1, 99_000, [1, 2, 3, 4, 5, 6])]
    data = make_log(records, registry=[(1, 4, 10, 1.0, 0.0, "a", ""), (2, 4, 800, 0.5, 1.0, "IMU1_GyroX", "")])
    order: dict = {}
    rest = list(log.decode(data, False, order))
    plain = list(log.decode(data))
    assert [r for r in plain if r[1] != 1] == rest
    schema = next(log._batches([pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])])).schema
    made = pa.Table.from_batches(log._inertial(data, log.read_header(data), order, schema)).to_pylist()
    names = [f.name for f in schema]
    assert sorted(tuple(r[n] for n in names) for r in made if r["raw"] is not None) == sorted(r for r in plain if r[1] == 1)
    short = data[:-3] + struct.pack("<BHB", 1, 1, 0) + data[-3:]
    assert log.inertial_columns(short, log.read_header(short)) is None
