import json
import math

import numpy as np
import pytest
from fixtures import samples
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinespark.kernels import declip, estimate, filters, rotation, spectral
from kinespark.kernels.projection import Projector
from kinespark.model import SessionSet
from kinespark.operators import blocked, joins, laps, overlay, series, suspension, synthesis, tables, tracks
from kinespark.operators.variance import Overlay, variance

NAN, INF = float("nan"), float("inf")


def one(spark, values, rate=10.0):
    return samples(spark, {"c": values}, rate)


# ---- blocked primitives against whole-channel windows ----
def test_blocks_equal_whole_windows(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=57).tolist()
    s = one(spark, x).repartition(3)
    keys = ["session_id", "channel_id"]
    got = blocked.running_sum(s, keys, "idx", F.col("value"), "c", block=8).orderBy("idx").collect()
    assert np.allclose([g.c for g in got], np.cumsum(x))
    got = blocked.windowed(s, keys, "idx", 5, 2, lambda w: {"m": F.avg("value").over(w.rowsBetween(-5, 2))}, block=4).orderBy("idx").collect()
    assert [g.idx for g in got] == list(range(57))
    assert np.allclose([g.m for g in got], [np.mean(x[max(0, i - 5) : i + 3]) for i in range(57)])
    odd = s.where("idx % 3 <> 1").withColumnRenamed("idx", "o")
    assert [g.idx for g in blocked.dense_index(odd, keys, "o", block=4).orderBy("o").collect()] == list(range(38))


def test_carry_forward_crosses_blocks(spark):
    points = spark.createDataFrame([("s0", float(t)) for t in (0.5, 1.0, 55.0, 200.0)], "session_id string, t double")
    s = spark.createDataFrame([("s0", 1.0, 10.0), ("s0", 2.0, 20.0)], "session_id string, t double, value double")
    got = {r.t: r.value for r in joins.as_of(points, s, seconds_per_block=10.0).collect()}
    assert got == {0.5: None, 1.0: 10.0, 55.0: 20.0, 200.0: 20.0}
    near = {r.t: r.value for r in joins.nearest_event(points.unionByName(spark.createDataFrame([("s0", 1.5)], "session_id string, t double")), s, seconds_per_block=10.0).collect()}
    assert near == {0.5: 10.0, 1.0: 10.0, 1.5: 10.0, 55.0: 20.0, 200.0: 20.0}


def test_joins_over_samples_of_one_time(spark):
    """From their time on the last of them by idx, before it the first; whatever the order of the rows."""
    rows = [("s0", i, t, float(i)) for i, t in enumerate([1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 5.0])]
    points = spark.createDataFrame([("s0", t) for t in (0.0, 1.0, 2.0, 4.0, 5.0, 9.0)], "session_id string, t double")
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        s = spark.createDataFrame(order, "session_id string, idx long, t double, value double").coalesce(1)
        assert {r.t: r.value for r in joins.as_of(points, s).collect()} == {0.0: None, 1.0: 2.0, 2.0: 2.0, 4.0: 2.0, 5.0: 6.0, 9.0: 6.0}
        assert {r.t: r.value for r in joins.nearest_event(points, s).collect()} == {0.0: 0.0, 1.0: 2.0, 2.0: 2.0, 4.0: 3.0, 5.0: 6.0, 9.0: 6.0}
        epochs = s.select("session_id", "idx", F.col("t").alias("value"))
        got = joins.epoch_to_time(points.withColumnRenamed("t", "epoch_ms"), epochs, 2.0).collect()
        assert {r.epoch_ms: r.t for r in got} == {0.0: 0.0, 1.0: 1.0, 2.0: 1.125, 4.0: 1.375, 5.0: 3.0, 9.0: 3.0}


@given(st.floats(-1, 8), st.floats(-1, 8), st.sampled_from([1.0, 3.0, 10.0]))
@settings(max_examples=60, deadline=None)
def test_slice_bounds(a, b, rate):
    lo, hi = max(0, math.ceil(a * rate - 1e-9)), math.floor(b * rate + 1e-9)
    want = [i for i in range(50) if a * rate - 1e-9 <= i <= b * rate + 1e-9]
    assert [i for i in range(50) if lo <= i <= hi] == want


def test_slices(spark):
    s = one(spark, range(20))
    assert [r.idx for r in series.slice_by_time(s, 0.5, 0.7, 10.0).collect()] == [5, 6, 7]
    assert series.slice_by_time(s, 2, 1, 10.0).count() == 0
    assert series.slice_by_index(s, -3, 2).count() == 2 and series.value_at(s, 99).count() == 0


def test_histograms(spark):
    s = one(spark, [1, NAN, 3, INF, -INF, 6, 6])
    assert [r.n for r in series.histogram(s, 5).orderBy("bin").collect()] == [1, 0, 1, 0, 2]
    assert [r.n for r in series.histogram(s, 2, symmetric=True).orderBy("bin").collect()] == [0, 4]
    assert [r.n for r in series.histogram(s, 2, bounds=(0, 4)).orderBy("bin").collect()] == [1, 1]
    assert series.histogram(one(spark, [2, 2]), 4).count() == 0 and series.histogram(one(spark, [NAN]), 4).count() == 0


def test_tiles_equal_at_every_tier(spark):
    x = np.random.default_rng(1).normal(size=5000)
    x[100:200] = NAN
    s = one(spark, x.tolist())
    t2 = {(r.tile, r.bucket): (r.min_value, r.max_value) for r in series.tiles(s, 2).collect()}
    up = {(r.tile, r.bucket): (r.min_value, r.max_value) for r in series.tile_pyramid(series.tiles(s, 1)).collect()}
    assert repr(sorted(t2.items())) == repr(sorted(up.items()))
    full = series.tile(s, 1, 0).orderBy("bucket").collect()
    assert len(full) == 1024 and math.isnan(full[1000].min_value) and full[0].min_value == x[:8].min()
    assert math.isnan(full[14].max_value)


def test_scatter(spark):
    s = samples(spark, {"x": [-1, 0, 1, NAN, 2], "y": [0, 1, 2, 3]})
    p = series.pair_finite(s.where("channel_id = 'x'"), s.where("channel_id = 'y'"))
    assert p.count() == 3
    cells = {(r.row, r.col): r.n for r in series.scatter_density(p, 2, True).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    assert series.scatter_points(p, 2).count() == 2


def test_spectra_match_numpy(spark):
    x = np.sin(np.arange(300) * 0.7) + 0.1 * np.arange(300)
    s = one(spark, x.tolist())
    for trend in ("none", "mean", "linear"):
        for average in ("mean", "median"):
            f, want = spectral.welch(x, 10.0, "hamming", 64, 40, trend, average)
            got = series.welch(s, 10.0, "hamming", 64, 40, trend, average).orderBy("bin").collect()
            assert np.allclose([g.power for g in got], want) and np.allclose([g.freq for g in got], f)
    t, _, _, _ = spectral.stft(x, 10.0, "hann", 64, 40)
    assert np.allclose(sorted({r.t for r in series.spectrogram(s, 10.0, "hann", 64, 40).collect()}), t)
    whole = series.welch(s, 10.0, "rect", 0, 0, scaling="magnitude").orderBy("bin").collect()
    assert np.allclose([g.power for g in whole], spectral.magnitude(x, "rect"))


def test_filters():
    rate, t = 200.0, np.arange(1000) / 200.0
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 60 * t)
    assert np.abs(filters.zero_phase(slow + fast, 4, 10, "low", rate) - slow)[100:-100].max() < 0.02
    assert np.sqrt((filters.zero_phase(np.full(1000, 7.0), 2, 5, "high", rate) ** 2).mean()) < 1e-4
    for order in (1, 2, 3, 5):
        sos = filters.sections(order, 20.0, "low", rate)
        z = np.exp(1j * 2 * np.pi * 20.0 / rate)
        h = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2) for s in sos])
        assert abs(abs(h) - 2**-0.5) < 1e-9
    assert len(filters.zero_phase(np.empty(0), 2, 5, "low", rate)) == 0 and len(filters.zero_phase(np.ones(2), 4, 5, "low", rate)) == 2


def test_queries_of_one_channel_take_it_whole(spark):
    from kinespark import queries

    sf = "/root/testdata/sf0.01"
    counts = {r.channel_id: r["count"] for r in queries.channels(spark, sf).groupBy("channel_id").count().collect()}
    assert counts["click"] > min(counts.values())
    for name in ("butter_low", "butter_high", "declip"):
        assert queries.queries()[name](spark, sf).count() == counts["click"], name


def test_declip_shares_its_runs_between_tasks(spark):
    from kinespark.model import SessionSet
    from kinespark.plans.compile import evaluate

    x = np.clip(40 * np.sin(np.arange(400) / 5.0) + np.arange(400) % 7, -32, 32)
    x[0] = x[-1] = 32.0
    out = evaluate(SessionSet.from_samples(samples(spark, {"a": x.tolist()}), 10.0), "declip([a])")[0]
    assert np.array_equal([r.value for r in out.orderBy("idx").collect()], declip.declip(x)) and len(declip.runs(x)) > 20
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # after a repartition; not one task of a session


def test_declip():
    t = np.arange(64)
    x = 20 * np.sin(2 * np.pi * t / 64) ** 3 + 25
    pulse = 45 / np.cosh((t - 32) / 6.0) ** 2
    cut = np.clip(pulse, -32, 32)
    out = declip.declip(cut)
    a, b = declip.runs(cut)[0]
    assert (out[:a] == cut[:a]).all() and out[a : b + 1].max() > 34 and np.abs(out - pulse).max() < np.abs(cut - pulse).max()
    assert np.allclose(declip.declip(-cut), -out) and (declip.declip(x * 0) == 0).all()
    assert declip.runs(np.array([32.0, 0, -32, -32])) == [(0, 0), (2, 3)]
    assert (declip.declip(np.full(5, 32.0)) == 32.0).all()


# ---- islands, differences, synthesis ----
def test_runs(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 0, 1, 1, 1, 0]
    r = series.islands(one(spark, flags), series.KEYS, F.col("value") > 0)
    closed = series.close_short_gaps(r, series.KEYS, 1)
    assert sorted((x.start, x.end) for x in closed.collect()) == [(1, 4), (8, 10)]
    assert sorted((x.start, x.end) for x in series.sustained(r.where("flag"), 3).collect()) == [(8, 10)]
    f = np.array(flags, bool)
    assert estimate.close_gaps(f, 1)[:6].tolist() == [False, True, True, True, True, False]
    assert estimate.sustained(f, 3).sum() == 3


def test_imu_grid(spark):
    rows = [("s", 0, "IMU0_AccelX", i, t, v) for i, (t, v) in enumerate([(0, 0), (10, 10), (40, 41), (41, 99), (50, 50)])]
    rows += [("s", 1, "IMU1_AccelX", 10 + i, t, v) for i, (t, v) in enumerate([(20, 5), (30, 7)])]
    rows = [(*r[:5], float(r[5])) for r in rows]
    df = spark.createDataFrame(rows, "session_id string, imu int, channel_id string, seq long, ts_us long, raw double")
    placed = synthesis.place_slots(df, 10)
    assert [r.kept for r in placed.where("imu = 0").orderBy("seq").collect()] == [True, True, True, False, True]
    grid, gaps = synthesis.rebuild_imu_grid(placed.where("kept"), 10)
    got = {k: [r.value for r in grid.where(F.col("channel_id") == k).orderBy("idx").collect()] for k in ("IMU0_AccelX", "IMU1_AccelX")}
    assert got == {"IMU0_AccelX": [0, 10, 20, 31, 41, 50], "IMU1_AccelX": [5, 5, 5, 7, 7, 7]}
    assert sorted((g.channel_id, g.start, g.len) for g in gaps.collect()) == [("IMU0_AccelX", 2, 2), ("IMU1_AccelX", 0, 2), ("IMU1_AccelX", 4, 2)]
    report = synthesis.drop_report(df, 10).where("imu = 0").first()
    assert (report.received, report.kept, report.collisions, report.fills, report.gaps_2_3) == (5, 4, 1, 2, 1)


def test_time_and_distance(spark):
    s = samples(spark, {"GPS_SpeedKmh": [36, 36, 36]}, 1.0).unionByName(samples(spark, {"Fork": range(9)}, 4.0))
    data = SessionSet.from_samples(s, {"GPS_SpeedKmh": 1.0, "Fork": 4.0})
    assert [r.value for r in synthesis.time_ramp(data.channels).orderBy("idx").collect()] == [i / 4 for i in range(9)]
    assert np.allclose([r.value for r in synthesis.distance(s, data.channels).orderBy("idx").collect()], [i * 2.5 for i in range(9)])


def test_reports(spark):
    out = synthesis.sag_stats(one(spark, [1, 2, 3, 4, NAN]), "channel_id").first()
    assert (out.n, out.mean, out.q50, out.q95) == (4, 2.5, 2.0, 4.0)
    text = """==== BOOT reason=BROWNOUT heap=1200 ====
t=12 EVT IMU0 spi drains=10 pairs=200 ovr=3 read_us=40/90 tot_us=55/120
 t=13 EVT IMU1 i2c drains=11 pairs=201 ovr=0 reuse=4 unk=2 read_us=41/91
t=14 EVT IMU cycle_max_us=700 writer_drops=1 poll_ms=5 cap=64
t=15 BROWNOUT seen t=99
t=16 heap=1 min=2 heap=3
==== BOOT heap=1 ====
==== BOOT reason=POWERON reason=X ===="""
    report = synthesis.diagnostic_report(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"))
    got = [tuple(r) for r in report.select("kind", "t", "imu", "bus", "pairs", "ovr", "unk", "read_max_us", "total_avg_us", "cycle_max_us", "writer_drops", "flag").where("kind <> 'boot'").orderBy("t").collect()]
    assert got == [("drain", "12", "IMU0", "spi", 200, 3, None, 90, 55, None, None, "overruns"), ("drain", "13", "IMU1", "i2c", 201, 0, 2, 91, None, None, None, "unknown_tags"), ("cycle", "14", None, None, None, None, None, None, None, 700, 1, "writer_drops"), ("brownout", "15", None, None, None, None, None, None, None, None, None, None)]
    assert {r.reason: r.boots for r in synthesis.boots(report).collect()} == {"BROWNOUT": 1, "?": 1, "POWERON": 1}


# ---- laps and tracks ----
def track(spark, points, ms=1000):
    rows = [("s", i, i * ms, float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "session_id string, idx long, timestamp_ms long, lat double, lon double")


LINE = [(i, 0.0) for i in range(10)] + [(9 - i, 0.0) for i in range(1, 10)]
AT = lambda x: laps.Gate(x, -1.0, x, 1.0)


def test_crossings_and_circuit(spark):
    f = track(spark, LINE)
    hits = [(r.idx, r.ms) for r in laps.crossings(f, {"g": AT(4.5)}).orderBy("idx").collect()]
    assert hits == [(5, 4500), (14, 13500)]
    exact = [r.ms for r in laps.crossings(f, {"g": AT(4.0)}).orderBy("idx").collect()]
    assert exact == [4000, 14000]
    got = [(r.lap, r.start_ms, r.end_ms) for r in laps.circuit_laps(f, AT(4.5)).orderBy("lap").collect()]
    assert got == [(1, 0, 4500), (2, 4500, 13500)]
    assert laps.circuit_laps(f, AT(99)).count() == 0


def test_point_to_point(spark):
    f = track(spark, LINE)
    got = [(r.lap, r.start_ms, r.end_ms) for r in laps.point_to_point_laps(f, AT(2.5), AT(6.5)).orderBy("lap").collect()]
    assert got == [(1, 2500, 6500)]
    back = [(r.start_ms, r.end_ms) for r in laps.point_to_point_laps(f, AT(6.5), AT(2.5)).collect()]
    assert back == [(11500, 15500)]


def test_sectors_zones_and_windows(spark):
    f = track(spark, LINE)
    layout = laps.Layout(laps.Timing("circuit", AT(8.5)), (("one", AT(2.5)), ("two", AT(99))), (laps.Zone("z", AT(3.5), AT(5.5)),))
    lap = laps.detect_laps(f, layout).where("lap = 1").first()
    assert [(s.name, s.start_ms, s.end_ms) for s in lap.sectors] == [("one", 0, 2500), ("two", 2500, 8500)]
    assert [(v.zone, v.enter_ms, v.exit_ms) for v in lap.visits] == [("z", 3500, 5500)]
    assert lap.raw_elapsed_ms == 8500 and lap.lap_time_ms == 6500 and lap.end_s == 8.5
    cut = laps.detect_laps(f, laps.Layout(laps.Timing("circuit", AT(4.5))), (3000, 9000)).collect()
    assert [(x.start_ms, x.end_ms) for x in cut] == [(3000, 4500)]


def test_pairing_of_visits(spark):
    def pairs(e, x):
        df = spark.createDataFrame([(e, x)], "e array<long>, x array<long>")
        return [(p.enter_ms, p.exit_ms) for p in df.select(laps.pair_visits(F.col("e"), F.col("x")).alias("p")).first().p]

    def brute(e, x):
        out, i, j = [], 0, 0
        while i < len(e) and j < len(x):
            while j < len(x) and x[j] <= e[i]:
                j += 1
            if j >= len(x):
                break
            out.append((e[i], x[j]))
            i, j = i + 1, j + 1
        return out

    r = np.random.default_rng(3)
    for _ in range(12):
        e, x = (sorted(r.integers(0, 30, r.integers(0, 6)).tolist()) for _ in range(2))
        assert pairs(e, x) == brute(e, x)


def test_visits(spark):
    line = [(450000000.0, 60000000.0 + 100 * i) for i in range(100)]
    away = [(450900000.0, 60000000.0)] * 10
    f = track(spark, line[:60] + away + line[60:], 1000)
    got = [(r.track_id, r.start_ms, r.end_ms) for r in tracks.visits(f, {"t": [line[0], line[-1]], "short": [line[0]]}, least_s=10).orderBy("start_ms").collect()]
    assert got == [("t", 0, 59000), ("t", 70000, 109000)]
    one_ = tracks.visits(f, {"t": [line[0], line[-1]]}, gap_s=20, least_s=10).collect()
    assert [(r.start_ms, r.end_ms) for r in one_] == [(0, 109000)]
    assert tracks.visits(f, {}).count() == 0


def test_distance_on_the_globe(spark):
    f = track(spark, [(0, 0), (10_000_000, 0)])
    end = laps.cumulative_distance(f).orderBy("idx").collect()[1].distance_m
    assert abs(end - 6_371_000 * math.pi / 180) < 1e-6


def test_distance_and_laps_over_gaps_in_idx(spark):
    """A session's fixes keep the numbers of a table that they share, so the one before may be blocks away."""
    places = [(0, 0, 0), (5, 1_000, 10_000_000), (70_000, 2_000, 20_000_000), (70_001, 3_000, 30_000_000), (400_000, 4_000, 40_000_000)]
    f = spark.createDataFrame([("s0", i, ms, float(lat), 0.0) for i, ms, lat in places], "session_id string, idx long, timestamp_ms long, lat double, lon double")
    far = [r.distance_m for r in laps.cumulative_distance(f).orderBy("idx").collect()]
    assert np.allclose(far, [6_371_000 * math.pi / 180 * i for i in range(5)])
    hit = laps.crossings(f, {"g": laps.Gate(15_000_000.0, -1e6, 15_000_000.0, 1e6), "h": laps.Gate(35_000_000.0, -1e6, 35_000_000.0, 1e6)}).orderBy("idx").collect()
    assert [(r.gate, r.idx, r.ms) for r in hit] == [("g", 70_000, 1_500), ("h", 400_000, 3_500)]
    got = blocked.previous(f, ["session_id"], "idx", {"p": F.col("idx")}).orderBy("idx").collect()
    assert [r.p for r in got] == [None, 0, 5, 70_000, 70_001]


# ---- variance ----
def test_queries_compare_every_lap_and_estimate_every_sample(spark):
    from kinespark import queries

    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    for mode in ("variance_time", "variance_dist"):
        rows = queries.queries()[mode](spark, sf).groupBy("lap").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).collect()
        want = {k + 1: min(500, events - 500 * k) for k in range(1, math.ceil(events / 500))}
        assert len(want) > 1 and {r.lap: (r.n, r.lo, r.hi) for r in rows} == {k: (n, 0, n - 1) for k, n in want.items()}, mode
    counts = {r.channel_id: r["count"] for r in queries.channels(spark, sf).groupBy("channel_id").count().collect()}
    n = min(counts[c] for c in ("click", "view", "signup"))  # the axes of IMU0, cut to the shortest of them
    got = {r.channel_id: r["count"] for r in queries.queries()["suspension"](spark, sf).groupBy("channel_id").count().collect()}
    assert n > 400 and got == dict.fromkeys(suspension.OUTPUTS, n)


def test_lap_against_itself_is_zero(spark):
    n = 60
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ch = {"GPS_Latitude": 45e7 + 1e4 * np.sin(a), "GPS_Longitude": 6e7 + 1e4 * np.cos(a), "GPS_EpochMs": np.arange(n) * 1000.0, "Fork": np.sin(3 * a)}
    s = samples(spark, {k: v.tolist() for k, v in ch.items()}, 1.0)
    data = SessionSet.from_samples(s, 1.0)
    for mode in ("variance_time", "variance_dist"):
        out = [r.value for r in variance(data, "Fork", 1.0, Overlay(data, "s0", (0.0, 59_000.0), 0.0), (0.0, 50.0), mode).orderBy("idx").collect()]
        assert all(math.isnan(v) for v in out[50:]) and np.nanmax(np.abs(out[:50])) < 0.02, mode


def test_projection():
    p = Projector(np.array([0.0, 10, 10]), np.array([0.0, 0, 10]), np.array([0.0, 1, 2]))
    assert p.project(5, 1, 0.0)[:3] == (5.0, 0.5, 1.0)
    assert p.project(9, 5, math.pi / 2)[3] == 1
    assert p.project(5, 0, math.pi * 1.25) is None and p.last == 1


# ---- tables ----
def table(columns, rows, cells):
    t = tables.Table(columns, rows, [[tables.TableCell(**c) for c in r] for r in cells])
    return t


def test_table(spark):
    data = SessionSet.from_samples(samples(spark, {"Fork": range(10)}), 10.0)
    rows = [tables.TableRow("a", None, None, (0.0, 0.4)), tables.TableRow("b", None, None, (0.5, 0.9)), tables.TableRow("c")]
    cols = [("c1", "top", "max([Fork])"), ("c2", "twice", "{top} * 2"), ("c3", "all", "sum({top[]}) + main({top[]})"), ("c4", "n", None)]
    t = table(cols, rows, [[{}, {}, {}, {"literal": 4.0}], [{}, {"formula": "{A1} + {D1}"}, {}, {}], [{}, {"formula": "1 + 1"}, {"formula": "nope("}, {}]])
    t.baseline_row = 1
    got = tables.evaluate_table(data, t)
    assert got[0] == [(4.0, None), (8.0, None), (13.0 + 9.0, None), (4.0, None)]
    assert got[1] == [(9.0, None), (8.0, None), (22.0, None), (None, None)]
    assert got[2][0] == (None, "unknown_channel") and got[2][1] == (2.0, None) and got[2][2] == (None, "parse")
    assert tables.text_grid(t, got).splitlines()[3] == "#ERR,2.0,#ERR,"
    assert ("parse_error", 2, 2) in tables.validate(t, {"Fork"}) and tables.validate(t, {"x"})[0][0] == "unknown_reference"


def test_table_cycle(spark):
    data = SessionSet.from_samples(samples(spark, {"Fork": range(3)}), 10.0)
    t = table([("a", "a", "{b}"), ("b", "b", "{a}"), ("c", "c", "1")], [tables.TableRow("r")], [[{}, {}, {}]])
    assert tables.evaluate_table(data, t) == [[(None, "cycle"), (None, "cycle"), (None, None)]]
    assert tables.lap_windows(table([], [tables.TableRow("r", None, 7)], [[]]), [(0, 1)])


# ---- overlay ----
def test_overlay(spark):
    frames = overlay.frame_clock(spark, "s0", 10, 0.5)
    assert [r.value for r in overlay.gauge(frames, one(spark, [0, 10, 20], 5.0), 5.0).orderBy("frame").collect()] == [0, 5, 10, 15, 20]
    strip = overlay.trace(frames, one(spark, range(10)), 10.0, 0.2).where("frame = 4").orderBy("k").collect()
    assert [(round(r.x, 6), round(r.y, 6)) for r in strip] == [(0.0, round(2 / 9, 6)), (0.5, round(3 / 9, 6)), (1.0, round(4 / 9, 6))]
    norm = overlay.normalised_map(spark.createDataFrame([("s0", 0, 0.0, 45.0, 6.0), ("s0", 1, 0.2, 45.1, 6.0)], "session_id string, idx long, t double, lat double, lon double"))
    pos = overlay.map_position(frames, norm).orderBy("frame").collect()
    assert [r.y for r in pos] == [0.0, 0.0, 1.0, 1.0, 1.0]
    assert overlay.map_line(norm).count() == 2
    e7 = overlay.normalised_map(spark.createDataFrame([("s0", 0, 0.0, 45e7, 6e7), ("s0", 1, 0.2, 46e7, 8e7), ("s0", 2, 0.3, 45.5e7, 6.5e7)], "session_id string, idx long, t double, lat double, lon double"))
    assert [(r.x, r.y) for r in e7.orderBy("idx").collect()] == [(0.0, 0.0), (1.0, 1.0), (0.25, 0.5)]
    many = [(i + 1, 2.0 * i, 2.0 * i + 1.5, 1500 + (i * 37) % 101) for i in range(200)]
    panel = {r.frame: r for r in overlay.lap_panel(overlay.frame_clock(spark, "s0", 1, 420), many).collect()}
    for frame, r in panel.items():
        inside = [x for x in many if x[1] <= frame < x[2]]
        done = [x[3] for x in many if x[2] <= frame]
        assert (r.current_lap, r.lap_elapsed_s, r.last_lap_ms, r.best_lap_ms) == (inside[-1][0] if inside else None, frame - inside[-1][1] if inside else 0.0, done[-1] if done else None, min(done, default=None))
    assert overlay.lap_panel(frames, []).first().current_lap is None
    clock = spark.range(1).select(overlay.elapsed_text(F.lit(83.456)).alias("a"), overlay.lap_text(F.lit(83456)).alias("b"), overlay.value_text(F.lit(-12.34)).alias("c"), overlay.value_text(F.lit(2.5)).alias("d")).first()
    assert tuple(clock) == ("1:23.5", "1:23.46", "-12.3", "2.50")
    assert overlay.sync((2.0, 5000.0), None, 10.0, 1000.0, 60.0) == (2.0, "gpmf", 0.9)
    with pytest.raises(Exception, match="spans"):
        overlay.sync(None, 1e6, 10.0, 0.0, 60.0)


# ---- rotations and the estimator ----
def test_rotations():
    r = np.random.default_rng(4)
    for _ in range(20):
        v = r.normal(size=3)
        m = rotation.exp(v / np.linalg.norm(v) * r.uniform(0, 3.1))
        assert np.allclose(rotation.exp(rotation.log(m)), m) and np.allclose(m @ m.T, np.eye(3))
        a, b = r.normal(size=3), r.normal(size=3)
        assert np.allclose(rotation.between(a, b) @ a / np.linalg.norm(a), b / np.linalg.norm(b))
        swing, twist = rotation.swing_twist(m, a)
        assert np.allclose(swing @ twist, m) and np.allclose(twist @ a, a) and abs(rotation.log(swing) @ a) < 1e-6
        eps = 1e-6 * r.normal(size=3)
        assert np.allclose(rotation.log(rotation.exp(v).T @ rotation.exp(v + eps)), rotation.right_jacobian(v) @ eps, atol=1e-10)
    assert np.allclose(rotation.between(np.array([0, 0, -1.0]), np.array([0, 0, 1.0])) @ [0, 0, -1], [0, 0, 1])
    assert np.allclose(rotation.from_gravity(np.array([1.0, 0, 0])).reshape(3, 3) @ [1, 0, 0], [0, 0, 1])
    assert np.allclose(rotation.vee(rotation.skew(np.array([1.0, 2, 3]))), [1, 2, 3])
    with pytest.raises(ValueError):
        rotation.bias(np.empty((0, 3)))


def still_unit(n=200):
    return estimate.Unit(np.zeros((n, 3)), np.tile([0.0, 0.0, estimate.GRAVITY], (n, 1)))


def test_static_recording_reads_zero():
    g = estimate.Geometry(imu1=estimate.Pose(np.eye(3), np.zeros(3)), imu2=estimate.Pose(np.eye(3), np.zeros(3)))
    for smooth in (False, True):
        e = estimate.run(0.01, still_unit(), still_unit(), still_unit(), None, g, estimate.Config(smooth=smooth))
        assert np.abs(e.front_travel).max() < 1e-6 and np.abs(e.rear_travel).max() < 1e-3 and e.stationary[30:].all()
        assert dict((x[0], x[2]) for x in e.ledger)["psi"] == "frozen" and np.linalg.eigvalsh(e.belief.p).min() > -1e-9


def test_travel_stays_within_the_stops_and_survives_free_fall():
    r = np.random.default_rng(5)
    n = 400
    a0, a1 = r.normal(0, 3, (n, 3)) + [0, 0, 9.81], r.normal(0, 60, (n, 3)) + [0, 0, 9.81]
    a0[200:260] = a1[200:260] = 0.0
    e = estimate.run(0.005, estimate.Unit(np.zeros((n, 3)), a0), estimate.Unit(np.zeros((n, 3)), a1), None, (np.array([1.0]), np.array([[5.0, 0, 0]])), estimate.Geometry(imu2=None, rear_path=None))
    assert e.airborne[205:255].all() and np.isfinite(e.front_travel).all() and e.front_travel.max() < 0.25
    assert np.abs(e.front_travel[210:250]).max() < 0.03 and e.dynamic_sag(e.front_travel) is not None


def test_smoothing_lowers_variance():
    r = np.random.default_rng(6)
    c = estimate.Config()
    still = np.zeros(100, bool)
    still[:10] = still[60:70] = True
    _, _, filtered, smoothed = estimate.smooth_wheel(r.normal(0, 2, 100), still, np.zeros(100, bool), 0.01, 0.17, 0.05, c, variances=True)
    assert (smoothed <= filtered + 1e-15).all() and smoothed[30] < filtered[30]


def test_measurement_jacobians():
    r = np.random.default_rng(7)
    rot, x, accel = rotation.exp(r.normal(size=3)), r.normal(size=24) * 0.1, r.normal(size=3) + [0, 0, 9.81]
    x[:3] = 0
    measure = estimate._gravity(accel)
    r0, h = measure(rot, x)
    b = estimate.Belief(rot, x, np.eye(24))
    for k in range(24):
        d = np.zeros(24)
        d[k] = 1e-6
        assert np.allclose((measure(*b.moved(d))[0] - r0) / 1e-6, h[:, k], atol=1e-4)


def test_suspension_operator(spark):
    ch = {f"IMU{i}_Accel{a}": [1.0 if a == "Z" else 0.0] * 60 for i in (0, 1) for a in "XYZ"}
    data = SessionSet.from_samples(samples(spark, ch, 100.0), 100.0)
    out = suspension.suspension(data)
    assert {r.channel_id: r.n for r in out.groupBy("channel_id").agg(F.count("value").alias("n")).collect()} == dict.fromkeys(suspension.OUTPUTS, 60)
    assert suspension.suspension_trace(data).count() == 60 and suspension.suspension_ledger(data).count() == 12
    json.dumps([r.asDict() for r in suspension.suspension_ledger(data).collect()])


def test_live_tiles(spark, tmp_path):
    from kinespark.streaming.rollups import live_rolling, live_tiles

    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) ts, 's' session_id, 'c' channel_id, cast(id as double) value from range(40)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, made in (("tiles", live_tiles(stream)), ("rolling", live_rolling(stream))):
        q = made.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.min_value, r.max_value, r.n) for r in spark.table("tiles").collect()) == [(0, 9, 10), (10, 19, 10), (20, 29, 10), (30, 39, 10)]
    assert spark.table("rolling").count() == 9


def test_rendered_frames(spark):
    from kinespark.kernels import raster
    from kinespark.sources.config import OverlayLayout

    elements = [{"type": "gauge", "rect": [0.0, 0.0, 0.5, 0.5], "channel": "a", "style": "bar", "label": "A", "min": 0, "max": 10}, {"type": "track_map", "rect": [0.5, 0.0, 0.5, 0.5]}, {"type": "lap_panel", "rect": [0.0, 0.5, 0.5, 0.5]}, {"type": "trace_strip", "rect": [0.5, 0.5, 0.5, 0.5], "channels": ["a"]}, {"type": "attitude", "rect": [0.0, 0.0, 0.2, 0.2], "channel": "zz", "style": "roll", "range_deg": 30}]
    frames = spark.sql("select id frame, cast(id * 5 as double) a, 0.5D x, 0.5D y, 1L current_lap, 2.5D lap_elapsed_s, 83456L last_lap_ms, 83456L best_lap_ms, array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 1.0D, 'y', 1.0D)) tr from range(3)")
    out = overlay.rendered(frames, OverlayLayout("i", "n", "64x48", elements), {"a": "a"}, (64, 48), {"a": "tr"}, [(0.0, 0.0), (1.0, 1.0)]).orderBy("frame").collect()
    pictures = [np.frombuffer(r.pixels, np.uint8).reshape(48, 64, 4) for r in out]
    lit = [int((p[:24, :32, 3] > 0).sum()) for p in pictures]
    bar = [int((p[:24, :32] == raster.ACCENT).all(axis=2).sum()) for p in pictures]
    assert len(pictures) == 3 and bar[0] < bar[1] < bar[2] and min(lit) > 0
    assert raster.draw([], {}, {}, (4, 4), {}, []).sum() == 0


def test_lap_slices_and_coupling(spark):
    data = SessionSet.from_samples(one(spark, range(20)), 10.0)
    name, n = data.slice_lap("c", "main", 2, 0.5, 1.0)
    assert n == 6 and [r.value for r in data.derived[name].orderBy("idx").collect()] == [5, 6, 7, 8, 9, 10]
    assert data.slice_lap("c", "main", 2, 0.0, 0.1) == (name, 2) and data.slice_lap("c", "overlay", 1, 9, 10)[1] == 0
    data.retain_derived(set())
    assert not data.derived
    s = samples(spark, {"IMU0_AccelZ": [1.0] * 5, "IMU0_GyroY": [0.0, 1.0, 2.0, 3.0, 4.0]}, 10.0)
    got = suspension.axle_forces(SessionSet.from_samples(s, 10.0)).orderBy("idx").collect()
    want = np.radians(10.0)
    assert np.allclose([r.front for r in got], 9.81 + 0.835 * want) and np.allclose([r.rear for r in got], 9.81 - 0.445 * want)


def test_exact_order_statistics(spark):
    from kinespark.operators import quantiles

    r = np.random.default_rng(5)
    cases = {"wide": np.concatenate([r.normal(size=400) * 10.0 ** r.integers(-8, 8, 400), 2.0 ** np.arange(-30, 30), -(2.0 ** np.arange(-30, 30)), np.nextafter(2.0 ** np.arange(-30, 30), 0)]), "ties": np.repeat([3.0, -0.0, 0.0, 7.5], [50, 3, 4, 9]), "one": np.array([2.5]), "odd": np.array([np.nan, np.inf, 1.0, -np.inf, 5.0]), "none": np.array([np.nan])}
    s = samples(spark, {k: v.tolist() for k, v in cases.items()}, 10.0)
    wanted = {"a": 0.0, "b": 5.0, "c": 50.0, "d": 99.5, "e": 100.0}
    got = {x.channel_id: x for x in quantiles.percentiles(s, ["channel_id"], "value", wanted).collect()}
    for name, v in cases.items():
        v = v[np.isfinite(v)]
        for k, q in wanted.items():
            assert (np.isnan(got[name][k]) and not len(v)) or np.isclose(got[name][k], np.percentile(v, q), rtol=1e-12, atol=0)


def test_greatest_before_and_visits_cross_blocks(spark):
    from kinespark.operators.blocked import greatest_before

    r = np.random.default_rng(6)
    v = r.integers(0, 1000, 40).tolist()
    got = greatest_before(one(spark, v), ["session_id"], "idx", "value", "top", block=7).orderBy("idx").collect()
    assert [x.top for x in got] == [None, *[float(max(v[:i])) for i in range(1, 40)]]
