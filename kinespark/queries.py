"""Queries over the driver's tables, and the SQL that gives the same rows.

Channels are views of ``events``: one fixed-rate channel (10 Hz) per event type, numbered by event_id; the
same rows at their own times are event-driven channels. Fixes are closed-form from event_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.aggregate import AGGREGATES
from .model import SessionSet, grid
from .operators import joins, laps, overlay, quantiles, series, synthesis, tables, tracks
from .operators.blocked import dense_index
from .plans.compile import LapContext, evaluate

RATE = 10.0
TYPES = ("click", "error", "purchase", "signup", "view")
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ts.alias("ts"), "user_id", "event_type", "value").select("event_id", us.alias("us"), "user_id", "event_type", "value")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the fixed-rate channels."""
    e = dense_index(_events(spark, sf_dir).select("event_id", F.col("event_type").alias("channel_id"), "value"), ["channel_id"], "event_id")
    return e.select(F.lit("s0").alias("session_id"), "channel_id", "idx", (F.col("idx") / RATE).alias("t"), "value")


def event_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the events' own times, in seconds of 2024."""
    e = dense_index(_events(spark, sf_dir).select("event_id", "us", F.col("event_type").alias("channel_id"), "value"), ["channel_id"], "event_id")
    return e.select(F.lit("s0").alias("session_id"), "channel_id", "idx", (F.col("us") / 1e6).alias("t"), "value")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop of 500 fixes a lap around a fixed place, in degrees x 1e7."""
    e = _events(spark, sf_dir)
    a = F.col("event_id") * 0.012566
    return e.select(F.lit("s0").alias("session_id"), F.col("event_id").alias("idx"), F.floor(F.col("us") / 1000).cast("long").alias("timestamp_ms"), F.round(450000000 + 10000 * F.sin(a)).alias("lat"), F.round(60000000 + 15000 * F.cos(a)).alias("lon"))


def common(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TYPES) -> SessionSet:
    """The named channels, cut to the shortest of them, as the expression language wants equal lengths of those that it
    combines; one alone is whole."""
    s = channels(spark, sf_dir).where(F.col("channel_id").isin(*names))
    if len(names) > 1:
        n = s.groupBy("channel_id").count().agg(F.min("count")).first()[0]
        s = s.where(F.col("idx") < n)
    return SessionSet.from_samples(s, RATE)


S_SQL = """s AS (SELECT 's0' AS session_id, event_type AS channel_id,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS idx,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS DOUBLE) / 10.0 AS t,
  epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, event_id, value FROM events)"""


def g_sql(*names: str) -> str:
    """The same as a grid g of the named channels."""
    listed = ", ".join(f"'{c}'" for c in names)
    columns = ", ".join(f"max(value) FILTER (WHERE channel_id = '{c}') AS {c}" for c in names)
    return f"""{S_SQL}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM s WHERE channel_id IN ({listed}) GROUP BY channel_id)),
g AS (SELECT idx, {columns} FROM s, n WHERE channel_id IN ({listed}) AND idx < n.n GROUP BY idx)"""


X_SQL = """x AS (SELECT event_id AS idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 AS ms,
  round(450000000 + 10000 * sin(event_id * 0.012566)) AS lat, round(60000000 + 15000 * cos(event_id * 0.012566)) AS lon FROM events)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _expression(name: str, text: str, sql: str, digits: int = 6, laps_: LapContext | None = None) -> None:
    """An expression over the grid of the channels it names against its SQL over g."""
    names = tuple(c for c in TYPES if f"[{c}]" in text)

    def run(spark, sf_dir):
        out, _, _ = evaluate(common(spark, sf_dir, names), text, laps_)
        return out.select("idx", F.round("value", digits).alias("value"))

    query(name, f"WITH {g_sql(*names)} SELECT idx, round(CAST({sql} AS DOUBLE), {digits}) AS value FROM g")(run)


_W8 = "OVER (ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_b = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
_expression("expr_arith", "([click] + [view]) * 0.5 - [error] / 4", "(click + view) * 0.5 - error / 4.0")
_expression("expr_compare", "([click] > [view]) + ([click] <= 20) * 2 + ([view] != [error]) * 4 + ([click] == [click]) * 8", f"{_b('click > view')} + 2 * {_b('click <= 20')} + 4 * {_b('view <> error')} + 8.0")
_expression("expr_logic", "([click] > 20 and [view] > 20) + (not ([click] > 50) or [error] < 5) * 2", f"{_b('click > 20 AND view > 20')} + 2 * {_b('NOT click > 50 OR error < 5')}")
_expression("expr_if_clamp", "if([click] > [view], clamp([click], 5, 40), -[view])", "CASE WHEN click > view THEN least(greatest(click, 5.0), 40.0) ELSE -view END")
_expression("expr_constants", "[click] * g + sin(pi / 6) + e - tau", "click * 9.80665 + sin(pi() / 6) + exp(1.0) - 2 * pi()")
_expression("expr_chain", "[click] < [view] < 0.5", _b(f"{_b('click < view')} < 0.5"))
_expression("fn_rounding", "floor([click]) + 10 * ceil([view]) + 100 * round([error]) + sign([click] - 20) + abs([view] - 20)", "floor(click) + 10 * ceil(view) + 100 * floor(error + 0.5) + sign(click - 20) + abs(view - 20)")
_expression("fn_trig", "sin([click]) + cos([view]) + tan([error] / 400) + atan([click]) + atan2([click], [view]) + asin([click] / 500) + acos([view] / 500)", "sin(click) + cos(view) + tan(error / 400) + atan(click) + atan2(click, view) + asin(click / 500) + acos(view / 500)")
_expression("fn_hyperbolic", "sinh([click] / 100) + cosh([view] / 100) + tanh([error] / 100)", "(exp(click/100) - exp(-click/100)) / 2 + (exp(view/100) + exp(-view/100)) / 2 + (exp(error/50) - 1) / (exp(error/50) + 1)")
_expression("fn_pow_minmax", "pow([click], 0.5) + min([click], [view]) + max([click], [error]) + sqrt([view])", "pow(click, 0.5) + least(click, view) + greatest(click, error) + sqrt(view)")
_expression("fn_angles", "deg2rad([click]) + rad2deg([view])", "click * pi() / 180 + view * 180 / pi()", 5)
_expression("fn_negative", "round([click] - 20.5) + 10 * floor(-[view]) + 100 * ceil(-[error] / 2) + sign(20 - [click])", "CASE WHEN click - 20.5 < 0 THEN -floor(abs(click - 20.5) + 0.5) ELSE floor(click - 20.5 + 0.5) END + 10 * floor(-view) + 100 * ceil(-error / 2) + sign(20 - click)")
_expression("agg_broadcast", "[click] - mean([click]) + std([view])", "click - avg(click) OVER () + stddev_pop(view) OVER ()")
_expression("roll_mean", "mean([click], 8)", f"avg(click) {_W8}")
_expression("roll_rms", "rms([click], 8)", f"sqrt(avg(click * click) {_W8})")
_expression("roll_std", "std([click], 8)", f"CASE WHEN idx = 0 THEN 0.0 ELSE stddev_pop(click) {_W8} END")
_expression("differentiate", "differentiate([click])", "coalesce((click - lag(click) OVER (ORDER BY idx)) * 10, 0.0)")
_expression("detrend_mean", "detrend([click], 'mean')", "click - avg(click) OVER ()")
_expression("vec_algebra", "norm(cross(vec([click], [view], [error]), vec(1, 2, 3))) + dot(vadd(vec([click], [view], [error]), vec(1, 1, 1)), vscale(vec(1, 0, 2), 0.5)) - vx(vsub(vec([click], 0, 0), vec([view], 0, 0)))", "sqrt(pow(view*3-error*2,2)+pow(error-click*3,2)+pow(click*2-view,2)) + (click+1)*0.5 + (error+1) - (click-view)")
_expression("vec_angle", "angle(vec([click], [view], [error]), vec(1, 2, 3)) + vz(normalize(vec([click], [view], [error])))", "atan2(sqrt(pow(view*3-error*2,2)+pow(error-click*3,2)+pow(click*2-view,2)), click+2*view+3*error) + error / sqrt(click*click+view*view+error*error)")
_expression("rotate_mat", "vx(rotate_mat(vec([click], [view], [error]), 0, -1, 0, 1, 0, 0, 0, 0, 1)) + 2 * vy(rotate_mat(vec([click], [view], [error]), 0, -1, 0, 1, 0, 0, 0, 0, 1))", "-view + 2 * click")
_expression("rotate_axis", "vx(rotate_axis(vec([click], [view], [error]), 0, 0, 2, 0.5)) + vz(rotate_axis(vec([click], [view], [error]), 1, 0, 0, 0.25))", "click*cos(0.5) - view*sin(0.5) + view*sin(0.25) + error*cos(0.25)")
_expression("rotate_euler", "vx(rotate_euler(vec([click], [view], [error]), 0.1, 0.2, [click] / 100)) + vz(rotate_euler(vec([click], [view], [error]), 0.1, 0.2, 0.3))", "click*cos(click/100)*cos(0.2) + view*(cos(click/100)*sin(0.2)*sin(0.1) - sin(click/100)*cos(0.1)) + error*(cos(click/100)*sin(0.2)*cos(0.1) + sin(click/100)*sin(0.1)) - click*sin(0.2) + view*cos(0.2)*sin(0.1) + error*cos(0.2)*cos(0.1)")
LAPS = LapContext(bounds=[(0.0, 30.0), (30.0, 75.5), (75.5, 120.0)], sectors=[(0.0, 15.0), (15.0, 30.0), (40.0, 75.5)], main_lap=1)
_lap = "CASE WHEN idx/10.0 < 30 THEN 1.0 WHEN idx/10.0 < 75.5 THEN 2.0 WHEN idx/10.0 < 120 THEN 3.0 ELSE 0.0 END"
_expression("join_lap_interval", "current_lap() + 0 * [click]", _lap, laps_=LAPS)
_expression("sector_number", "if([click] >= 0, sector_number(), 0) == 2", _b("idx/10.0 >= 40 AND idx/10.0 < 75.5"), laps_=LAPS)
_expression("lap_start", "if([click] < 0, 0, lap_start_time(current_lap()) == 30)", _b(f"({_lap}) = 2.0"), laps_=LAPS)


@query("integrate", f"WITH {g_sql('click')}, d AS (SELECT idx, coalesce((click + lag(click) OVER (ORDER BY idx)) / 2 * 0.1, 0.0) AS v FROM g) SELECT idx, round(sum(v) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 4) AS value FROM d")
def _integrate(spark, sf_dir):
    out, _, _ = evaluate(common(spark, sf_dir, ("click",)), "integrate([click])")
    return out.select("idx", F.round("value", 4).alias("value"))


@query("detrend_linear", f"WITH {g_sql('click')}, m AS (SELECT avg(click) AS y, avg(idx) AS x FROM g), k AS (SELECT sum((g.click - y) * (g.idx - x)) / sum((g.idx - x) * (g.idx - x)) AS b FROM g, m) SELECT idx, round(click - (y + b * (idx - x)), 6) AS value FROM g, m, k")
def _detrend(spark, sf_dir):
    out, _, _ = evaluate(common(spark, sf_dir, ("click",)), "detrend([click])")
    return out.select("idx", F.round("value", 6).alias("value"))


@query("scan_channels", f"WITH {S_SQL} SELECT channel_id, idx, t, value FROM s")
def _scan(spark, sf_dir):
    return channels(spark, sf_dir).select("channel_id", "idx", "t", "value")


@query("channel_meta", f"WITH {S_SQL} SELECT channel_id, 10.0::DOUBLE AS rate_hz, count(*) AS len, CAST(round(count(*) / 10.0 * 1000) AS BIGINT) AS duration_ms FROM s GROUP BY channel_id")
def _meta(spark, sf_dir):
    return SessionSet.from_samples(channels(spark, sf_dir), RATE).metadata().select("channel_id", "rate_hz", "len", "duration_ms")


@query("time_base", f"WITH {S_SQL}, m AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM s GROUP BY channel_id)) SELECT CAST(i AS BIGINT) AS idx, i / 10.0::DOUBLE AS value FROM m, range(0, m.n) r(i)")
def _time(spark, sf_dir):
    return synthesis.time_ramp(SessionSet.from_samples(channels(spark, sf_dir), RATE).channels).select("idx", "value")


@query(
    "distance",
    f"""WITH {S_SQL}, m AS (SELECT max(c) AS n FROM (SELECT count(*) AS c FROM s GROUP BY channel_id)), v AS (SELECT idx, value FROM s WHERE channel_id = 'view'),
b AS (SELECT idx, sum(st) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS d FROM (SELECT idx, coalesce((value + lag(value) OVER (ORDER BY idx)) / 3.6 / 2 / 10, 0.0) AS st FROM v))
SELECT CAST(i AS BIGINT) AS idx, round(coalesce(d, (SELECT max(d) FROM b)), 6) AS value FROM m, range(0, m.n) r(i) LEFT JOIN b ON b.idx = i""",
)
def _distance(spark, sf_dir):
    s = channels(spark, sf_dir)
    return synthesis.distance(s, SessionSet.from_samples(s, RATE).channels, "view").select("idx", F.round("value", 6).alias("value"))


_AGG_SQL = {"count": "count(value)::DOUBLE", "sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)"}


@query("agg_basic", f"WITH {S_SQL} SELECT channel_id, " + ", ".join(f"round({v}, 4) AS {k}_value" for k, v in _AGG_SQL.items()) + " FROM s GROUP BY channel_id")
def _agg(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("channel_id").agg(*[F.round(AGGREGATES[k](F.col("value"), F.col("idx")), 4).alias(f"{k}_value") for k in _AGG_SQL])


@query("agg_moments", f"WITH {S_SQL} SELECT channel_id, round(sqrt(avg(value * value)), 6) AS rms_value, round(stddev_pop(value), 6) AS std_value FROM s GROUP BY channel_id")
def _moments(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("channel_id").agg(*[F.round(AGGREGATES[k](F.col("value"), F.col("idx")), 6).alias(f"{k}_value") for k in ("rms", "std")])


@query("agg_quantile", f"WITH {S_SQL} SELECT channel_id, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM s GROUP BY channel_id")
def _quantile(spark, sf_dir):
    out = quantiles.percentiles(channels(spark, sf_dir), ["channel_id"], "value", {"median_value": 50.0, "p5": 5.0, "p95": 95.0})
    return out.select("channel_id", *[F.round(c, 6).alias(c) for c in ("median_value", "p5", "p95")])


@query("agg_first_last", f"WITH {S_SQL} SELECT channel_id, arg_min(value, idx) AS first_value, arg_max(value, idx) AS last_value FROM s GROUP BY channel_id")
def _first_last(spark, sf_dir):
    return channels(spark, sf_dir).groupBy("channel_id").agg(AGGREGATES["first"](F.col("value"), F.col("idx")).alias("first_value"), AGGREGATES["last"](F.col("value"), F.col("idx")).alias("last_value"))


@query("central_diff", f"WITH {S_SQL}, w AS (SELECT channel_id, idx, value, lag(value) OVER o AS a, lead(value) OVER o AS b FROM s WINDOW o AS (PARTITION BY channel_id ORDER BY idx)) SELECT channel_id, idx, round(coalesce((b - a) / 0.2, (b - value) / 0.1, (value - a) / 0.1, 0.0), 6) AS value FROM w")
def _central(spark, sf_dir):
    return series.central_difference(channels(spark, sf_dir), RATE).select("channel_id", "idx", F.round("value", 6).alias("value"))


@query("zupt", f"WITH {g_sql('click', 'view')} SELECT idx, (coalesce(stddev_pop(click) {_W8}, 0.0) < 20 AND avg(view) {_W8} < 25) AS stationary FROM g")
def _zupt(spark, sf_dir):
    g = grid(common(spark, sf_dir, ("click", "view")).samples, ["click", "view"])
    return series.stationary(g, "ch_click", "ch_view", 8, 20.0, 25.0).select("idx", "stationary")


@query(
    "clip_runs",
    f"""WITH {S_SQL}, f AS (SELECT channel_id, idx, abs(value) >= 31.95 AS c FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY idx) - row_number() OVER (PARTITION BY channel_id, c ORDER BY idx) AS k FROM f)
SELECT channel_id, min(idx) AS start, max(idx) AS "end", count(*) AS n FROM q WHERE c GROUP BY channel_id, k""",
)
def _clip(spark, sf_dir):
    return series.clip_runs(channels(spark, sf_dir)).select("channel_id", "start", "end", "n")


@query(
    "runs_close_sustain",
    f"""WITH {S_SQL}, f AS (SELECT channel_id, idx, value > 10 AS c FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY idx) - row_number() OVER (PARTITION BY channel_id, c ORDER BY idx) AS k FROM f),
r AS (SELECT channel_id, c, k, min(idx) AS a, max(idx) AS b, count(*) AS n FROM q GROUP BY channel_id, c, k),
z AS (SELECT *, c OR (n <= 2 AND lag(c) OVER o IS NOT NULL AND lead(c) OVER o IS NOT NULL) AS d FROM r WINDOW o AS (PARTITION BY channel_id ORDER BY a)),
y AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM d THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id ORDER BY a) AS g FROM (SELECT *, lag(d) OVER (PARTITION BY channel_id ORDER BY a) AS p FROM z))
SELECT channel_id, min(a) AS start, max(b) AS "end", CAST(sum(n) AS BIGINT) AS n FROM y WHERE d GROUP BY channel_id, g HAVING sum(n) >= 5""",
)
def _runs(spark, sf_dir):
    r = series.islands(channels(spark, sf_dir), series.KEYS, F.col("value") > 10)
    return series.sustained(series.close_short_gaps(r, series.KEYS, 2), 5).select("channel_id", "start", "end", "n")


@query("slice_time", f"WITH {S_SQL} SELECT channel_id, idx, value FROM s WHERE idx BETWEEN 123 AND 456")
def _slice(spark, sf_dir):
    return series.slice_by_time(channels(spark, sf_dir), 12.3, 45.6, RATE).select("channel_id", "idx", "value")


@query("slice_event", f"WITH {S_SQL} SELECT channel_id, idx, value FROM s WHERE us / 1e6 BETWEEN 1000 AND 500000")
def _slice_event(spark, sf_dir):
    return series.slice_by_time(event_channels(spark, sf_dir), 1000.0, 500000.0, None).select("channel_id", "idx", "value")


@query("slice_lap", f"WITH {S_SQL} SELECT channel_id, CAST(count(*) AS BIGINT) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM s WHERE idx BETWEEN 300 AND 755 GROUP BY channel_id")
def _slice_lap(spark, sf_dir):
    out = series.slice_by_time(channels(spark, sf_dir), *LAPS.bounds[1], RATE)
    return out.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("channel_minmax", f"WITH {S_SQL} SELECT channel_id, min(value) AS min_value, max(value) AS max_value FROM s GROUP BY channel_id")
def _minmax(spark, sf_dir):
    return series.finite_range(channels(spark, sf_dir)).select("channel_id", "min_value", "max_value")


def _points(spark, sf_dir, kind: str) -> DataFrame:
    return event_channels(spark, sf_dir).where(F.col("channel_id") == kind).select("session_id", F.col("idx").alias("point"), "t")


_P = S_SQL + ", p AS (SELECT idx AS point, us / 1e6 AS t FROM s WHERE channel_id = 'view'), c AS (SELECT idx, us / 1e6 AS t, value FROM s WHERE channel_id = 'click')"


@query("join_asof", f"WITH {_P} SELECT p.point, c.value FROM p ASOF LEFT JOIN c ON p.t >= c.t")
def _asof(spark, sf_dir):
    c = event_channels(spark, sf_dir).where("channel_id = 'click'")
    return joins.as_of(_points(spark, sf_dir, "view"), c).select("point", "value")


@query("join_nearest", f"WITH {_P}, a AS (SELECT p.point, p.t, c.t AS bt, c.value AS bv FROM p ASOF LEFT JOIN c ON p.t >= c.t), b AS (SELECT a.*, c.t AS ft, c.value AS fv FROM a ASOF LEFT JOIN c ON a.t <= c.t) SELECT point, CASE WHEN fv IS NULL OR (bv IS NOT NULL AND t - bt <= ft - t) THEN bv ELSE fv END AS value FROM b")
def _nearest(spark, sf_dir):
    c = event_channels(spark, sf_dir).where("channel_id = 'click'")
    return joins.nearest_event(_points(spark, sf_dir, "view"), c).select("point", "value")


@query("join_nearest_fixed", f"WITH {S_SQL}, p AS (SELECT idx AS point, us / 1e6 / 13000 AS t FROM s WHERE channel_id = 'view'), c AS (SELECT idx, value FROM s WHERE channel_id = 'click') SELECT p.point, coalesce(c.value, 'NaN'::DOUBLE) AS value FROM p LEFT JOIN c ON c.idx = CAST(floor(p.t * 10 + 0.5) AS BIGINT)")
def _nearest_fixed(spark, sf_dir):
    p = _points(spark, sf_dir, "view").withColumn("t", F.col("t") / 13000)
    return joins.nearest_fixed(p, channels(spark, sf_dir).where("channel_id = 'click'"), RATE).select("point", "value")


@query("join_lerp", f"WITH {S_SQL}, p AS (SELECT idx AS point, us / 1e6 / 13000 * 10 AS x FROM s WHERE channel_id = 'view'), c AS (SELECT idx, value FROM s WHERE channel_id = 'click') SELECT p.point, round(CASE WHEN x = floor(x) THEN a.value ELSE a.value * (1 - (x - floor(x))) + b.value * (x - floor(x)) END, 6) AS value FROM p LEFT JOIN c a ON a.idx = CAST(floor(x) AS BIGINT) LEFT JOIN c b ON b.idx = CAST(floor(x) AS BIGINT) + 1")
def _lerp(spark, sf_dir):
    p = _points(spark, sf_dir, "view").withColumn("t", F.col("t") / 13000)
    out = joins.interpolate_fixed(p, channels(spark, sf_dir).where("channel_id = 'click'"), RATE)
    return out.select("point", F.round("value", 6).alias("value"))


@query("epoch_to_time", f"WITH {_P}, e AS (SELECT point, t * 1000 AS e FROM p), f AS (SELECT t * 1000 AS e, idx / 5.0 AS s FROM c), a AS (SELECT e.point, e.e, f.e AS be, f.s AS bs FROM e ASOF LEFT JOIN f ON e.e >= f.e), b AS (SELECT a.*, f.e AS fe, f.s AS fs FROM a ASOF LEFT JOIN f ON a.e <= f.e) SELECT point, round(coalesce(bs + (fs - bs) * CASE WHEN fe > be THEN (e - be) / (fe - be) ELSE 0 END, bs, fs), 6) AS t FROM b")
def _epoch(spark, sf_dir):
    e = event_channels(spark, sf_dir)
    f = e.where("channel_id = 'click'").select("session_id", "idx", (F.col("t") * 1000).alias("value"))
    p = e.where("channel_id = 'view'").select("session_id", F.col("idx").alias("point"), (F.col("t") * 1000).alias("epoch_ms"))
    return joins.epoch_to_time(p, f, 5.0).select("point", F.round("t", 6).alias("t"))


@query("interval_join", f"WITH {S_SQL}, w(lap, a, b) AS (VALUES (1::BIGINT, 0.0, 30.0), (2, 30.0, 75.5), (3, 75.5, 120.0)) SELECT channel_id, lap, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN w ON t >= a AND t < b GROUP BY channel_id, lap")
def _interval(spark, sf_dir):
    w = spark.createDataFrame([("s0", i + 1, a, b) for i, (a, b) in enumerate(LAPS.bounds)], "session_id string, lap long, start_s double, end_s double")
    return joins.interval_join(channels(spark, sf_dir), w).groupBy("channel_id", "lap").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("tiles", f"WITH {S_SQL} SELECT channel_id, CAST(idx // 8 // 1024 AS BIGINT) AS tile, CAST(idx // 8 % 1024 AS BIGINT) AS bucket, min(value) AS min_value, max(value) AS max_value FROM s GROUP BY ALL")
def _tiles(spark, sf_dir):
    return series.tiles(channels(spark, sf_dir), 1).select("channel_id", "tile", "bucket", "min_value", "max_value")


@query("tile_pyramid", f"WITH {S_SQL} SELECT channel_id, CAST(idx // 64 // 1024 AS BIGINT) AS tile, CAST(idx // 64 % 1024 AS BIGINT) AS bucket, min(value) AS min_value, max(value) AS max_value FROM s GROUP BY ALL")
def _pyramid(spark, sf_dir):
    return series.tile_pyramid(series.tiles(channels(spark, sf_dir), 1)).select("channel_id", "tile", "bucket", "min_value", "max_value")


def _hist_sql(lo: str, hi: str) -> str:
    return f"""WITH {S_SQL}, m AS (SELECT channel_id, {lo} AS a, {hi} AS b FROM s GROUP BY channel_id), c AS (SELECT s.channel_id, CAST(least(floor((value - a) / (b - a) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM s JOIN m ON s.channel_id = m.channel_id WHERE value >= a AND value <= b GROUP BY ALL)
SELECT m.channel_id, CAST(i AS BIGINT) AS bin, round(a + i * ((b - a) / 20), 6) AS lo, coalesce(c.n, 0) AS n FROM m CROSS JOIN range(0, 20) r(i) LEFT JOIN c ON c.channel_id = m.channel_id AND c.bin = i"""


@query("histogram", _hist_sql("min(value)", "max(value)"))
def _hist(spark, sf_dir):
    return series.histogram(channels(spark, sf_dir), 20).select("channel_id", "bin", F.round("lo", 6).alias("lo"), "n")


@query("histogram_symmetric", _hist_sql("-max(abs(value))", "max(abs(value))"))
def _hist_sym(spark, sf_dir):
    return series.histogram(channels(spark, sf_dir), 20, symmetric=True).select("channel_id", "bin", F.round("lo", 6).alias("lo"), "n")


def _pairs(spark, sf_dir) -> DataFrame:
    s = channels(spark, sf_dir)
    return series.pair_finite(s.where("channel_id = 'click'"), s.where("channel_id = 'view'"))


_XY = S_SQL + ", xy AS (SELECT a.idx, a.value AS x, b.value AS y FROM s a JOIN s b ON a.idx = b.idx AND a.channel_id = 'click' AND b.channel_id = 'view')"


@query("scatter_points", f"WITH {_XY}, k AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n FROM xy) SELECT idx, x, y FROM k WHERE k % CAST(ceil(n / 500.0) AS BIGINT) = 0")
def _scatter(spark, sf_dir):
    return series.scatter_points(_pairs(spark, sf_dir), 500).select("idx", "x", "y")


@query("scatter_density", f"WITH {_XY}, m AS (SELECT least(min(x), min(y)) AS a, greatest(max(x), max(y)) AS b FROM xy), c AS (SELECT CAST(least(floor((y - a) / (b - a) * 16), 15) AS BIGINT) AS r, CAST(least(floor((x - a) / (b - a) * 16), 15) AS BIGINT) AS c, count(*) AS n FROM xy, m GROUP BY ALL) SELECT CAST(i AS BIGINT) AS row, CAST(j AS BIGINT) AS col, coalesce(n, 0) AS n FROM range(0, 16) p(i) CROSS JOIN range(0, 16) q(j) LEFT JOIN c ON c.r = i AND c.c = j")
def _density(spark, sf_dir):
    return series.scatter_density(_pairs(spark, sf_dir), 16, equal_aspect=True).select("row", "col", "n")


@query(
    "fft_mag",
    f"""WITH {g_sql('click')}, m AS (SELECT idx AS i, click * (0.5 - 0.5 * cos(2 * pi() * idx / (n.n - 1))) AS v, n.n AS n FROM g, n)
SELECT CAST(k AS BIGINT) AS idx, round(sqrt(pow(sum(v * cos(2 * pi() * ((i * k) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((i * k) % n) / n)), 2)), 3) AS value FROM m, range(0, (SELECT n FROM n) // 2 + 1) r(k) GROUP BY k""",
)
def _fft(spark, sf_dir):
    out, _, _ = evaluate(common(spark, sf_dir, ("click",)), "fft([click], 'hann')")
    return out.select("idx", F.round("value", 3).alias("value"))


_DFT = S_SQL + """, c AS (SELECT idx, value FROM s WHERE channel_id = 'click'), f AS (SELECT j AS frame FROM range(0, ((SELECT count(*) FROM c) - 128) // 64 + 1) r(j)),
d AS (SELECT frame, c.idx - frame * 64 AS i, value FROM c JOIN f ON c.idx >= frame * 64 AND c.idx < frame * 64 + 128),
h AS (SELECT frame, i, (value - avg(value) OVER (PARTITION BY frame)) * (0.5 - 0.5 * cos(2 * pi() * i / 127)) AS v FROM d),
p AS (SELECT frame, k AS bin, pow(sum(v * cos(2 * pi() * ((i * k) % 128) / 128)), 2) + pow(sum(v * sin(2 * pi() * ((i * k) % 128) / 128)), 2) AS power FROM h, range(0, 65) r(k) GROUP BY frame, k),
w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 127), 2)) AS w FROM range(0, 128) r(i))"""
_SCALE = "/ (10.0 * w.w) * CASE WHEN bin IN (0, 64) THEN 1 ELSE 2 END"


def _click(spark, sf_dir):
    return channels(spark, sf_dir).where("channel_id = 'click'")


@query("spectrogram", f"WITH {_DFT} SELECT CAST(frame AS BIGINT) AS frame, round((frame * 64 + 64) / 10.0, 4) AS t, CAST(bin AS BIGINT) AS bin, round(power {_SCALE}, 4) AS power FROM p, w")
def _spectrogram(spark, sf_dir):
    out = series.spectrogram(_click(spark, sf_dir), RATE, "hann", 128, 64, "mean")
    return out.select("frame", F.round("t", 4).alias("t"), "bin", F.round("power", 4).alias("power"))


@query("welch_mean", f"WITH {_DFT} SELECT CAST(bin AS BIGINT) AS bin, round(avg(power) {_SCALE}, 4) AS power FROM p, w GROUP BY bin, w.w")
def _welch_mean(spark, sf_dir):
    return series.welch(_click(spark, sf_dir), RATE, "hann", 128, 64, "mean").select("bin", F.round("power", 4).alias("power"))


@query("welch_median", f"WITH {_DFT} SELECT CAST(bin AS BIGINT) AS bin, round(median(power) {_SCALE}, 4) AS power FROM p, w GROUP BY bin, w.w")
def _welch_median(spark, sf_dir):
    return series.welch(_click(spark, sf_dir), RATE, "hann", 128, 64, "mean", "median").select("bin", F.round("power", 4).alias("power"))


GATE = laps.Gate(450000000.0, 60010000.0, 450000000.0, 60020000.0)
FINISH = laps.Gate(450000000.0, 59990000.0, 450000000.0, 59980000.0)
SECTOR = laps.Gate(450005000.0, 60000000.0, 450015000.0, 60000000.0)


def _cross_sql(name: str, g: laps.Gate) -> str:
    return f"""{name} AS (SELECT idx, a_ms + CAST(floor(u * (ms - a_ms) + 0.5) AS BIGINT) AS ms FROM (SELECT *, ((a_lat - {g.lat1}) * sy - (a_lon - {g.lon1}) * sx) / nullif({g.lat2 - g.lat1} * sy - {g.lon2 - g.lon1} * sx, 0) AS s, ((a_lat - {g.lat1}) * {g.lon2 - g.lon1} - (a_lon - {g.lon1}) * {g.lat2 - g.lat1}) / nullif({g.lat2 - g.lat1} * sy - {g.lon2 - g.lon1} * sx, 0) AS u FROM st) WHERE s BETWEEN 0 AND 1 AND u > 0 AND u <= 1)"""


_STEPS = X_SQL + ", st AS (SELECT idx, ms, a_ms, a_lat, a_lon, lat - a_lat AS sx, lon - a_lon AS sy FROM (SELECT *, lag(ms) OVER o AS a_ms, lag(lat) OVER o AS a_lat, lag(lon) OVER o AS a_lon FROM x WINDOW o AS (ORDER BY idx)) WHERE a_ms IS NOT NULL), " + _cross_sql("c1", GATE)
_CIRCUIT = _STEPS + ", l AS (SELECT row_number() OVER (ORDER BY idx) AS lap, coalesce(lag(ms) OVER (ORDER BY idx), (SELECT arg_min(ms, idx) FROM x)) AS start_ms, ms AS end_ms FROM c1)"


@query("gate_crossings", f"WITH {_STEPS} SELECT idx, ms FROM c1")
def _crossings(spark, sf_dir):
    return laps.crossings(fixes(spark, sf_dir), {"lap": GATE}).select("idx", "ms")


@query("laps_circuit", f"WITH {_CIRCUIT} SELECT CAST(lap AS BIGINT) AS lap, start_ms, end_ms, end_ms - start_ms AS lap_time_ms FROM l")
def _circuit(spark, sf_dir):
    out = laps.detect_laps(fixes(spark, sf_dir), laps.Layout(laps.Timing("circuit", GATE)))
    return out.select("lap", "start_ms", "end_ms", "lap_time_ms")


@query(
    "laps_p2p",
    f"""WITH {_STEPS}, {_cross_sql("c2", FINISH)}, e AS (SELECT idx, ms, 0 AS k FROM c1 UNION ALL SELECT idx, ms, 1 FROM c2),
a AS (SELECT *, last_value(CASE WHEN k = 0 THEN ms END IGNORE NULLS) OVER o AS s, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER o AS arm FROM e WINDOW o AS (ORDER BY idx, ms, k ROWS UNBOUNDED PRECEDING)),
f AS (SELECT arm, s, min(ms) AS ms FROM a WHERE k = 1 AND s IS NOT NULL AND ms > s GROUP BY arm, s)
SELECT CAST(row_number() OVER (ORDER BY ms) AS BIGINT) AS lap, s AS start_ms, ms AS end_ms FROM f""",
)
def _p2p(spark, sf_dir):
    return laps.point_to_point_laps(fixes(spark, sf_dir), GATE, FINISH).select("lap", "start_ms", "end_ms")


@query(
    "sectors",
    f"""WITH {_CIRCUIT}, {_cross_sql("c2", SECTOR)}, b AS (SELECT lap, start_ms, end_ms, (SELECT min(c2.ms) FROM c2 JOIN st ON st.idx = c2.idx WHERE st.a_ms >= l.start_ms AND st.ms <= l.end_ms) AS m FROM l)
SELECT CAST(lap AS BIGINT) AS lap, 0::BIGINT AS sector, 'first' AS name, start_ms, coalesce(m, end_ms) AS end_ms FROM b UNION ALL SELECT CAST(lap AS BIGINT), 1, 'S2', m, end_ms FROM b WHERE m IS NOT NULL""",
)
def _sectors(spark, sf_dir):
    f = fixes(spark, sf_dir)
    return laps.sectors(f, laps.circuit_laps(f, GATE), (("first", SECTOR),)).select("lap", "sector", "name", "start_ms", "end_ms")


@query("neutral_zones", f"""WITH {_CIRCUIT}, {_cross_sql("e", SECTOR)}, {_cross_sql("q", FINISH)}, v AS (SELECT l.lap, e.ms AS enter_ms, min(q.ms) AS exit_ms FROM l JOIN e ON e.ms BETWEEN start_ms AND end_ms JOIN q ON q.ms BETWEEN start_ms AND end_ms AND q.ms > e.ms GROUP BY l.lap, e.ms) SELECT CAST(lap AS BIGINT) AS lap, enter_ms, exit_ms FROM v""")
def _zones(spark, sf_dir):
    f = fixes(spark, sf_dir)
    return laps.neutral_visits(f, laps.circuit_laps(f, GATE), (laps.Zone("z", SECTOR, FINISH),)).select("lap", "enter_ms", "exit_ms")


@query("haversine", f"""WITH {X_SQL}, r AS (SELECT idx, radians(lat * 1e-7) AS p, radians(lon * 1e-7) AS l FROM x), d AS (SELECT idx, p, l, lag(p) OVER o AS p0, lag(l) OVER o AS l0 FROM r WINDOW o AS (ORDER BY idx)),
h AS (SELECT idx, pow(sin((p - p0) / 2), 2) + cos(p0) * cos(p) * pow(sin((l - l0) / 2), 2) AS a FROM d) SELECT idx, round(sum(coalesce(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 0.0)) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 2) AS distance_m FROM h""")
def _haversine(spark, sf_dir):
    return laps.cumulative_distance(fixes(spark, sf_dir)).select("idx", F.round("distance_m", 2).alias("distance_m"))


TRACK = [(450000000.0, 60015000.0), (450007071.0, 60010606.0), (450010000.0, 60000000.0)]


@query(
    "visits",
    f"""WITH {X_SQL}, z AS (SELECT 111320.0 / 1e7 AS m, abs(cos((min(lat) + max(lat)) / 2 / 1e7 * pi() / 180)) * 111320.0 / 1e7 AS s FROM x),
seg(a1, b1, a2, b2) AS (VALUES ({TRACK[0][0]}, {TRACK[0][1]}, {TRACK[1][0]}, {TRACK[1][1]}), ({TRACK[1][0]}, {TRACK[1][1]}, {TRACK[2][0]}, {TRACK[2][1]})),
q AS (SELECT idx, ms, lat * m AS px, lon * s AS py, a1 * m AS ax, b1 * s AS ay, (a2 - a1) * m AS dx, (b2 - b1) * s AS dy FROM x, z, seg),
d AS (SELECT idx, ms, min(pow(px - ax - u * dx, 2) + pow(py - ay - u * dy, 2)) AS d FROM (SELECT *, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0) AS u FROM q) GROUP BY idx, ms),
o AS (SELECT idx, ms, d < 9.0 AS c FROM d), g AS (SELECT *, row_number() OVER (ORDER BY idx) - row_number() OVER (PARTITION BY c ORDER BY idx) AS k FROM o)
SELECT 't1' AS track_id, min(ms) AS start_ms, max(ms) AS end_ms FROM g WHERE c GROUP BY k HAVING max(ms) - min(ms) >= 30000""",
)
def _visits(spark, sf_dir):
    return tracks.visits(fixes(spark, sf_dir), {"t1": TRACK}, threshold_m=3.0).select("track_id", "start_ms", "end_ms")


_CELLS = {"mean_click": ("mean", "click"), "max_view": ("max", "view"), "rms_error": ("rms", "error"), "n_signup": ("count", "signup"), "median_purchase": ("median", "purchase")}


@query(
    "lap_table",
    f"""WITH {S_SQL}, w(lap, a, b) AS (VALUES (1::BIGINT, 0, 300), (2, 300, 755), (3, 755, 1200)) SELECT lap, round(avg(value) FILTER (channel_id = 'click'), 6) AS mean_click, max(value) FILTER (channel_id = 'view') AS max_view,
round(sqrt(avg(value * value) FILTER (channel_id = 'error')), 6) AS rms_error, count(*) FILTER (channel_id = 'signup')::DOUBLE AS n_signup, round(quantile_cont(value, 0.5) FILTER (channel_id = 'purchase'), 6) AS median_purchase FROM s JOIN w ON idx BETWEEN a AND b GROUP BY lap""",
)
def _lap_table(spark, sf_dir):
    w = spark.createDataFrame([("s0", i + 1, a, b) for i, (a, b) in enumerate(LAPS.bounds)], "session_id string, lap long, start_s double, end_s double")
    out = tables.aggregate_by_lap(SessionSet(channels(spark, sf_dir), None), w, _CELLS, RATE)
    return out.select("lap", *[F.round(c, 6).alias(c) if c[:2] in ("me", "rm") else F.col(c) for c in _CELLS])


@query("overlay_samples", f"WITH {S_SQL}, c AS (SELECT idx, value FROM s WHERE channel_id = 'click'), f AS (SELECT CAST(i AS BIGINT) AS frame, (1.0 + i / 30.0 + 2.5) * 10 AS x FROM range(0, 600) r(i)) SELECT frame, round(a.value * (1 - (x - floor(x))) + b.value * (x - floor(x)), 5) AS value FROM f JOIN c a ON a.idx = floor(x) JOIN c b ON b.idx = floor(x) + 1")
def _overlay(spark, sf_dir):
    frames = overlay.frame_clock(spark, "s0", 30.0, 20.0, 1.0, 2.5)
    return overlay.gauge(frames, _click(spark, sf_dir), RATE).select("frame", F.round("value", 5).alias("value"))


@query("lap_panel", """WITH f AS (SELECT CAST(i AS BIGINT) AS frame, i / 2.0 AS t FROM range(0, 300) r(i)), l(n, a, b, ms) AS (VALUES (1::BIGINT, 0.0, 30.0, 30000::BIGINT), (2, 30.0, 75.5, 45500), (3, 75.5, 120.0, 44500))
SELECT frame, max(CASE WHEN t >= a AND t < b THEN n END) AS current_lap, round(coalesce(max(CASE WHEN t >= a AND t < b THEN t - a END), 0.0), 6) AS lap_elapsed_s, arg_max(ms, n) FILTER (t >= b) AS last_lap_ms, min(ms) FILTER (t >= b) AS best_lap_ms FROM f CROSS JOIN l GROUP BY frame""")
def _panel(spark, sf_dir):
    frames = overlay.frame_clock(spark, "s0", 2.0, 150.0)
    out = overlay.lap_panel(frames, [(i + 1, a, b, int((b - a) * 1000)) for i, (a, b) in enumerate(LAPS.bounds)])
    return out.select("frame", "current_lap", F.round("lap_elapsed_s", 6).alias("lap_elapsed_s"), "last_lap_ms", "best_lap_ms")


def _imu(spark, sf_dir) -> DataFrame:
    """Events as inertial records of two units, about one a minute with drops."""
    e = _events(spark, sf_dir)
    return e.select(F.lit("s0").alias("session_id"), (F.col("user_id") % 2).cast("int").alias("imu"), F.col("event_id").alias("seq"), F.col("us").alias("ts_us"), F.floor("value").alias("raw"))


_SLOT = """r AS (SELECT CAST(user_id % 2 AS INT) AS imu, event_id AS seq, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, floor(value) AS raw FROM events),
p AS (SELECT imu, seq, us, raw, first_value(us) OVER (PARTITION BY imu ORDER BY seq) AS f, CAST(floor((us - first_value(us) OVER (PARTITION BY imu ORDER BY seq)) / 120000000.0 + 0.5) AS BIGINT) AS slot FROM r),
k AS (SELECT *, max(slot) OVER (PARTITION BY imu ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM p)"""


@query("drop_report", f"WITH {_SLOT}, m AS (SELECT *, h IS NULL OR slot > h AS kept, CASE WHEN slot > h THEN slot - h - 1 ELSE 0 END AS miss FROM k) SELECT imu, count(*) AS received, count(*) FILTER (kept) AS kept, count(*) FILTER (slot = h) AS collisions, count(*) FILTER (slot < h) AS backsteps, CAST(sum(miss) AS BIGINT) AS fills, count(*) FILTER (miss = 1) AS gaps_1, count(*) FILTER (miss BETWEEN 2 AND 3) AS gaps_2_3, count(*) FILTER (miss BETWEEN 4 AND 9) AS gaps_4_9, count(*) FILTER (miss BETWEEN 10 AND 49) AS gaps_10_49, count(*) FILTER (miss >= 50) AS gaps_50 FROM m GROUP BY imu")
def _drops(spark, sf_dir):
    return synthesis.drop_report(_imu(spark, sf_dir), 120_000_000).drop("session_id")


@query(
    "gap_fill",
    f"""WITH {_SLOT}, j AS (SELECT imu, raw, slot + CAST(floor((f - min(f) OVER ()) / 120000000.0 + 0.5) AS BIGINT) AS i FROM k WHERE h IS NULL OR slot > h), n AS (SELECT max(i) + 1 AS n FROM j),
w AS (SELECT imu, i, raw, lead(i) OVER o AS ni, lead(raw) OVER o AS nv, lag(i) OVER o AS pi FROM j WINDOW o AS (PARTITION BY imu ORDER BY i))
SELECT imu, CAST(q AS BIGINT) AS idx, CASE WHEN q <= i OR ni IS NULL THEN raw ELSE floor(raw + (nv - raw) * ((q - i) / (ni - i)::DOUBLE) + 0.5) END AS value FROM w, n, LATERAL (SELECT unnest(range(CASE WHEN pi IS NULL THEN 0 ELSE i END, coalesce(ni, n.n))) AS q)""",
)
def _fill(spark, sf_dir):
    placed = synthesis.place_slots(_imu(spark, sf_dir), 120_000_000).where("kept")
    made, _ = synthesis.rebuild_imu_grid(placed.withColumn("channel_id", F.concat(F.lit("IMU"), F.col("imu"), F.lit("_AccelX"))), 120_000_000)
    return made.select(F.substring("channel_id", 4, 1).cast("int").alias("imu"), "idx", "value")


@query("sag_stats", f"WITH {S_SQL}, r AS (SELECT channel_id, value, row_number() OVER (PARTITION BY channel_id ORDER BY value) AS r, count(*) OVER (PARTITION BY channel_id) AS n FROM s) SELECT channel_id, n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, max(value) FILTER (r = ceil(0.05 * n)) AS q05, max(value) FILTER (r = ceil(0.95 * n)) AS q95 FROM r GROUP BY channel_id, n")
def _sag(spark, sf_dir):
    out = synthesis.sag_stats(channels(spark, sf_dir), "channel_id")
    return out.select("channel_id", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "q05", "q95")


def _butter_sql(order: int, cutoff: float, high: bool) -> str:
    """Forwards and backwards through two sections, sample by sample, over the odd-extended channel. The sections are written
    from the quality factors of a Butterworth filter's pole pairs."""
    w, sign = 2 * math.pi * cutoff / RATE, -1.0 if high else 1.0
    made = []
    for k in range(order // 2):
        q = 1 / (2 * math.cos(math.pi * (2 * k + 1) / (2 * order))) if order % 2 == 0 else 1 / (2 * math.cos(math.pi * (k + 1) / order))
        alpha = math.sin(w) / (2 * q)
        b0 = (1 - sign * math.cos(w)) / 2 / (1 + alpha)
        made.append((b0, 2 * sign * b0, b0, -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)))
    if order % 2:
        t = math.tan(w / 2)
        made.append((1 / (1 + t), -1 / (1 + t), 0.0, (t - 1) / (t + 1), 0.0) if high else (t / (1 + t), t / (1 + t), 0.0, (t - 1) / (t + 1), 0.0))
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = made
    pad = 3 * (5 - order % 2)
    g = (b0 + b1 + b2) / (1 + a1 + a2)
    h = (c0 + c1 + c2) / (1 + d1 + d2)

    def run(name: str, source: str) -> str:
        first = f"SELECT 0 AS i, {g - b0!r} * x[1] AS z1, {b2 - a2 * g!r} * x[1] AS z2, {(h - c0) * g!r} * x[1] AS w1, {(c2 - d2 * h) * g!r} * x[1] AS w2, 0.0::DOUBLE AS y FROM {source}"
        one = f"SELECT i + 1 AS i, x[i + 1] AS v, {b0!r} * x[i + 1] + z1 AS r, z1, z2, w1, w2 FROM {name}, {source} WHERE i < len(x)"
        two = f"SELECT *, {c0!r} * r + w1 AS y FROM ({one})"
        return f"{name} AS ({first} UNION ALL SELECT i, {b1!r} * v - {a1!r} * r + z2, {b2!r} * v - {a2!r} * r, {c1!r} * r - {d1!r} * y + w2, {c2!r} * r - {d2!r} * y, y FROM ({two}))"

    return f"""WITH RECURSIVE {S_SQL}, c AS (SELECT list(value ORDER BY idx) AS v, CAST(count(*) AS INTEGER) AS n FROM s WHERE channel_id = 'click'),
e AS MATERIALIZED (SELECT list_concat(list_concat(list_transform(range({pad}, 0, -1), lambda j: 2 * v[1] - v[j + 1]), v), list_transform(range(1, {pad + 1}), lambda j: 2 * v[n] - v[n - j])) AS x FROM c),
{run("f", "e")}, m AS MATERIALIZED (SELECT list(y ORDER BY i DESC) AS x FROM f WHERE i > 0), {run("k", "m")},
o AS (SELECT (SELECT len(x) FROM m) - i AS j, y FROM k WHERE i > 0) SELECT CAST(j - {pad} AS BIGINT) AS idx, round(y, 6) + 0.0 AS value FROM o, c WHERE j >= {pad} AND j < {pad} + n"""


@query("butter_low", _butter_sql(4, 1.5, False))
def _butter_low(spark, sf_dir):
    return evaluate(common(spark, sf_dir, ("click",)), "butter(4, 1.5, 'low', [click])")[0].select("idx", F.round("value", 6).alias("value"))


@query("butter_high", _butter_sql(3, 0.5, True))
def _butter_high(spark, sf_dir):
    return evaluate(common(spark, sf_dir, ("click",)), "butter(3, 0.5, 'high', [click])")[0].select("idx", F.round("value", 6).alias("value"))


@query("declip")
def _declip(spark, sf_dir):
    return evaluate(common(spark, sf_dir, ("click",)), "declip(clamp([click], -32, 32))")[0].select("idx", "value")


@query("suspension")
def _suspension(spark, sf_dir):
    from .operators.suspension import suspension

    s = channels(spark, sf_dir)
    parts = (("click", "IMU0_AccelX", 0.001), ("view", "IMU0_AccelY", 0.001), ("signup", "IMU0_AccelZ", 0.01), ("error", "IMU1_AccelX", 0.001), ("purchase", "IMU1_AccelZ", 0.01))
    made = None
    for kind, name, scale in parts:
        one = s.where(F.col("channel_id") == kind).select("session_id", F.lit(name).alias("channel_id"), "idx", "t", (F.col("value") * scale).alias("value"))
        made = one if made is None else made.unionByName(one)
    return suspension(SessionSet.from_samples(made, RATE)).select("channel_id", "idx", "value")


#: Laps of 500 fixes in the frame of the first: v as read, p in metres with the heading to the next fix (the last: from it to
#: the one before), a with the length of the way.
_LOOPS = X_SQL + """, v AS (SELECT idx // 500 + 1 AS lap, row_number() OVER (PARTITION BY idx // 500 ORDER BY idx) - 1 AS i, lat / 1e7 AS la, lon / 1e7 AS lo, value FROM x JOIN events ON event_id = idx),
f AS (SELECT arg_min(la, i) AS la0, arg_min(lo, i) AS lo0, 111320.0 * cos(avg(la) * pi() / 180) AS sc FROM v WHERE lap = 1),
q AS (SELECT lap, i, value, (lo - lo0) * sc AS e, (la - la0) * 111320.0 AS n FROM v, f),
p AS (SELECT *, coalesce(atan2(lead(n) OVER o - n, lead(e) OVER o - e), atan2(lag(n) OVER o - n, lag(e) OVER o - e)) AS h, coalesce(sqrt(pow(n - lag(n) OVER o, 2) + pow(e - lag(e) OVER o, 2)), 0) AS step FROM q WINDOW o AS (PARTITION BY lap ORDER BY i)),
a AS (SELECT *, sum(step) OVER (PARTITION BY lap ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM p)"""


@query(
    "variance_dist",
    f"""WITH {_LOOPS}, r AS (SELECT s AS s0, value AS v0, lead(s) OVER (ORDER BY i) AS s1, lead(value) OVER (ORDER BY i) AS v1, max(s) OVER () AS last FROM a WHERE lap = 1)
SELECT CAST(lap AS BIGINT) AS lap, CAST(i AS BIGINT) AS idx, round(CASE WHEN s > last THEN 'NaN'::DOUBLE WHEN s1 IS NULL THEN value - v0 ELSE value - (v0 + (v1 - v0) * (s - s0) / (s1 - s0)) END, 6) + 0.0 AS value FROM (SELECT * FROM a WHERE lap > 1) a ASOF JOIN r ON a.s >= r.s0""",
)
def _variance_dist(spark, sf_dir):
    return _variance(spark, sf_dir, "variance_dist")


@query(
    "variance_time",
    f"""WITH RECURSIVE {_LOOPS}, c AS MATERIALIZED (SELECT i, value FROM p WHERE lap = 1), g AS MATERIALIZED (SELECT i AS k, e, n, lead(e) OVER o - e AS de, lead(n) OVER o - n AS dn FROM p WHERE lap = 1 WINDOW o AS (ORDER BY i)),
s AS MATERIALIZED (SELECT *, de * de + dn * dn AS sq, atan2(dn, de) AS hd FROM g WHERE de IS NOT NULL AND de * de + dn * dn >= 1e-12), m AS MATERIALIZED (SELECT lap, i, e, n, h, value FROM p WHERE lap > 1),
z AS (SELECT m.lap, m.i, s.k, least(greatest(((m.e - s.e) * de + (m.n - s.n) * dn) / sq, 0), 1) AS u, m.e AS pe, m.n AS pn, s.e, s.n, de, dn FROM m JOIN s ON m.i = 0 AND cos(m.h - hd) >= 0),
w AS (SELECT lap, i, CAST(arg_min(k, d) AS BIGINT) AS last, arg_min(k + u, d) AS place FROM (SELECT *, pow(pe - e - u * de, 2) + pow(pn - n - u * dn, 2) AS d FROM z) GROUP BY lap, i
UNION ALL SELECT lap, i, CAST(coalesce(arg_min(k, d), any_value(last)) AS BIGINT), arg_min(k + u, d) FROM (SELECT *, pow(pe - e - u * de, 2) + pow(pn - n - u * dn, 2) AS d FROM (SELECT m.lap, m.i, w.last, s.k, least(greatest(((m.e - s.e) * de + (m.n - s.n) * dn) / sq, 0), 1) AS u, m.e AS pe, m.n AS pn, s.e, s.n, de, dn FROM w JOIN m ON m.lap = w.lap AND m.i = w.i + 1 LEFT JOIN s ON s.k BETWEEN w.last - 10 AND w.last + 10 AND cos(m.h - hd) >= 0)) GROUP BY lap, i)
SELECT CAST(m.lap AS BIGINT) AS lap, CAST(m.i AS BIGINT) AS idx, round(coalesce(m.value - CASE WHEN place = floor(place) THEN a.value ELSE a.value * (1 - (place - floor(place))) + b.value * (place - floor(place)) END, 'NaN'::DOUBLE), 4) + 0.0 AS value FROM m LEFT JOIN w ON w.lap = m.lap AND w.i = m.i LEFT JOIN c a ON a.i = CAST(floor(place) AS BIGINT) LEFT JOIN c b ON b.i = CAST(floor(place) AS BIGINT) + 1""",
)
def _variance_time(spark, sf_dir):
    return _variance(spark, sf_dir, "variance_time")


def _variance(spark, sf_dir, mode: str) -> DataFrame:
    """(lap, idx, value): every later loop of 500 fixes against the first, for a channel made from the events' values.
    Laps count from 1, idx from a lap's start; the last lap may be short."""
    from .operators.variance import Overlay, variance

    e = _events(spark, sf_dir).select("event_id", "value")
    f = fixes(spark, sf_dir).join(e, F.col("idx") == F.col("event_id"))
    lap, at = F.floor(F.col("idx") / 500) + 1, F.col("idx") % 500
    parts = (("GPS_Latitude", "lat"), ("GPS_Longitude", "lon"), ("GPS_EpochMs", "timestamp_ms"), ("Fork", "value"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("channel_id"), F.col(col).cast("double").alias("value")) for name, col in parts]))
    made = f.select(lap.cast("string").alias("session_id"), at.alias("idx"), (at / RATE).alias("t"), each.alias("c")).select("session_id", "c.channel_id", "idx", "t", "c.value")
    data = SessionSet.from_samples(made, RATE)
    other = SessionSet(data.samples.where("session_id <> '1'"), data.channels.where("session_id <> '1'"))
    out = variance(other, "Fork", RATE, Overlay(data, "1", (float("-inf"), float("inf")), 0.0), (0.0, 0.0), mode)
    return out.select(F.col("session_id").cast("long").alias("lap"), "idx", F.round("value", 6 if mode == "variance_dist" else 4).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_files  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_files  # noqa: F401

    return dict(_SQL)
