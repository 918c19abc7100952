"""Compiler of channel expressions to Catalyst.

A tree compiles onto a grid frame (session_id, idx, a column per referenced channel). Element-wise nodes
become columns; rolling and cumulative nodes become blocked windows; an aggregate becomes one grouped
aggregation joined back by session; filters, spectra and clip repair are Arrow kernels per session.
Rates, lengths, arities and types are checked at plan time. What depends on data (a zero divisor
anywhere, a missing branch sample) is collected as checks, which run as one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError
from ..functions import scalar as S
from ..functions import vector as V
from ..functions.aggregate import AGGREGATES, percentile
from ..kernels import declip, filters, spectral
from ..model import SessionSet, column_name, grid
from ..operators.blocked import running_sum, windowed
from .syntax import Binary, Call, Cell, Num, Ref, Text, Unary, bracket_references, parse, references


@dataclass(frozen=True)
class Chan:
    col: Column
    rate: float
    length: object  # a token: channels of equal tokens have equal lengths
    name: str | None = None  # of a direct reference


@dataclass(frozen=True)
class Scal:
    col: Column
    value: float | None = None  # where it is known at plan time


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Vec3:
    vec: V.Vec
    rate: float
    length: object


@dataclass
class LapContext:
    """What lap-aware functions see: (start_s, end_s) of laps, sector windows, and the row of the table's main lap."""

    bounds: list[tuple[float, float]] = field(default_factory=list)
    sectors: list[tuple[float, float]] = field(default_factory=list)
    baseline_row: int | None = None
    main_lap: int | None = None
    overlay: object = None  # operators.variance.Overlay


_KIND = {Chan: "channel", Scal: "scalar", Str: "string", Vec3: "vector"}
_DEFERRED = ("spectrogram", "hilbert", "correlate", "convolve", "resample", "sosfilt")
_VECTOR = {"vec": 3, "vx": 1, "vy": 1, "vz": 1, "vadd": 2, "vsub": 2, "vscale": 2, "cross": 2, "dot": 2, "norm": 1, "normalize": 1, "angle": 2, "rotate_mat": 10, "rotate_axis": 5, "rotate_euler": 4}


class Compiler:
    def __init__(self, data: SessionSet, laps: LapContext | None = None):
        self.data, self.laps = data, laps or LapContext()
        self.frame: DataFrame | None = None
        self.checks: list[tuple[str, str, Column]] = []
        self.n = 0
        self.have: dict[str, Chan] = {}

    # ---- frame ----
    def load(self, tree) -> None:
        """Build the grid of the channels that the tree refers to (base and derived)."""
        names = references(tree)
        info = self.data.load_info()
        if _calls(tree) & {"current_lap", "sector_number"} or not names:
            names = [*names, *[n for n in ([self.time_base()] if info else []) if n not in names]]
        if "lap_start_distance" in _calls(tree) and "Distance" in info and "Distance" not in names:
            names.append("Distance")
        for name in names:
            if name not in info and name not in self.data.derived:
                raise EvalError("unknown_channel", f"no channel [{name}]")
        base = [n for n in names if n in info]
        frames = [grid(self.data.samples, base)] if base else []
        for name in (n for n in names if n not in info):
            frames.append(self.data.derived[name].select("session_id", "idx", F.col("value").alias(column_name(name))))
        frame = frames[0]
        for other in frames[1:]:
            frame = frame.join(other, ["session_id", "idx"], "full")
        self.frame = frame
        for name in names:
            known = info.get(name)
            rate = known.rate if known else self.data.derived_info[name][0] if hasattr(self.data, "derived_info") else 0.0
            token = name if known else self.data.derived_info[name][1] if hasattr(self.data, "derived_info") else name
            self.have[name] = Chan(F.col(column_name(name)), rate, token, name)

    def time_base(self) -> str:
        """The channel whose length and rate lap functions use: Time, else the longest."""
        info = self.data.load_info()
        if "Time" in info:
            return "Time"
        return max(sorted(info), key=lambda n: info[n].length or 0)

    def keep(self, col: Column) -> Column:
        self.n += 1
        name = f"x{self.n}"
        self.frame = self.frame.withColumn(name, col)
        return F.col(name)

    def per_session(self, col: Column) -> Column:
        """An aggregate of the frame, joined back by session."""
        self.n += 1
        name = f"x{self.n}"
        self.frame = self.frame.join(self.frame.groupBy("session_id").agg(col.alias(name)), "session_id")
        return F.col(name)

    def kernel(self, arg: Chan, fn, shorter: bool = False) -> Column:
        """fn(samples) -> samples by session, over the samples in order; one channel of a session is one group."""
        v = self.keep(arg.col)
        self.n += 1
        name = f"x{self.n}"

        def run(table: pa.Table) -> pa.Table:
            t = table.sort_by("idx")
            out = fn(t["v"].to_numpy())
            return pa.table({"session_id": t["session_id"].slice(0, len(out)), "idx": t["idx"].slice(0, len(out)), name: pa.array(out)})

        made = self.frame.where(v.isNotNull()).select("session_id", "idx", v.alias("v")).groupBy("session_id").applyInArrow(run, f"session_id string, idx long, {name} double")
        self.frame = self.frame.join(made, ["session_id", "idx"], "left")
        return F.col(name)

    def declipped(self, arg: Chan) -> Column:
        """A channel with its pinned runs repaired: one task of a session finds them, all tasks share their fits."""
        v = self.keep(arg.col)
        self.n += 1
        name = f"x{self.n}"

        def find(table: pa.Table) -> pa.Table:
            t = table.sort_by("idx")
            x, idx = t["v"].to_numpy(), t["idx"].to_numpy()
            found = list(declip.windows(x))
            longs = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
            places = pa.array([idx[a : b + 1] for _, a, b, _ in found], pa.list_(pa.int64()))
            return pa.table([pa.array([t["session_id"][0].as_py()] * len(found), pa.string()), pa.array([len(x)] * len(found), pa.int64()), *longs, places, pa.array([r[3] for r in found], pa.list_(pa.float64()))], names=["session_id", "n", "lo", "a", "b", "idx", "x"])

        def mend(batches):
            for batch in batches:
                rows = batch.to_pylist()
                made = [declip.repair(np.array(r["x"]), r["lo"], r["n"], r["a"], r["b"]) for r in rows]
                sessions = [r["session_id"] for r in rows for _ in r["idx"]]
                yield pa.RecordBatch.from_arrays([pa.array(sessions, pa.string()), pa.array([i for r in rows for i in r["idx"]], pa.int64()), pa.array([y for m in made for y in m.tolist()], pa.float64())], ["session_id", "idx", name])

        runs = self.frame.where(v.isNotNull()).select("session_id", "idx", v.alias("v")).groupBy("session_id").applyInArrow(find, "session_id string, n long, lo long, a long, b long, idx array<long>, x array<double>")
        tasks = max(runs.sparkSession.sparkContext.defaultParallelism, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        made = runs.repartition(tasks).mapInArrow(mend, f"session_id string, idx long, {name} double")
        self.frame = self.frame.join(made, ["session_id", "idx"], "left")
        return F.coalesce(F.col(name), v)

    # ---- values ----
    def same_grid(self, a, b, what: str) -> None:
        if a.rate != b.rate:
            raise EvalError("runtime", f"{what}: sample rates differ ({a.rate} and {b.rate})")
        if a.length == b.length:
            return
        x, y = a.length, b.length
        while isinstance(x, tuple) and isinstance(y, tuple):
            x, y = x[1], y[1]
        if isinstance(x, tuple) or isinstance(y, tuple) or not self.data.same_length(x, y):
            raise EvalError("runtime", f"{what}: lengths differ")

    def shape(self, *args, what: str):
        """(rate, length) of the channels among args, which must agree; None without any."""
        own = [a for a in args if isinstance(a, (Chan, Vec3)) and a.length is not None]
        for other in own[1:]:
            self.same_grid(own[0], other, what)
        return (own[0].rate, own[0].length) if own else None

    def wrap(self, col: Column, shape, value: float | None = None):
        return Scal(col, value) if shape is None else Chan(self.keep(col), *shape)

    def elementwise(self, what: str, f, *args):
        for a in args:
            if not isinstance(a, (Chan, Scal)):
                raise EvalError("type", f"{what}: expected a channel or scalar, got a {_KIND[type(a)]}")
        return self.wrap(f(*[a.col for a in args]), self.shape(*args, what=what))

    def channel(self, a, what: str) -> Chan:
        if not isinstance(a, Chan):
            raise EvalError("type", f"{what}: expected a channel, got a {_KIND[type(a)]}")
        return a

    def constant(self, a, what: str) -> float:
        """A scalar's value at plan time; one that depends on data is computed, and must be equal in all sessions."""
        if not isinstance(a, Scal):
            raise EvalError("type", f"{what}: expected a scalar, got a {_KIND[type(a)]}")
        if a.value is not None:
            return a.value
        found = self.frame.select(a.col.alias("v")).distinct().limit(2).collect()
        if len(found) != 1:
            raise EvalError("runtime", f"{what}: the value differs between sessions")
        return found[0][0]

    def string(self, a, what: str) -> str:
        if not isinstance(a, Str):
            raise EvalError("type", f"{what}: expected a string, got a {_KIND[type(a)]}")
        return a.value

    def vec(self, a, what: str) -> Vec3:
        if not isinstance(a, Vec3):
            raise EvalError("type", f"{what}: expected a vector, got a {_KIND[type(a)]}")
        return a

    # ---- nodes ----
    def node(self, tree):
        if isinstance(tree, Num):
            return Scal(F.lit(tree.value), tree.value)
        if isinstance(tree, Text):
            return Str(tree.value)
        if isinstance(tree, Ref):
            return self.have[tree.name]
        if isinstance(tree, Cell):
            raise EvalError("runtime", f"{{{tree.body}}} is only known inside a table")
        if isinstance(tree, Unary):
            a = self.node(tree.arg)
            if tree.op == "-":
                if isinstance(a, Scal) and a.value is not None:
                    return Scal(F.lit(-a.value), -a.value)
                return self.elementwise("-", S.negate, a)
            return self.elementwise("not", lambda x: S._present(S.truth(~S.nonzero(x)), x), a)
        if isinstance(tree, Binary):
            return self.binary(tree.op, self.node(tree.left), self.node(tree.right))
        return self.call(tree.name, tree.args)

    def binary(self, op: str, a, b):
        if op in ("and", "or"):
            return self.elementwise(op, lambda x, y: S.logical(op, x, y), a, b)
        if op in ("<", ">", "<=", ">=", "==", "!="):
            return self.elementwise(op, lambda x, y: S.compare(op, x, y), a, b)
        if op == "/":
            if isinstance(b, Scal) and b.value is not None:
                if b.value == 0:
                    raise EvalError("division_by_zero", "division by zero")
            elif isinstance(b, (Chan, Scal)):
                self.checks.append(("division_by_zero", "division by zero", b.col == 0.0))
            out = self.elementwise("/", lambda x, y: x / F.when(y != 0.0, y), a, b)
            value = a.value / b.value if isinstance(a, Scal) and isinstance(b, Scal) and a.value is not None and b.value is not None else None
            return Scal(F.lit(value), value) if value is not None else out
        fold = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
        if isinstance(a, Scal) and isinstance(b, Scal) and a.value is not None and b.value is not None:
            return Scal(F.lit(fold(a.value, b.value)), fold(a.value, b.value))
        return self.elementwise(op, fold, a, b)

    def call(self, name: str, trees: tuple):
        if name in _DEFERRED:
            raise EvalError("not_implemented", f"not yet implemented: {name}")
        args = [self.node(t) for t in trees]
        n = len(args)

        def arity(*allowed: int) -> None:
            if n not in allowed:
                raise EvalError("arg_count", f"{name}() takes {' or '.join(map(str, allowed))} arguments, got {n}")

        if name in S.UNARY:
            arity(1)
            return self.elementwise(name, S.UNARY[name], *args)
        if name in ("mean", "rms", "std") and n == 2:
            return self.rolling(name, self.channel(args[0], name), self.constant(args[1], f"{name} window"))
        if name in ("min", "max") and n == 2:
            return self.elementwise(name, S.BINARY[name], *args)
        if name == "median" and n != 1:
            raise EvalError("not_implemented", "not yet implemented: median")
        if name in AGGREGATES:
            arity(*((1, 2) if name in ("mean", "rms", "std", "min", "max") else (1,)))
            ch = self.channel(args[0], name)
            return Scal(self.per_session(AGGREGATES[name](ch.col, F.col("idx"))))
        if name == "p":
            arity(2)
            ch, q = self.channel(args[0], name), self.constant(args[1], "p quantile")
            if not 0 <= q <= 100:
                raise EvalError("runtime", f"p quantile {q} is not in 0..100")
            return Scal(self.per_session(percentile(ch.col, q)))
        if name == "main":
            arity(1)
            return self.main(self.channel(args[0], name))
        if name in ("pow", "atan2"):
            arity(2)
            return self.elementwise(name, S.BINARY[name], *args)
        if name == "clamp":
            arity(3)
            ch = self.channel(args[0], name)
            lo, hi = (self.constant(a, f"clamp {k}") for a, k in zip(args[1:], ("low", "high"), strict=True))
            if not lo <= hi:
                raise EvalError("runtime", f"clamp bounds {lo} and {hi} are out of order")
            return Chan(self.keep(S.clamp(ch.col, F.lit(lo), F.lit(hi))), ch.rate, ch.length)
        if name == "if":
            arity(3)
            cond = self.channel(args[0], "if condition")
            for a in args[1:]:
                if not isinstance(a, (Chan, Scal)):
                    raise EvalError("type", f"if: a branch is a {_KIND[type(a)]}")
            pick = F.when(S.nonzero(cond.col), args[1].col).otherwise(args[2].col)
            out = self.keep(F.when(cond.col.isNotNull(), pick))
            self.checks.append(("runtime", "if: the selected branch is shorter than the condition", cond.col.isNotNull() & out.isNull()))
            return Chan(out, cond.rate, cond.length)
        if name == "differentiate":
            arity(1)
            ch = self.channel(args[0], name)
            v = self.keep(ch.col)
            return Chan(self.window(1, 0, lambda w: F.when(v.isNotNull(), F.coalesce((v - F.lag(v).over(w)) * F.lit(ch.rate), F.lit(0.0)))), ch.rate, ch.length)
        if name == "integrate":
            arity(1)
            return self.integrate(self.channel(args[0], name))
        if name == "detrend":
            arity(1, 2)
            return self.detrend(self.channel(args[0], name), self.string(args[1], "detrend mode") if n == 2 else "linear")
        if name == "butter":
            arity(4)
            order, cut, kind = self.constant(args[0], "butter order"), self.constant(args[1], "butter cutoff"), self.string(args[2], "butter type")
            ch = self.channel(args[3], name)
            if kind not in ("low", "lowpass", "high", "highpass"):
                raise EvalError("runtime", f"butter: type {kind!r} is not low or high")
            whole, rate = int(round(order)), ch.rate
            if not 0 < cut < rate / 2:
                raise EvalError("runtime", f"butter: cutoff {cut} is not between 0 and half the sample rate")
            return Chan(self.kernel(ch, lambda x: filters.zero_phase(x, whole, cut, kind[:4].startswith("high") and "high" or "low", rate)), ch.rate, ch.length)
        if name == "fft":
            arity(2)
            ch, window = self.channel(args[0], name), self.string(args[1], "fft window")
            if window not in spectral.WINDOWS:
                raise EvalError("runtime", f"fft: window {window!r} is not hann, hamming or rect")
            return Chan(self.kernel(ch, lambda x: spectral.magnitude(x, window)), ch.rate, ("fft", ch.length))
        if name == "declip":
            arity(1)
            ch = self.channel(args[0], name)
            return Chan(self.declipped(ch), ch.rate, ch.length)
        if name in _VECTOR:
            arity(_VECTOR[name])
            return self.vector(name, args)
        if name in ("current_lap", "sector_number", "lap_start_time", "lap_start_distance"):
            return self.laps_call(name, args, arity)
        if name in ("variance_time", "variance_dist"):
            arity(1)
            if self.laps.overlay is None or self.laps.main_lap is None:
                raise EvalError("no_lap_context", f"{name}: needs a main lap and an overlay lap")
            if not isinstance(args[0], Chan) or args[0].name is None:
                raise EvalError("type", f"{name}: the argument must be one [channel]")
            from ..operators.variance import attach

            return attach(self, name, args[0])
        raise EvalError("unknown_function", f"no function {name}()")

    def window(self, before: int, after: int, make) -> Column:
        self.n += 1
        name = f"x{self.n}"
        self.frame = windowed(self.frame, ["session_id"], "idx", before, after, lambda w: {name: make(w)})
        return F.col(name)

    def rolling(self, name: str, ch: Chan, width: float) -> Chan:
        """Causal window of round(width) samples, 1 at least, shorter at the left end; NaN propagates."""
        k = max(1, int(round(width))) - 1
        v = self.keep(ch.col)
        make = {"mean": F.avg, "std": F.stddev_pop, "rms": lambda x: F.avg(x * x)}[name]

        def over(w):
            out = make(v).over(w.rowsBetween(-k, 0))
            return F.when(v.isNotNull(), F.sqrt(out) if name == "rms" else out)

        return Chan(self.window(k, 0, over), ch.rate, ch.length)

    def integrate(self, ch: Chan) -> Chan:
        """Cumulative trapezoid from 0."""
        v = self.keep(ch.col)
        dt = F.lit(1.0 / ch.rate if ch.rate else float("inf"))
        step = self.window(1, 0, lambda w: F.coalesce((F.lag(v).over(w) + v) * 0.5 * dt, F.lit(0.0)))
        self.n += 1
        name = f"x{self.n}"
        self.frame = running_sum(self.frame, ["session_id"], "idx", F.when(v.isNotNull(), step), name)
        return Chan(self.keep(F.when(v.isNotNull(), F.col(name))), ch.rate, ch.length)

    def detrend(self, ch: Chan, mode: str) -> Chan:
        if mode not in ("linear", "constant", "mean", "none"):
            raise EvalError("runtime", f"detrend: mode {mode!r} is not linear, constant, mean or none")
        if mode == "none":
            return Chan(ch.col, ch.rate, ch.length)
        v = self.keep(ch.col)
        y, x = F.when(S.finite(v), v), F.when(S.finite(v), F.col("idx").cast("double"))
        fit = self.per_session(F.struct(F.avg(y).alias("y"), F.avg(x).alias("x"), F.covar_pop(y, x).alias("c"), F.var_pop(x).alias("v"), F.count(y).alias("n")))
        slope = F.when((fit["n"] >= 2) & (fit["v"] > 0) & F.lit(mode == "linear"), fit["c"] / F.when(fit["v"] > 0, fit["v"])).otherwise(F.lit(0.0))
        return Chan(self.keep(F.when(S.finite(v), v - (fit["y"] + slope * (F.col("idx") - fit["x"]))).otherwise(v)), ch.rate, ch.length)

    def main(self, ch: Chan) -> Scal:
        row = self.laps.baseline_row
        if row is None:
            return Scal(S.nan(), float("nan"))
        return Scal(self.per_session(F.coalesce(F.max(F.when(F.col("idx") == row, ch.col)), S.nan())))

    def vector(self, name: str, args: list):
        parts = ("x", "y", "z")
        if name == "vec":
            for a in args:
                if not isinstance(a, (Chan, Scal)):
                    raise EvalError("type", f"vec: a component is a {_KIND[type(a)]}")
            shape = self.shape(*args, what="vec")
            return Vec3(V.Vec(*[self.keep(a.col) for a in args]), *(shape or (0.0, None)))
        a = self.vec(args[0], name)
        of = lambda vec, *others: Vec3(V.Vec(*[self.keep(c) for c in vec]), *(self.shape(a, *others, what=name) or (0.0, None)))
        flat = lambda col, *others: self.wrap(col, self.shape(a, *others, what=name))
        if name in ("vx", "vy", "vz"):
            return flat(a.vec[parts.index(name[1])])
        if name in ("vadd", "vsub", "cross", "dot", "angle"):
            b = self.vec(args[1], name)
            made = {"vadd": V.add, "vsub": V.sub, "cross": V.cross, "dot": V.dot, "angle": V.angle}[name](a.vec, b.vec)
            return of(made, b) if isinstance(made, V.Vec) else flat(made, b)
        if name == "vscale":
            if not isinstance(args[1], (Chan, Scal)):
                raise EvalError("type", "vscale: the factor must be a channel or scalar")
            return of(V.scale(a.vec, args[1].col), args[1])
        if name == "norm":
            return flat(V.norm(a.vec))
        if name == "normalize":
            return of(V.normalize(a.vec))
        if name == "rotate_mat":
            return of(V.rotate_matrix(a.vec, [F.lit(self.constant(x, name)) for x in args[1:]]))
        if name == "rotate_axis":
            try:
                m = V.axis_matrix(*[self.constant(x, name) for x in args[1:]])
            except ValueError as e:
                raise EvalError("runtime", f"rotate_axis: {e}") from None
            return of(V.rotate_matrix(a.vec, [F.lit(x) for x in m]))
        for x in args[1:]:
            if not isinstance(x, (Chan, Scal)):
                raise EvalError("type", "rotate_euler: the angles must be channels or scalars")
        return of(V.rotate_euler(a.vec, *[x.col for x in args[1:]]), *args[1:])

    def laps_call(self, name: str, args: list, arity):
        if name in ("current_lap", "sector_number"):
            arity(0)
            base = self.have[self.time_base()]
            windows = self.laps.bounds if name == "current_lap" else self.laps.sectors
            t = F.col("idx") / F.lit(base.rate or 10.0)
            out = window_number(t, windows)
            col = F.coalesce(out, F.lit(0.0)) if name == "current_lap" else F.coalesce(out - 1.0, S.nan())
            return Chan(self.keep(F.when(base.col.isNotNull(), col)), base.rate or 10.0, base.length)
        arity(1)
        if not isinstance(args[0], (Chan, Scal)):
            raise EvalError("type", f"{name}: expected a scalar or channel")
        n = args[0].col
        whole = S.round_half_away(n)
        at = F.when(F.isnan(n) | (n <= 0) | (F.abs(n) == float("inf")), F.lit(0)).otherwise(whole.cast("int"))
        starts = [F.lit(float(a)) for a, _ in self.laps.bounds]
        start = F.get(F.array(*starts), at - 1) if starts else F.lit(None).cast("double")
        start = F.when(at > 0, start)
        if name == "lap_start_distance":
            if "Distance" not in self.have:
                raise EvalError("runtime", "lap_start_distance: no [Distance] channel in this session")
            d = self.have["Distance"]
            looked = self.per_session(F.map_from_entries(F.collect_list(F.when(F.col("idx").isin([int(round(a * d.rate)) for a, _ in self.laps.bounds] or [-1]), F.struct(F.col("idx"), d.col)))))
            start = F.try_element_at(looked, S.round_half_away(start * F.lit(d.rate)).cast("long"))
        col = F.when(n.isNotNull(), F.coalesce(start, S.nan()))
        return Chan(self.keep(col), args[0].rate, args[0].length) if isinstance(args[0], Chan) else Scal(col)


def window_number(t: Column, windows: list[tuple[float, float]]) -> Column:
    """1-based number of the first half-open window that holds t, as a double; NULL in none."""
    out = None
    for i, (a, b) in enumerate(windows, 1):
        hit = (t >= F.lit(float(a))) & (t < F.lit(float(b)))
        out = F.when(hit, float(i)) if out is None else out.when(hit, float(i))
    return F.lit(None).cast("double") if out is None else out


def _calls(tree) -> set[str]:
    from .syntax import children

    out = {tree.name} if isinstance(tree, Call) else set()
    for x in children(tree):
        out |= _calls(x)
    return out


def evaluate(data: SessionSet, text: str, laps: LapContext | None = None, check: bool = True) -> tuple[DataFrame, float, object]:
    """(samples-shaped frame session_id, idx, value; rate; length token) of an expression.

    A scalar result is one sample at rate 0 for each session. With ``check``, one aggregate job looks for zero
    divisors and missing branch samples first, and raises; without, such samples are NULL and dropped.
    """
    tree = parse(text)
    c = Compiler(data, laps)
    c.load(tree)
    out = c.node(tree)
    if not isinstance(out, (Chan, Scal)):
        raise EvalError("type", f"the result is a {_KIND[type(out)]}, not a channel or scalar")
    if check and c.checks:
        bad = c.frame.agg(*[F.max(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(c.checks)]).first()
        for hit, (kind, message, _) in zip(bad, c.checks, strict=True):
            if hit:
                raise EvalError(kind, message)
    if isinstance(out, Scal):
        return c.frame.groupBy("session_id").agg(F.first(out.col).alias("value")).select("session_id", F.lit(0).cast("long").alias("idx"), "value"), 0.0, 1
    return c.frame.select("session_id", "idx", out.col.alias("value")).where("value is not null"), out.rate, out.length


def evaluate_scalar(data: SessionSet, text: str, laps: LapContext | None = None) -> DataFrame:
    """(session_id, value); a channel result is an error."""
    frame, rate, length = evaluate(data, text, laps)
    if rate != 0.0 or length != 1:
        raise EvalError("type", "the result is a channel, not a scalar")
    return frame.select("session_id", "value")


def apply_definitions(data: SessionSet, definitions: list[tuple[str, str]], laps: LapContext | None = None) -> list[tuple[str, EvalError]]:
    """Evaluate math channels (name, expression) and store them; dependencies first, each once. A definition that
    fails is reported and the others go on; a cycle fails as an unknown channel where it closes."""
    by_name = dict(definitions)
    if not hasattr(data, "derived_info"):
        data.derived_info = {}
    errors: list[tuple[str, EvalError]] = []
    done: set[str] = set()

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in done or name in path or name not in by_name:
            return
        for ref in bracket_references(by_name[name]):
            if ref not in data.load_info():
                visit(ref, (*path, name))
        done.add(name)
        try:
            frame, rate, length = evaluate(data, by_name[name], laps)
        except EvalError as e:
            errors.append((name, e))
            return
        data.store(name, frame)
        data.derived_info[name] = (rate, length)

    for name, _ in definitions:
        visit(name, ())
    return errors
