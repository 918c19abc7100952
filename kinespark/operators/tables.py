"""Spreadsheet tables: cells are expressions over the samples of their row's lap.

A row names a lap window. Inside a cell, [Channel] is the channel's samples of that window at rate 0; cells
of one table are evaluated in dependency order. All rows share one interval-joined frame; cells that are one
aggregate of element-wise expressions become one grouped aggregation for all rows together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError
from ..model import ChannelInfo, SessionSet
from ..plans import compile as C
from ..plans.syntax import Binary, Call, Cell, Num, Ref, Unary, children, parse, references


@dataclass
class TableCell:
    formula: str | None = None
    literal: float | None = None
    name: str | None = None


@dataclass
class TableRow:
    id: str
    session_id: str | None = None
    lap: int | None = None
    window: tuple[float, float] | None = None


@dataclass
class Table:
    columns: list[tuple[str, str, str | None]]  # id, name, template
    rows: list[TableRow]
    cells: list[list[TableCell]] = field(default_factory=list)
    baseline_row: int | None = None

    def cell(self, r: int, c: int) -> TableCell:
        return self.cells[r][c] if r < len(self.cells) and c < len(self.cells[r]) else TableCell()

    def formula(self, r: int, c: int) -> str | None:
        """A literal cell has none; a cell's own formula beats its column's template; blank counts as none."""
        cell = self.cell(r, c)
        if cell.literal is not None:
            return None
        text = cell.formula if cell.formula is not None and cell.formula.strip() else self.columns[c][2]
        return text if text and text.strip() else None


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


_A1 = re.compile(r"\$?([A-Za-z]+)\$?(\d+)$")


def address(table: Table, body: str, row: int):
    """("cell", r, c) or ("column", c) of a {body}; a body with any digit is an A1 address. None if there is no such."""
    whole = body.endswith("[]")
    name = body[:-2].strip() if whole else body.strip()
    if not whole and any(ch.isdigit() for ch in name):
        m = _A1.match(name)
        if not m:
            return None
        r, c = int(m[2]) - 1, column_number(m[1])
        return ("cell", r, c) if 0 <= r < len(table.rows) and c < len(table.columns) else None
    for c, (cid, cname, _) in enumerate(table.columns):
        if name in (cid, cname):
            return ("column", c) if whole else ("cell", row, c)
    for r in range(len(table.rows)):
        for c in range(len(table.columns)):
            if not whole and table.cell(r, c).name == name:
                return ("cell", r, c)
    return None


def _cells(tree) -> list[str]:
    out = [tree.body] if isinstance(tree, Cell) else []
    for x in children(tree):
        out += _cells(x)
    return out


def order(table: Table) -> tuple[list[tuple[int, int]], set[tuple[int, int]]]:
    """(cells in dependency order, cells on or behind a cycle)."""
    needs: dict[tuple[int, int], set] = {}
    for r in range(len(table.rows)):
        for c in range(len(table.columns)):
            text = table.formula(r, c)
            if text is None:
                continue
            needs[r, c] = set()
            try:
                bodies = _cells(parse(text))
            except EvalError:
                bodies = []
            for body in bodies:
                a = address(table, body, r)
                if a and a[0] == "cell":
                    needs[r, c].add(a[1:])
                elif a:
                    needs[r, c] |= {(k, a[1]) for k in range(len(table.rows))}
    done: list[tuple[int, int]] = []
    left = dict(needs)
    while ready := [k for k, d in left.items() if not any(x in left for x in d)]:
        for k in sorted(ready):
            done.append(k)
            del left[k]
    # what only waits for a cycle is blank, not wrong: keep what reaches itself
    cyclic = set()
    for k in left:
        seen, todo = set(), [x for x in left[k] if x in left]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in left.get(x, ()) if y in left]
        if k in seen:
            cyclic.add(k)
    return done, cyclic


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _substitute(tree, values: dict):
    if isinstance(tree, Cell):
        v = values[tree.body]
        return v if not isinstance(v, float) else Num(v)
    if isinstance(tree, Unary):
        return Unary(tree.op, _substitute(tree.arg, values))
    if isinstance(tree, Binary):
        return Binary(tree.op, _substitute(tree.left, values), _substitute(tree.right, values))
    if isinstance(tree, Call):
        return Call(tree.name, tuple(_substitute(x, values) for x in tree.args))
    return tree


class _Rows(C.Compiler):
    """The compiler over windowed samples: one "session" for each table row, and rate 0 for every channel."""


def windowed_samples(data: SessionSet, table: Table, rows: list[int]) -> DataFrame:
    """Samples of each row's window, inclusive as time slices are: (session_id = row number, channel_id, idx, t, value).
    One join with the rows' windows, which are as many as the table has rows."""
    spark = data.samples.sparkSession
    info = data.load_info()
    named = [(str(r), table.rows[r].session_id, name, *(_bounds(table.rows[r].window, i.rate))) for r in rows for name, i in info.items()]
    w = spark.createDataFrame(named, "row string, session_id string, channel_id string, lo long, hi long, t0 double, t1 double")
    s = data.samples
    if all(table.rows[r].session_id is None for r in rows):
        joined = s.join(w.drop("session_id"), "channel_id").drop("session_id")
    else:
        joined = s.join(w, ["session_id", "channel_id"]).drop("session_id")
    inside = joined.where(F.when(F.col("lo").isNull(), F.col("t").between(F.col("t0"), F.col("t1"))).otherwise(F.col("idx").between(F.col("lo"), F.col("hi"))))
    first = inside.groupBy("row", "channel_id").agg(F.min("idx").alias("__0"))
    return inside.join(first, ["row", "channel_id"]).select(F.col("row").alias("session_id"), "channel_id", (F.col("idx") - F.col("__0")).alias("idx"), "t", "value")


def _bounds(window, rate):
    import math

    t0, t1 = window
    if not rate:
        return None, None, float(t0), float(t1)
    return max(0, math.ceil(t0 * rate - 1e-9)), math.floor(t1 * rate + 1e-9), float(t0), float(t1)


def evaluate_table(data: SessionSet, table: Table, laps: C.LapContext | None = None) -> list[list[tuple[float | None, str | None]]]:
    """(value, error) of every cell. A cell without formula has its literal's number, else nothing. Any cycle blanks
    the whole table but for the error in the cycle's cells."""
    out: list[list] = [[(None, None)] * len(table.columns) for _ in table.rows]
    todo, cyclic = order(table)
    if cyclic:
        for r, c in cyclic:
            out[r][c] = (None, "cycle")
        return out
    for r in range(len(table.rows)):
        for c in range(len(table.columns)):
            out[r][c] = (_number(table.cell(r, c).literal), None)
    bound = [r for r, row in enumerate(table.rows) if row.window is not None]
    sliced = SessionSet(windowed_samples(data, table, bound), None, info={k: ChannelInfo(0.0, None) for k in data.load_info()}) if bound else None
    # cells of equal depth with equal formulas (a column's template) are one job for all of their rows
    while todo:
        ready, rest, pending = [], [], set(todo)
        for r, c in todo:
            bodies = _cells_of(table.formula(r, c))
            waits = any(a and ((a[0] == "cell" and a[1:] in pending) or (a[0] == "column" and any((k, a[1]) in pending for k in range(len(table.rows))))) for a in (address(table, b, r) for b in bodies))
            (rest if waits else ready).append((r, c))
        groups: dict = {}
        for r, c in ready:
            text = table.formula(r, c)
            try:
                tree = parse(text)
                values = {}
                for body in _cells(tree):
                    a = address(table, body, r)
                    if a is None:
                        raise EvalError("unknown_channel", f"no cell {{{body}}}")
                    values[body] = _lookup(out, a, body)
                groups.setdefault(_substitute(tree, values), []).append((r, c))
            except EvalError as e:
                out[r][c] = (None, e.kind)
        for tree, cells in groups.items():
            _evaluate_group(sliced, tree, cells, out, laps, table)
        todo = rest
    return out


def _cells_of(text: str) -> list[str]:
    try:
        return _cells(parse(text))
    except EvalError:
        return []


def _lookup(out, a, body):
    if a[0] == "cell":
        value, error = out[a[1]][a[2]]
        if value is None:
            raise EvalError("runtime", f"cell {{{body}}} has no value")
        return value
    return Call("__list", tuple(Num(row[a[1]][0]) for row in out if row[a[1]][0] is not None))


class _TableCompiler(_Rows):
    def __init__(self, data, laps, literal_lists: bool = True):
        super().__init__(data, laps)

    def call(self, name, trees):
        lists = [t for t in trees if isinstance(t, Call) and t.name == "__list"]
        if name == "main" and lists:
            values = [x.value for x in lists[0].args]
            row = self.laps.baseline_row
            v = values[row] if row is not None and 0 <= row < len(values) else float("nan")
            return C.Scal(F.lit(v), v)
        if lists and len(trees) == len(lists) + sum(isinstance(t, Num) for t in trees):
            return self.fold(name, [x.value for x in lists[0].args], [t.value for t in trees if isinstance(t, Num)])
        return super().call(name, trees)

    def fold(self, name, values, rest):
        """An aggregate of a whole column: as many numbers as the table has rows."""
        import numpy as np

        x = np.array([v for v in values if np.isfinite(v)])
        if name == "p" and len(rest) == 1 and not 0 <= rest[0] <= 100:
            raise EvalError("runtime", "p quantile is not in 0..100")
        made = {"count": lambda: float(len(x)), "sum": lambda: float(x.sum()), "mean": x.mean, "max": x.max, "min": x.min, "rms": lambda: np.sqrt((x * x).mean()), "std": x.std, "median": lambda: np.median(x), "first": lambda: x[0], "last": lambda: x[-1], "p": lambda: np.percentile(x, rest[0])}.get(name)
        if made is None:
            raise EvalError("type", f"{name}: a whole column only serves aggregates and main()")
        v = float(made()) if len(x) or name in ("count", "sum") else float("nan")
        return C.Scal(F.lit(v), v)


def _evaluate_group(sliced, tree, cells, out, laps, table) -> None:
    rows = [r for r, _ in cells]
    ctx = C.LapContext(**(vars(laps) if laps else {}))
    ctx.baseline_row = table.baseline_row if table.baseline_row is not None else ctx.baseline_row
    try:
        names = references(tree)
        if not names:
            c = _TableCompiler(SessionSet(None, None, info={"": ChannelInfo(0.0, None)}), ctx)
            value = c.node(tree)
            if not isinstance(value, C.Scal) or value.value is None:
                from pyspark.sql import SparkSession

                got = SparkSession.active().range(1).select(value.col).first()[0] if isinstance(value, C.Scal) else None
                if got is None:
                    raise EvalError("type", "the result is not a scalar")
            else:
                got = value.value
            for r, c_ in cells:
                out[r][c_] = (got, None)
            return
        if sliced is None:
            raise EvalError("unknown_channel", f"no channel [{names[0]}] without a lap")
        data = SessionSet(sliced.samples.where(F.col("session_id").isin([str(r) for r in rows])), None, info=sliced.info)
        data.same_length = lambda a, b: True  # checked row by row below
        c = _TableCompiler(data, ctx)
        c.load(tree)
        counts = [F.count(c.have[n].col).alias(f"n{i}") for i, n in enumerate(names)]
        value = c.node(tree)
        if not isinstance(value, C.Scal):
            raise EvalError("type", "the result is a channel, not a scalar")
        tests = [F.max(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(c.checks)]
        got = {x["session_id"]: x for x in c.frame.groupBy("session_id").agg(F.first(value.col).alias("value"), *counts, *tests).collect()}
        for r, col in cells:
            found = got.get(str(r))
            if table.rows[r].window is None or found is None or not all(found[f"n{i}"] for i in range(len(names))):
                out[r][col] = (None, "unknown_channel")
                continue
            bad = next((kind for i, (kind, _, _) in enumerate(c.checks) if found[f"c{i}"]), None)
            out[r][col] = (None, bad) if bad else (found["value"], None)
    except EvalError as e:
        for r, col in cells:
            out[r][col] = (None, e.kind)


def lap_windows(table: Table, laps: list[tuple[float, float]]) -> list[str]:
    """Set each row's window from its lap, counted from 0; returns a warning for every lap out of range."""
    warnings = []
    for row in table.rows:
        if row.lap is None:
            continue
        if 0 <= row.lap < len(laps):
            row.window = laps[row.lap]
        else:
            row.window = None
            warnings.append(f"lap_out_of_range: row {row.id} names lap {row.lap} of {len(laps)}")
    return warnings


def validate(table: Table, channels: set[str] | None = None) -> list[tuple[str, int, int]]:
    """(problem, row, column): dimension_mismatch, parse_error, unknown_reference, cycle."""
    out = []
    if len(table.cells) != len(table.rows) or any(len(r) != len(table.columns) for r in table.cells):
        out.append(("dimension_mismatch", -1, -1))
    for r in range(len(table.rows)):
        for c in range(len(table.columns)):
            text = table.formula(r, c)
            if text is None:
                continue
            try:
                tree = parse(text)
            except EvalError:
                out.append(("parse_error", r, c))
                continue
            if any(address(table, b, r) is None for b in _cells(tree)) or (channels is not None and any(n not in channels for n in references(tree))):
                out.append(("unknown_reference", r, c))
    out += [("cycle", r, c) for r, c in sorted(order(table)[1])]
    return out


def text_grid(table: Table, values) -> str:
    """Comma-separated grid: header, then values, #ERR for errors, nothing for blanks."""
    def show(v, e):
        return "#ERR" if e else "" if v is None else repr(v)

    lines = [",".join(name for _, name, _ in table.columns)]
    return "\n".join([*lines, *[",".join(show(*x) for x in row) for row in values]])


def aggregate_by_lap(data: SessionSet, windows: DataFrame, columns: dict[str, tuple[str, str]], rate: float) -> DataFrame:
    """(session_id, lap, one column per entry): ``columns`` maps a name to (aggregate, channel). One interval join and
    one grouped aggregation for any number of laps and cells; this is the path for tables over many sessions.

    ``windows(session_id, lap, start_s, end_s)``; a sample belongs to every lap whose inclusive window holds it."""
    from ..functions.aggregate import AGGREGATES

    wanted = sorted({ch for _, ch in columns.values()})
    s = data.samples.where(F.col("channel_id").isin(wanted))
    lo, hi = F.greatest(F.ceil(F.col("start_s") * rate - 1e-9), F.lit(0)), F.floor(F.col("end_s") * rate + 1e-9)
    size = 4096
    w = windows.select("session_id", "lap", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).withColumn("__k", F.explode(F.sequence(F.floor(F.col("lo") / size).cast("long"), F.floor(F.greatest("hi", "lo") / size).cast("long"))))
    joined = s.withColumn("__k", F.floor(F.col("idx") / size).cast("long")).join(w, ["session_id", "__k"]).where(F.col("idx").between(F.col("lo"), F.col("hi")))
    made = [AGGREGATES[agg](F.when(F.col("channel_id") == ch, F.col("value")), F.col("idx")).alias(name) for name, (agg, ch) in columns.items()]
    return joined.groupBy("session_id", "lap").agg(*made)


__all__ = ["Ref", "Table", "TableCell", "TableRow", "aggregate_by_lap", "evaluate_table", "lap_windows", "text_grid", "validate"]
