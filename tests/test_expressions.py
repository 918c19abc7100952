import math

import pytest
from fixtures import samples
from hypothesis import given, settings
from hypothesis import strategies as st

from kinespark.errors import EvalError
from kinespark.model import SessionSet
from kinespark.plans.compile import LapContext, apply_definitions, evaluate, evaluate_scalar
from kinespark.plans.syntax import Binary, Num, Ref, parse, references, unparse

NAN, INF = float("nan"), float("inf")


def run(spark, channels, text, rate=10.0, **kw):
    rates = rate if isinstance(rate, dict) else {k: rate for k in channels}
    data = SessionSet.from_samples(samples(spark, channels), rates)
    out, _, _ = evaluate(data, text, **kw)
    return [r.value for r in out.orderBy("idx").collect()]


def same(a, b):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) or x == y or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


names = st.sampled_from(["A", "Front fork", "x1"])
trees = st.recursive(
    st.one_of(st.floats(0, 1e6).map(lambda v: Num(float(v))), names.map(Ref)),
    lambda inner: st.tuples(st.sampled_from(["+", "-", "*", "/", "<", ">=", "==", "and", "or"]), inner, inner).map(lambda t: Binary(*t)),
    max_leaves=12,
)


@given(trees)
@settings(max_examples=200, deadline=None)
def test_parsing_what_was_printed_gives_the_tree(tree):
    assert parse(unparse(tree)) == tree


def test_precedence_and_association():
    assert parse("1 - 2 - 3") == Binary("-", Binary("-", Num(1.0), Num(2.0)), Num(3.0))
    assert parse("1 < 2 < 3").op == "<" and parse("1 + 2 * 3").right.op == "*"
    assert parse("[a] or [b] and [c]").op == "or"
    assert references(parse("[b c] + mean([a]) - [b c]")) == ["b c", "a"]


@pytest.mark.parametrize("text", ["", "1 +", "a = b", "!x", "[a", "foo", "(1", "1 2", "f(1,)", "'a"])
def test_syntax_errors(text):
    with pytest.raises(EvalError) as e:
        parse(text)
    assert e.value.kind == "parse"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[a] + [b] * 2", [1 + 8, 2 + 10, 3 + 12]),
        ("[a] < 2", [1, 0, 0]),
        ("[n] == [n]", [0, 1, 1]),
        ("[n] != [n]", [1, 0, 0]),
        ("[n] and 1", [1, 1, 0]),
        ("not [n]", [0, 0, 1]),
        ("min([n], 5)", [5, 2, 0]),
        ("max([n], 1)", [1, 2, 1]),
        ("if([a] > 1, [b], -1)", [-1, 5, 6]),
        ("clamp([a], 1.5, 2.5)", [1.5, 2, 2.5]),
        ("round([a] - 3.5)", [-3, -2, -1]),
        ("floor([n])", [NAN, 2, 0]),
        ("pow(1, [n])", [1, 1, 1]),
        ("sign(-[a])", [-1, -1, -1]),
        ("[a] - mean([a])", [-1, 0, 1]),
        ("mean([n])", [1]),
        ("count([n]) + sum([n])", [4]),
        ("median([a]) + p([a], 25)", [2 + 1.5]),
        ("first([n]) * 10 + last([n])", [20]),
        ("mean([n], 2)", [NAN, NAN, 1]),
        ("std([a], 2)", [0, 0.5, 0.5]),
        ("rms([a], 1)", [1, 2, 3]),
        ("differentiate([a])", [0, 10, 10]),
        ("integrate([a])", [0, 0.15, 0.4]),
        ("detrend([a])", [0, 0, 0]),
        ("detrend([a], 'mean')", [-1, 0, 1]),
        ("detrend([n], 'none')", [NAN, 2, 0]),
        ("norm(vec([a], 0, 0)) + vx(cross(vec(0, 1, 0), vec(0, 0, [a])))", [2, 4, 6]),
        ("vy(normalize(vec(0, 0, 0))) + [a]", [NAN, NAN, NAN]),
        ("main([a])", [NAN]),
        ("1 + 2", [3]),
        ("sqrt(-[a])", [NAN, NAN, NAN]),
    ],
)
def test_values(spark, text, want):
    got = run(spark, {"a": [1, 2, 3], "b": [4, 5, 6], "n": [NAN, 2, 0]}, text)
    assert same(got, [float(x) for x in want]), got


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("[a] / [z]", "division_by_zero"), ("1 / 0", "division_by_zero"), ("if([a] > 0, [a], [a] / [z])", "division_by_zero"), ("[q]", "unknown_channel"), ("nope([a])", "unknown_function"), ("sin([a], 1)", "arg_count"),
        ("sin('x')", "type"), ("vec([a], 1, 2)", "type"), ("hilbert([a])", "not_implemented"), ("median([a], 3)", "not_implemented"), ("variance_time([a])", "no_lap_context"), ("[a] + [short]", "runtime"),
        ("[a] + [other]", "runtime"), ("if([a] > 0, [short], 0)", "runtime"), ("butter(2, 1, 'band', [a])", "runtime"), ("fft([a], 'flat')", "runtime"), ("p([a], 101)", "runtime"), ("clamp([a], 2, 1)", "runtime"),
        ("rotate_axis(vec([a], 0, 0), 0, 0, 0, 1)", "runtime"), ("mean(1)", "type"), ("{A1}", "runtime"),
    ],
)
def test_errors(spark, text, kind):
    channels = {"a": [1, 2, 3], "z": [1, 0, 1], "short": [1, 2], "other": [1, 2, 3]}
    with pytest.raises(EvalError) as e:
        run(spark, channels, text, {"a": 10.0, "z": 10.0, "short": 10.0, "other": 5.0})
    assert e.value.kind == kind


def test_lap_functions(spark):
    laps = LapContext(bounds=[(0.0, 0.2), (0.2, 0.35)], sectors=[(0.1, 0.2)])
    ch = {"Time": [0, 0.1, 0.2, 0.3, 0.4], "Distance": [0, 5, 9, 12, 14]}
    assert same(run(spark, ch, "current_lap()", laps=laps), [1, 1, 2, 2, 0])
    assert same(run(spark, ch, "sector_number()", laps=laps), [NAN, 0, NAN, NAN, NAN])
    assert same(run(spark, ch, "lap_start_time(current_lap())", laps=laps), [0, 0, 0.2, 0.2, NAN])
    assert same(run(spark, ch, "lap_start_distance(current_lap())", laps=laps), [0, 0, 9, 9, NAN])
    assert same(run(spark, ch, "lap_start_time(2)", laps=laps), [0.2])


def test_definitions_use_each_other_and_fail_alone(spark):
    data = SessionSet.from_samples(samples(spark, {"a": [1, 2, 3]}), 10.0)
    errors = apply_definitions(data, [("c", "[b] * 2"), ("b", "[a] + 1"), ("bad", "[nope]"), ("x", "[y]"), ("y", "[x]")])
    assert {n for n, _ in errors} == {"bad", "x", "y"}
    assert [r.value for r in data.derived["c"].orderBy("idx").collect()] == [4, 6, 8]
    assert evaluate_scalar(data, "sum([c])").first().value == 18


def test_sessions_are_evaluated_apart(spark):
    s = samples(spark, {"a": [1, 2]}).unionByName(samples(spark, {"a": [5, 7, 9]}, session="s1"))
    out, _, _ = evaluate(SessionSet.from_samples(s, 10.0), "[a] - mean([a])")
    assert sorted((r.session_id, r.value) for r in out.collect()) == [("s0", -0.5), ("s0", 0.5), ("s1", -2.0), ("s1", 0.0), ("s1", 2.0)]
