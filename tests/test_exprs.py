"""The expression language, with its rules on missing values."""

import pandas as pd
import pytest

from framewise.functions.exprs import ExpressionError


@pytest.fixture(scope="module")
def f(ctx):
    return ctx.parallelize(pd.DataFrame({"a": [1.0, 2.0, None, 4.0], "b": ["x", None, "y", "x"], "n v": [5, 6, -7, 8]}), 2)


def rows(frame, c):
    return sorted(frame.to_df()[c].tolist(), key=lambda v: (v is None or v != v, v))


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("a > 1", [6, 8]),
        ("a != 2", [-7, 5, 8]),
        ("not (a > 1)", [-7, 5]),
        ("1 <= a < 4", [5, 6]),
        ("b in ['x']", [5, 8]),
        ("b not in ['x']", [-7, 6]),
        ("b == ['x', 'y']", [-7, 5, 8]),
        ("(a > 1) & (b == 'x') | `n v` < 0", [-7, 8]),
        ("~(b == \"x\")", [-7, 6]),
        ("`n v` % 3 == 2", [-7, 5, 8]),
        ("a ** 2 == 16", [8]),
        ("sqrt(a) == 2", [8]),
        ("`n v` // 2 == 2", [5]),
    ],
)
def test_filter(f, expr, want):
    assert rows(f.filter(expr), "n v") == want


def test_variables_and_division_by_zero(f):
    limit = 3
    assert rows(f.filter("a > @limit"), "n v") == [8]
    assert f.select_expression("q = a / (`n v` - 5)").to_df()["q"].isna().tolist() == [True, False, True, False]


def test_sequence_of_expressions(ctx):
    df = ctx.parallelize(pd.DataFrame([[i, -i + 5, 1] for i in range(10)], columns=["a", "b", "c"]), 4)
    out = df.select_expression("col2 = a * -1", "col3 = col2 * 2 + c", "a", "zzz").to_df()
    assert out.columns.tolist() == ["col2", "col3", "a"]
    assert sorted(map(tuple, out.to_numpy().tolist())) == sorted((-i, 1 - 2 * i, i) for i in range(10))


@pytest.mark.parametrize("bad", ["", "a +", "zzz > 1", "a.b > 1", "lambda x: x", "open('x')", "@nothing > 1", "a if b else c"])
def test_errors(f, bad):
    with pytest.raises(ExpressionError):
        f.filter(bad)
