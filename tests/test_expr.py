import pytest

from quarry.functions.expr import WIDE, ExpressionError, compile_expression, order_by_dependency, with_expressions

BAD = [
    "__import__('os').system('x')", "df['y'] + 1", "df['nope']", "df.x", "np.sum(df['x'])", "df['x'].sum()", "df", "x + 1", "np.log(df['x'], out=df['x'])", "df['x'].replace(1, 2, inplace=True)",
    "(lambda: 1)()", "[v for v in df['x']]", "df['x']._private()", "np.random.rand()", "df['x'] and df['x']", "df['x'] // 2", "f'{1}'", "'text'", "df['x' + 'y']", "df['x'].isna()", "1 if df['x'] else 2", "np.log(**{})", "(" * 300 + "1" + ")" * 300,
]


@pytest.mark.parametrize("text", BAD)
def test_refused(text):
    with pytest.raises(ExpressionError):
        compile_expression(text, ["x", "y"], "y")


def test_too_long():
    with pytest.raises(ExpressionError):
        compile_expression("df['x']" + " + 1" * 6000, ["x"])


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(0.0, 1.0), (None, 2.0), (float("nan"), 3.0), (float("inf"), -4.0), (-5.0, 0.0)], "a double, b double")
    pool = {
        "div": "df['a'] / df['b']", "log": "np.log(df['a'])", "mod": "df['a'] % -3", "top": "np.maximum(df['a'], df['b'])", "gt": "df['a'] > -100", "ne": "df['a'] != 0", "pick": "np.where(df['a'] > 0, 1, df['b'])",
        "fill": "df['a'].fillna(9)",
    }
    rows = [tuple(r) for r in with_expressions(df, pool).select(*pool).collect()]
    assert rows[0] == (0.0, None, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0)
    assert rows[1] == rows[2][:6] + (2.0, 9.0) == (None, None, None, None, 0.0, 1.0, 2.0, 9.0)
    assert rows[3] == (None, None, None, None, 0.0, 1.0, -4.0, 9.0)
    assert rows[4] == (None, None, -2.0, 0.0, 1.0, 1.0, 0.0, -5.0)


def test_dependencies():
    pool = {"c": "df['b'] + df['x']", "b": "df['a'] * 2", "a": "df['x'] + 1"}
    assert order_by_dependency(["c"], pool, ["x"]) == ["a", "b", "c"]
    with pytest.raises(ExpressionError):
        order_by_dependency(["a"], {"a": "df['b']", "b": "df['a']"}, ["x"])


def test_wide_dialect():
    assert compile_expression("df['x'].isna()", ["x"], None, WIDE).tree.boolean
