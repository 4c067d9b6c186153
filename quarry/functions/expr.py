"""The feature-expression language: restricted Python expressions over columns, compiled to Spark Columns.

An expression such as ``np.log1p(df['value'].clip(0, 10)) / df['n']`` is parsed, checked against the dialect and lowered
to a small tree of typed operations. The tree renders to a Catalyst Column, which runs inside whole-stage code
generation, and to SQL text, which lets another engine check it. Nothing is ever evaluated as Python.

Values are doubles or booleans. Null stands for every missing or non-finite value: inputs are canonicalised, and an
operation without a finite result gives null. Comparisons with null are false (``!=`` true), as with NaN.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 20_000
STRICT, WIDE = "strict", "wide"
#: Functions of the two dialects; the wide one has all of both.
_NUMPY = {
    STRICT: "abs clip log log1p sqrt maximum minimum where exp expm1 square sign power".split(),
    WIDE: "abs clip log log1p sqrt maximum minimum where exp expm1 square sign power isnan isfinite".split(),
}
_METHODS = {
    STRICT: "abs clip fillna astype replace to_numpy".split(),
    WIDE: "abs clip fillna astype replace to_numpy pow isna notna between isin round".split(),
}


class ExpressionError(ValueError):
    """The expression is outside the dialect, or reads what it may not."""


@dataclass(frozen=True)
class Op:
    """A node of the lowered tree: an operation, its operands, and whether its value is a boolean."""

    name: str
    args: tuple
    boolean: bool = False


#: Binary operators by Python node: (operation, operands are booleans, result is one).
_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Mod: "mod", ast.Pow: "pow"}
_LOGIC = {ast.BitAnd: "and", ast.BitOr: "or"}
_COMPARE = {ast.Gt: "gt", ast.GtE: "ge", ast.Lt: "lt", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "ne"}


class _Lowering:
    def __init__(self, columns: Iterable[str], label: str | None, dialect: str):
        self.columns, self.label, self.dialect, self.read = set(columns), label, dialect, []

    def fail(self, why: str):
        raise ExpressionError(why)

    def number(self, node: ast.AST) -> Op:
        op = self.lower(node)
        return Op("as_number", (op,)) if op.boolean else op

    def condition(self, node: ast.AST) -> Op:
        op = self.lower(node)
        return op if op.boolean else self.fail("a condition is expected")

    def constant(self, node: ast.AST) -> float:
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            v = self.constant(node.operand)
            return -v if isinstance(node.op, ast.USub) else v
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return float(node.value)
        return self.fail("a number is expected")

    def lower(self, node: ast.AST) -> Op:
        if isinstance(node, ast.Constant):
            if isinstance(node.value, bool):
                return Op("truth", (node.value,), True)
            if isinstance(node.value, int | float):
                return Op("literal", (float(node.value),))
            return self.fail(f"constant not allowed: {node.value!r}")
        if isinstance(node, ast.Subscript):
            return self.column(node)
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.USub):
                return Op("neg", (self.number(node.operand),))
            if isinstance(node.op, ast.UAdd):
                return self.number(node.operand)
            if isinstance(node.op, ast.Invert):
                return Op("not", (self.condition(node.operand),), True)
        if isinstance(node, ast.BinOp):
            if name := _LOGIC.get(type(node.op)):
                return Op(name, (self.condition(node.left), self.condition(node.right)), True)
            if name := _BINARY.get(type(node.op)):
                return Op(name, (self.number(node.left), self.number(node.right)))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and (name := _COMPARE.get(type(node.ops[0]))):
            return Op(name, (self.number(node.left), self.number(node.comparators[0])), True)
        if isinstance(node, ast.Call):
            return self.call(node)
        return self.fail(f"syntax not allowed: {type(node).__name__}")

    def column(self, node: ast.Subscript) -> Op:
        if not (isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str)):
            return self.fail("only df['column'] can be subscripted")
        name = node.slice.value
        if name == self.label or name not in self.columns:
            return self.fail(f"column cannot be read: {name}")
        self.read.append(name)
        return Op("column", (name,))

    def call(self, node: ast.Call) -> Op:
        if not isinstance(node.func, ast.Attribute) or node.func.attr.startswith("_"):
            return self.fail("only functions of np and pd and methods of columns can be called")
        words = {k.arg: k.value for k in node.keywords}
        if {None, "out", "inplace"} & set(words):
            return self.fail("keywords may not unpack or modify in place")
        owner, name = node.func.value, node.func.attr
        if isinstance(owner, ast.Name) and owner.id in ("np", "pd"):
            if owner.id == "pd":
                if name != "to_numeric" or len(node.args) != 1 or set(words) - {"errors"}:
                    return self.fail(f"function not allowed: pd.{name}")
                return self.number(node.args[0])
            if name not in _NUMPY[self.dialect]:
                return self.fail(f"function not allowed: np.{name}")
            return self.function(name, list(node.args), words)
        if isinstance(owner, ast.Name) or name not in _METHODS[self.dialect]:
            return self.fail(f"method not allowed: {name}")
        return self.method(name, owner, list(node.args), words)

    def function(self, name: str, args: list, words: dict) -> Op:
        sizes = {"clip": 3, "maximum": 2, "minimum": 2, "where": 3, "power": 2}
        if words or len(args) != sizes.get(name, 1):
            return self.fail(f"wrong arguments: np.{name}")
        if name == "where":
            return Op("where", (self.condition(args[0]), self.number(args[1]), self.number(args[2])))
        if name == "clip":
            return Op("minimum", (Op("maximum", (self.number(args[0]), self.number(args[1]))), self.number(args[2])))
        if name in ("isnan", "isfinite"):
            return Op("missing" if name == "isnan" else "present", (self.number(args[0]),), True)
        return Op({"power": "pow"}.get(name, name), tuple(self.number(a) for a in args))

    def method(self, name: str, owner: ast.AST, args: list, words: dict) -> Op:
        x = self.number(owner)
        if name in ("to_numpy", "abs") and not args and not words:
            return x if name == "to_numpy" else Op("abs", (x,))
        if name in ("isna", "notna") and not args and not words:
            return Op("missing" if name == "isna" else "present", (x,), True)
        if name == "astype" and len(args) == 1 and not words:
            kind = args[0].value if isinstance(args[0], ast.Constant) else args[0].id if isinstance(args[0], ast.Name) else None
            if kind in ("float", "float32", "float64", float):
                return x
            if kind in ("int", "int32", "int64"):
                return Op("truncate", (x,))
            return self.fail("astype knows float and int")
        if name == "clip" and len(args) + len(words) in (1, 2) and not set(words) - {"lower", "upper"}:
            bounds = dict(zip(("lower", "upper"), args, strict=False)) | words
            for key, op in (("lower", "maximum"), ("upper", "minimum")):
                if key in bounds and not (isinstance(bounds[key], ast.Constant) and bounds[key].value is None):
                    x = Op(op, (x, self.number(bounds[key])))
            return x
        if name == "fillna" and len(args) == 1 and not words:
            return Op("fill", (x, self.number(args[0])))
        if name == "replace":
            return self.replace(x, args, words)
        if name == "pow" and len(args) == 1 and not words:
            return Op("pow", (x, self.number(args[0])))
        if name == "between" and len(args) == 2 and not words:
            return Op("and", (Op("ge", (x, self.number(args[0])), True), Op("le", (x, self.number(args[1])), True)), True)
        if name == "isin" and len(args) == 1 and not words and isinstance(args[0], ast.List | ast.Tuple):
            return Op("isin", (x, tuple(self.constant(a) for a in args[0].elts)), True)
        if name == "round" and len(args) <= 1 and not words:
            return Op("round", (x, int(self.constant(args[0])) if args else 0))
        return self.fail(f"wrong arguments: {name}")

    def replace(self, x: Op, args: list, words: dict) -> Op:
        if words or not 1 <= len(args) <= 2:
            return self.fail("wrong arguments: replace")
        if len(args) == 1:
            if not isinstance(args[0], ast.Dict):
                return self.fail("wrong arguments: replace")
            pairs = [(self.constant(k), self.constant(v)) for k, v in zip(args[0].keys, args[0].values, strict=True)]
        else:
            keys = args[0].elts if isinstance(args[0], ast.List | ast.Tuple) else [args[0]]
            values = args[1].elts if isinstance(args[1], ast.List | ast.Tuple) else [args[1]] * len(keys)
            if len(values) != len(keys):
                return self.fail("replace needs as many values as keys")
            pairs = [(self.constant(k), self.constant(v)) for k, v in zip(keys, values, strict=True)]
        return Op("replace", (x, tuple(pairs)))


def _finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when((F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c), c)


_SPARK: dict[str, Callable[..., Column]] = {
    "literal": lambda v: F.lit(v) if math.isfinite(v) else F.lit(None).cast("double"),
    "truth": F.lit,
    "column": lambda n: _finite(F.col(f"`{n}`").try_cast("double")),
    "as_number": lambda a: a.cast("int").cast("double"),
    "neg": lambda a: -a,
    "not": lambda a: ~a,
    "add": lambda a, b: _finite(a + b), "sub": lambda a, b: _finite(a - b), "mul": lambda a, b: _finite(a * b),
    "div": lambda a, b: _finite(F.try_divide(a, b)),
    "mod": lambda a, b: _finite(a - F.floor(F.try_divide(a, b)) * b),
    "pow": lambda a, b: _finite(F.pow(a, b)),
    "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    "gt": lambda a, b: F.coalesce(a > b, F.lit(False)), "ge": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "lt": lambda a, b: F.coalesce(a < b, F.lit(False)), "le": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "eq": lambda a, b: F.coalesce(a == b, F.lit(False)), "ne": lambda a, b: F.coalesce(a != b, F.lit(True)),
    "abs": F.abs, "square": lambda a: _finite(a * a), "sign": F.signum,
    "log": lambda a: F.when(a > 0, F.ln(a)), "log1p": lambda a: F.when(a > -1, F.log1p(a)),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)), "exp": lambda a: _finite(F.exp(a)), "expm1": lambda a: _finite(F.expm1(a)),
    "maximum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "minimum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "missing": lambda a: a.isNull(), "present": lambda a: a.isNotNull(),
    "fill": lambda a, b: F.coalesce(a, b), "isin": lambda a, vs: F.coalesce(a.isin(*vs), F.lit(False)),
    "round": lambda a, d: F.bround(a, d), "truncate": lambda a: F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)).cast("double"),
}


def _sql_finite(s: str) -> str:
    return f"(CASE WHEN isfinite({s}) THEN {s} END)"


_SQL: dict[str, Callable[..., str]] = {
    "literal": lambda v: f"CAST({v!r} AS DOUBLE)" if math.isfinite(v) else "CAST(NULL AS DOUBLE)",
    "truth": lambda v: str(v).upper(),
    "column": lambda n: _sql_finite(f'TRY_CAST("{n}" AS DOUBLE)'),
    "as_number": lambda a: f"CAST(CAST({a} AS INTEGER) AS DOUBLE)",
    "neg": lambda a: f"(-{a})", "not": lambda a: f"(NOT {a})",
    "add": lambda a, b: _sql_finite(f"({a} + {b})"), "sub": lambda a, b: _sql_finite(f"({a} - {b})"), "mul": lambda a, b: _sql_finite(f"({a} * {b})"),
    "div": lambda a, b: _sql_finite(f"({a} / nullif({b}, 0))"),
    "mod": lambda a, b: _sql_finite(f"({a} - floor({a} / nullif({b}, 0)) * {b})"),
    "pow": lambda a, b: _sql_finite(f"(CASE WHEN {a} < 0 AND {b} <> floor({b}) THEN NULL WHEN {a} = 0 AND {b} < 0 THEN NULL ELSE power({a}, {b}) END)"),
    "and": lambda a, b: f"({a} AND {b})", "or": lambda a, b: f"({a} OR {b})",
    "gt": lambda a, b: f"coalesce({a} > {b}, FALSE)", "ge": lambda a, b: f"coalesce({a} >= {b}, FALSE)",
    "lt": lambda a, b: f"coalesce({a} < {b}, FALSE)", "le": lambda a, b: f"coalesce({a} <= {b}, FALSE)",
    "eq": lambda a, b: f"coalesce({a} = {b}, FALSE)", "ne": lambda a, b: f"coalesce({a} <> {b}, TRUE)",
    "abs": lambda a: f"abs({a})", "square": lambda a: _sql_finite(f"({a} * {a})"), "sign": lambda a: f"CAST(sign({a}) AS DOUBLE)",
    "log": lambda a: f"(CASE WHEN {a} > 0 THEN ln({a}) END)", "log1p": lambda a: f"(CASE WHEN {a} > -1 THEN ln(1 + {a}) END)",
    "sqrt": lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)", "exp": lambda a: _sql_finite(f"exp({a})"), "expm1": lambda a: _sql_finite(f"(exp({a}) - 1)"),
    "maximum": lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)",
    "minimum": lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)",
    "where": lambda c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)",
    "missing": lambda a: f"({a} IS NULL)", "present": lambda a: f"({a} IS NOT NULL)",
    "fill": lambda a, b: f"coalesce({a}, {b})", "isin": lambda a, vs: f"coalesce({a} IN ({', '.join(map(repr, vs)) or 'NULL'}), FALSE)",
    "round": lambda a, d: f"round_even({a}, {d})", "truncate": lambda a: f"trunc({a})",
}


def _render(op: Op, table: dict, when: Callable):
    args = [_render(a, table, when) if isinstance(a, Op) else a for a in op.args]
    if op.name == "replace":
        return when(*args)
    return table[op.name](*args)


@dataclass(frozen=True)
class Expression:
    """A compiled expression: its source, its tree, and the columns it reads."""

    source: str
    tree: Op
    columns: tuple[str, ...]

    def column(self) -> Column:
        """A double Column (booleans as 0 and 1); null where there is no finite value."""

        def when(x: Column, pairs):
            out = None
            for key, value in pairs:
                test = x == F.lit(key)
                out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
            return x if out is None else out.otherwise(x)

        c = _render(self.tree, _SPARK, when)
        return c.cast("int").cast("double") if self.tree.boolean else c

    def sql(self) -> str:
        def when(x: str, pairs):
            return "(CASE " + " ".join(f"WHEN {x} = {k!r} THEN {v!r}" for k, v in pairs) + f" ELSE {x} END)" if pairs else x

        s = _render(self.tree, _SQL, when)
        return f"CAST(CAST({s} AS INTEGER) AS DOUBLE)" if self.tree.boolean else s


def compile_expression(source: str, columns: Iterable[str], label: str | None = None, dialect: str = STRICT) -> Expression:
    """Check and lower an expression. The label and unknown columns cannot be read; raises ExpressionError."""
    if len(source) > MAX_LENGTH:
        raise ExpressionError("expression too long")
    try:
        body = ast.parse(source.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ExpressionError(f"not an expression: {e}") from None
    lowering = _Lowering(columns, label, dialect)
    tree = lowering.lower(body)
    return Expression(source, tree, tuple(dict.fromkeys(lowering.read)))


def order_by_dependency(names: Iterable[str], pool: dict[str, str], base: Iterable[str], dialect: str = STRICT) -> list[str]:
    """The expressions of pool that names need, dependencies first; ExpressionError on a circle."""
    base, out, open_ = set(base), [], []

    def visit(name: str) -> None:
        if name in out or name not in pool:
            return
        if name in open_:
            raise ExpressionError("features depend on each other in a circle: " + " -> ".join([*open_, name]))
        open_.append(name)
        for column in compile_expression(pool[name], base | set(pool), None, dialect).columns:
            visit(column)
        open_.pop()
        out.append(name)

    for name in names:
        visit(name)
    return out


def with_expressions(df, pool: dict[str, str], names: Iterable[str] | None = None, label: str | None = None, dialect: str = STRICT):
    """df with the named expressions (default all) as double columns, one select per depth of dependency."""
    base = set(df.columns)
    order = order_by_dependency(names or pool, pool, base, dialect)
    depth: dict[str, int] = {}
    for name in order:
        reads = compile_expression(pool[name], base | set(pool), label, dialect).columns
        depth[name] = 1 + max((depth.get(c, 0) for c in reads), default=0)
    for level in sorted(set(depth.values())):
        df = df.withColumns({n: compile_expression(pool[n], base | set(pool), label, dialect).column() for n in order if depth[n] == level})
    return df
