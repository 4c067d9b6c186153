"""Formula features: trees of 8 unary and 15 binary operators over columns. Statistics are fitted on one table and applied to
another, so a held-out row never takes part in its own statistic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.schema import with_position

UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "log": lambda x: F.ln(F.abs(F.nullif(x, F.lit(0.0)))),
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "square": lambda x: x * x,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "round": lambda x: F.floor(x).cast("double"),
    "residual": lambda x: x - F.floor(x),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
}
GROUPED: dict[str, Callable[[str], Column]] = {
    "GroupByThenMin": F.min, "GroupByThenMax": F.max, "GroupByThenMean": F.avg, "GroupByThenMedian": F.median,
    "GroupByThenStd": F.stddev_samp, "GroupByThenNUnique": lambda v: F.count_distinct(v).cast("double"),
}
FITTED = ("freq", "Combine", "CombineThenFreq", "GroupByThenRank", *GROUPED)


@dataclass(frozen=True)
class Formula:
    """op is an operator's name, or "column" with the column's name as the only child."""

    op: str
    children: tuple = ()

    @property
    def name(self) -> str:
        return str(self.children[0]) if self.op == "column" else f"{self.op}({','.join(c.name for c in self.children)})"


def column(name: str) -> Formula:
    return Formula("column", (name,))


def _joined(apply: DataFrame, table: DataFrame, keys: list[Column], out: str, default=None) -> DataFrame:
    """apply with table's _value for its keys; the table's key columns are _k0, _k1 ..."""
    on = keys[0].eqNullSafe(F.col("_k0"))
    for i, k in enumerate(keys[1:], 1):
        on = on & k.eqNullSafe(F.col(f"_k{i}"))
    got = F.col("_value") if default is None else F.coalesce(F.col("_value"), F.lit(default))
    return apply.join(table, on, "left").withColumn(out, got).drop("_value", *[f"_k{i}" for i in range(len(keys))])


def frequency(fit: DataFrame, apply: DataFrame, x: str, out: str) -> DataFrame:
    """How many fit rows share the value; null for unseen values and nulls."""
    table = fit.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_k0")).agg(F.count(F.lit(1)).cast("double").alias("_value"))
    return _joined(apply, table, [F.col(x)], out)


def combine(fit: DataFrame, apply: DataFrame, a: str, b: str, rid: str, out: str) -> DataFrame:
    """The number of the value pair by first appearance in the fit rows; null if unseen."""
    firsts = fit.groupBy(F.col(a).alias("_k0"), F.col(b).alias("_k1")).agg(F.min(rid).alias("_at"))
    table = with_position(firsts, ["_at"], "_value").select("_k0", "_k1", F.col("_value").cast("double").alias("_value"))
    return _joined(apply, table, [F.col(a), F.col(b)], out)


def combine_frequency(fit: DataFrame, apply: DataFrame, a: str, b: str, out: str) -> DataFrame:
    table = fit.groupBy(F.col(a).alias("_k0"), F.col(b).alias("_k1")).agg(F.count(F.lit(1)).cast("double").alias("_value"))
    return _joined(apply, table, [F.col(a), F.col(b)], out)


def grouped(fit: DataFrame, apply: DataFrame, how: str, value: str, by: str, out: str) -> DataFrame:
    table = fit.groupBy(F.col(by).alias("_k0")).agg(GROUPED[how](value).alias("_value"))
    return _joined(apply, table, [F.col(by)], out)


def fit_rank(fit: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """Average rank of each fit row's value in its group, as a share of the group's values; null for null values."""
    w, ties = Window.partitionBy(by).orderBy(value), Window.partitionBy(by, value)
    rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    some = fit.where(F.col(value).isNotNull()).withColumn(out, rank / F.count(F.lit(1)).over(Window.partitionBy(by)))
    return some.unionByName(fit.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def apply_rank(fit: DataFrame, apply: DataFrame, value: str, by: str, rid: str, out: str) -> DataFrame:
    """The share of the fit group's values at or below each apply row's value; null if the group or the value is missing.

    Both tables meet in one sort by value; a running count stands for a search per row.
    """
    points = fit.where(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_x"), F.lit(1).alias("_fit"), F.lit(None).cast("long").alias("_id"))
    asks = apply.where(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_x"), F.lit(0).alias("_fit"), F.col(rid).cast("long").alias("_id"))
    run = Window.partitionBy("_g").orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = points.unionByName(asks).select("_id", "_fit", (F.sum("_fit").over(run) / F.nullif(F.sum("_fit").over(Window.partitionBy("_g")), F.lit(0))).alias("_value"))
    table = ranked.where("_fit = 0").select(F.col("_id").alias("_k0"), "_value")
    return _joined(apply, table, [F.col(rid)], out)


def evaluate(tree: Formula, fit: DataFrame, apply: DataFrame, rid: str, out: str | None = None) -> DataFrame:
    """apply with the tree's value as column ``out`` (default the tree's name). Inner fitted operators are computed on both
    tables, each from the fit table's statistics."""
    out = out or tree.name

    def values(node: Formula, target: DataFrame, name: str) -> DataFrame:
        if node.op == "column":
            return target.withColumn(name, F.col(node.children[0]))
        parts = [f"{name}.{i}" for i in range(len(node.children))]
        quoted = [f"`{p}`" for p in parts]
        for part, child in zip(parts, node.children, strict=True):
            target = values(child, target, part)
        if node.op in UNARY or node.op in BINARY:
            of = (UNARY if node.op in UNARY else BINARY)[node.op]
            done = target.withColumn(name, of(*[F.col(q).cast("double") for q in quoted]))
        else:
            base, plain = fit, [f"_p{i}" for i in range(len(parts))]
            for part, child in zip(parts, node.children, strict=True):
                base = values(child, base, part)
            base = base.withColumns({p: F.col(q) for p, q in zip(plain, quoted, strict=True)})
            target = target.withColumns({p: F.col(q) for p, q in zip(plain, quoted, strict=True)})
            if node.op == "freq":
                done = frequency(base, target, plain[0], name)
            elif node.op == "Combine":
                done = combine(base, target, *plain, rid, name)
            elif node.op == "CombineThenFreq":
                done = combine_frequency(base, target, *plain, name)
            elif node.op == "GroupByThenRank":
                done = apply_rank(base, target, *plain, rid, name)
            elif node.op in GROUPED:
                done = grouped(base, target, node.op, *plain, name)
            else:
                raise ValueError(f"operator not known: {node.op}")
            done = done.drop(*plain)
        return done.drop(*parts)

    return values(tree, apply, out)


def parse_formula(text: str) -> Formula:
    """Reads op(child,child) notation, the inverse of Formula.name; a column's name holds no comma or parenthesis."""
    at = 0

    def read() -> Formula:
        nonlocal at
        start = at
        while at < len(text) and text[at] not in "(,)":
            at += 1
        word = text[start:at].strip()
        if at >= len(text) or text[at] != "(":
            if not word:
                raise ValueError(f"a name is missing at {start} of {text!r}")
            return column(word)
        children = []
        while text[at] in "(,":
            at += 1
            children.append(read())
            if at >= len(text):
                raise ValueError(f"{text!r} ends too early")
        at += 1
        if word not in UNARY and word not in BINARY and word not in FITTED:
            raise ValueError(f"operator not known: {word}")
        return Formula(word, tuple(children))

    tree = read()
    if at != len(text):
        raise ValueError(f"{text!r} goes on after its end")
    return tree
