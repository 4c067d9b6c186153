"""Experts for parts of the data: slices, recency windows, and blends of their predictions with the core's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.metrics import average_precision, roc_auc, stack_scores
from quarry.operators.split import recent
from quarry.plans.schema import quantiles_by, unpivot

WEIGHTS = (0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50)


@dataclass(frozen=True)
class SliceRule:
    """Rows with low < column <= high, or with column = value. Null bounds are open; null values are outside."""

    column: str
    low: float | None = None
    high: float | None = None
    value: object = None

    @property
    def name(self) -> str:
        return f"{self.column}={self.value}" if self.value is not None else f"{self.column} in ({self.low}, {self.high}]"

    def mask(self) -> Column:
        c = F.col(self.column)
        if self.value is not None:
            test = c == F.lit(self.value)
        else:
            test = c.isNotNull()
            if self.low is not None:
                test = test & (c > self.low)
            if self.high is not None:
                test = test & (c <= self.high)
        return F.coalesce(test, F.lit(False))


def slice_rules(df: DataFrame, columns: list[str], rid: str, few: int = 12, parts: int = 5, most_values: int = 8) -> list[SliceRule]:
    """Quintile intervals of columns with more than ``few`` values; of others, the first ``most_values`` values to appear."""
    got = df.agg(*[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)]).first()
    many = [c for i, c in enumerate(columns) if got[f"u{i}"] > few]
    cuts = {r["column"]: r["edges"] for r in quantiles_by(unpivot(df, many, []), "x", [k / parts for k in range(1, parts)], ["column"]).collect()} if many else {}  # a row a column
    rules = []
    for i, c in enumerate(columns):
        if c in cuts:
            edges = sorted(set(cuts[c]))
            rules += [SliceRule(c, a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]
        else:
            firsts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(rid).alias("at")).orderBy("at").limit(most_values).collect()
            rules += [SliceRule(c, value=r[c]) for r in firsts]
    return rules


def slice_lift(df: DataFrame, rules: list[SliceRule], y: str, r: str) -> DataFrame:
    """(rule, n, positives, coverage, lift, needed, fits): mean |residual| inside over outside of every rule, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), F.sum(F.abs(F.col(r))).alias("abs")]
    for i, rule in enumerate(rules):
        m = rule.mask()
        aggs += [F.count_if(m).alias(f"n{i}"), F.sum(F.when(m, F.col(y))).alias(f"p{i}"), F.sum(F.when(m, F.abs(F.col(r)))).alias(f"a{i}")]
    wide = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.col(f"n{i}").alias("n_in"), F.coalesce(f"p{i}", F.lit(0)).cast("long").alias("pos_in"), F.coalesce(f"a{i}", F.lit(0.0)).alias("abs_in")) for i, rule in enumerate(rules)])
    rows = wide.select("n", "pos", "abs", F.explode(each).alias("s")).select("n", "pos", "abs", "s.*")
    inside = F.try_divide(F.col("abs_in"), F.col("n_in"))
    outside = F.try_divide(F.col("abs") - F.col("abs_in"), F.col("n") - F.col("n_in"))
    out = rows.select("rule", F.col("n_in").alias("n"), F.col("pos_in").alias("positives"), (F.col("n_in") / F.col("n")).alias("coverage"), F.try_divide(inside, outside).alias("lift"),
                      F.greatest(F.sqrt(F.try_divide(F.col("pos").cast("double"), F.col("pos_in"))), F.lit(1.15)).alias("needed"))
    fits = (F.col("coverage") >= 0.05) & (F.col("coverage") <= 0.6) & (F.col("positives") >= 30) & (F.col("lift") > F.col("needed"))
    return out.withColumn("fits", F.coalesce(fits, F.lit(False)))


def choose_slices(lifts: DataFrame, rules: list[SliceRule], most: int = 2) -> list[SliceRule]:
    """At most ``most`` fitting rules by lift, one a column."""
    by_name, out = {r.name: r for r in rules}, []
    for row in lifts.where("fits").orderBy(F.desc("lift"), "rule").collect():  # a row a rule
        rule = by_name[row["rule"]]
        if rule.column not in {r.column for r in out}:
            out.append(rule)
    return out[:most]


def recency_ladder(df: DataFrame, column: str, y: str, pos: str, n: int, levels: int = 4, margin: float = 0.06, least_rows: int = 400, least_positives: int = 20) -> DataFrame:
    """(level, n, positives, auc, direction): over the most recent n // 2**level rows, the column's rank direction: 1, -1, or 0
    inside the margin; null where a window is too small."""
    marks = F.array(*[F.struct(F.lit(k).alias("level"), recent(F.col(pos), n, k).alias("on")) for k in range(levels)])
    rows = df.select(F.col(y).alias("y"), F.col(column).cast("double").alias("x"), F.explode(marks).alias("m")).where("m.on").select("m.level", "y", "x")
    sizes = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))
    auc = roc_auc(rows, "y", "x", ["level"])
    big = (F.col("n") >= least_rows) & (F.col("positives") >= least_positives)
    direction = F.when(F.col("auc") >= 0.5 + margin, 1).when(F.col("auc") <= 0.5 - margin, -1).otherwise(0)
    return sizes.join(auc, "level", "left").select("level", "n", "positives", F.when(big, F.col("auc")).alias("auc"), F.when(big, direction).alias("direction"))


def steady_window(df: DataFrame, columns: list[str], y: str, pos: str, n: int, psi_max: float = 0.25, margin: float = 0.06, levels: int = 4, least_rows: int = 400, least_positives: int = 20) -> dict[str, int | None]:
    """For each column the longest recent window (level k: the last n // 2**k rows) whose halves have like values (PSI) and the same
    rank direction; None if none has. Windows of too few rows or positives are passed over."""
    from quarry.operators.drift import psi

    out: dict[str, int | None] = dict.fromkeys(columns)
    for k in range(levels):
        size = n // 2**k
        window = df.where(recent(F.col(pos), n, k)).withColumn("_late", F.col(pos) >= n - size + size // 2)
        if size < least_rows or (window.agg(F.sum(y)).first()[0] or 0) < least_positives:
            continue
        shifts = {r["column"]: r["psi"] for r in psi(window, columns, "_late").collect()}
        aucs = {(r["candidate"], r["_late"]): r["auc"] for r in roc_auc(stack_scores(window, y, {c: F.col(c) for c in columns}, ["_late"]), "y", "p", ["_late", "candidate"]).collect()}
        sign = lambda a: 0 if a is None else (a > 0.5 + margin) - (a < 0.5 - margin)
        for c in columns:
            if out[c] is None and shifts[c] <= psi_max and sign(aucs.get((c, False))) == sign(aucs.get((c, True))):
                out[c] = k
    return out


def blend(core: Column, expert: Column, weight: float, mask: Column | None = None) -> Column:
    """(1 - w) core + w expert inside the mask; the core outside, and where the expert has no score."""
    mixed = (1 - weight) * core + weight * expert
    inside = expert.isNotNull() if mask is None else F.coalesce(mask, F.lit(False)) & expert.isNotNull()
    return F.when(inside, mixed).otherwise(core)


def blend_grid(df: DataFrame, y: str, core: str, expert: str, block: str, mask: Column | None = None, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(weight, ap): mean average precision over the blocks after the first, for each weight; all weights in one plan."""
    names = {f"{w:.2f}": blend(F.col(core), F.col(expert), w, mask) for w in (0.0, *weights)}
    aps = average_precision(stack_scores(df.where(F.col(block) > 0), y, names, [block]), "y", "p", [block, "candidate"])
    return aps.groupBy(F.col("candidate").cast("double").alias("weight")).agg(F.avg("ap").alias("ap"))


def best_weight(grid: DataFrame) -> float:
    """The weight of the highest mean, the smallest on ties."""
    row = grid.orderBy(F.desc("ap"), "weight").first()
    return row["weight"] if row else 0.0


def ensemble_average(df: DataFrame, weights: dict[str, float], name: str = "p") -> DataFrame:
    """df with the weighted mean of the columns; weights of missing values are dealt to the others."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(name, F.try_divide(value, total))


def disagreement(df: DataFrame, columns: list[str], name: str = "disagreement") -> DataFrame:
    """df with the row-wise population standard deviation of the columns."""
    k = len(columns)
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / k
    return df.withColumn(name, F.sqrt(sum(((F.col(c) - mean) ** 2 for c in columns[1:]), (F.col(columns[0]) - mean) ** 2) / k))
