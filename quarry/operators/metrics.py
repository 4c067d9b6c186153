"""Metrics of scores: tied scores are one step. Rows are grouped by score first; the running sums over distinct scores are taken in
ranges, or, with keys (a region, a replicate, a candidate), in a window for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.schema import quantiles_by, running_totals, unpivot


def score_steps(df: DataFrame, y: str, p: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., score, n, pos, cn, cp, total, total_pos): counts at each distinct score and at or above it."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    steps = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"))
    if not by:
        run = running_totals(steps, "score", ["n", "pos"], descending=True)
        return run.select("score", "n", "pos", F.col("cum_n").alias("cn"), F.col("cum_pos").alias("cp"), F.col("total_n").alias("total"), F.col("total_pos"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    return steps.withColumns({"cn": F.sum("n").over(down), "cp": F.sum("pos").over(down), "total": F.sum("n").over(every), "total_pos": F.sum("pos").over(every)})


def _ap() -> Column:
    return F.sum(F.try_divide(F.col("pos") * F.col("cp"), F.col("cn") * F.col("total_pos")))


def _auc() -> Column:
    below = F.col("total") - F.col("total_pos") - (F.col("cn") - F.col("cp"))
    pairs = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2.0))
    return F.try_divide(pairs, F.max(F.col("total_pos") * (F.col("total") - F.col("total_pos"))))


def average_precision(df: DataFrame, y: str, p: str, by: list[str] | None = None, weight: str | None = None, name: str = "ap") -> DataFrame:
    """(by..., ap): the sum over distinct scores of recall gained times precision; null without positives."""
    return score_steps(df, y, p, by, weight).groupBy(*(by or [])).agg(_ap().alias(name))


def roc_auc(df: DataFrame, y: str, p: str, by: list[str] | None = None, name: str = "auc") -> DataFrame:
    """(by..., auc): the share of (positive, negative) pairs in order, ties half; null with one class."""
    return score_steps(df, y, p, by).groupBy(*(by or [])).agg(_auc().alias(name))


def ap_and_auc(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by..., ap, auc), both from the same steps."""
    return score_steps(df, y, p, by).groupBy(*(by or [])).agg(_ap().alias("ap"), _auc().alias("auc"))


def pr_points(df: DataFrame, y: str, p: str, levels: tuple[float, ...] = (0.5, 0.8), top: float = 0.01) -> DataFrame:
    """One row: precision at recall of at least each level, recall at precision of at least each, recall in the top share."""
    s = score_steps(df, y, p).withColumns({"precision": F.col("cp") / F.col("cn"), "recall": F.try_divide(F.col("cp"), F.col("total_pos"))})
    aggs = [F.max(F.when(F.col("recall") >= v, F.col("precision"))).alias(f"precision_at_recall_{round(100 * v)}") for v in levels]
    aggs += [F.coalesce(F.max(F.when(F.col("precision") >= v, F.col("recall"))), F.lit(0.0)).alias(f"recall_at_precision_{round(100 * v)}") for v in levels]
    aggs.append(F.coalesce(F.max(F.when(F.col("cn") <= F.ceil(F.col("total") * top), F.col("recall"))), F.lit(0.0)).alias("recall_in_top"))
    return s.agg(*aggs)


def best_f1_profile(df: DataFrame, y: str, p: str, columns: list[str]) -> DataFrame:
    """A row a column: threshold of best F1, tp, fp, fn, tn counts, and how median and missing share of the column differ between
    errors and hits: (column, threshold, tp, fp, fn, tn, fn_gap, fp_gap, fn_missing, fp_missing)."""
    s = score_steps(df, y, p)
    f1 = 2 * F.col("cp") / (F.col("cn") + F.col("total_pos"))
    best = s.select("score", f1.alias("f1")).orderBy(F.desc("f1"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"))
    rows = df.crossJoin(F.broadcast(best)).withColumn("hit", F.col(p) >= F.col("threshold"))  # best has one row
    kinds = {"tp": F.col("hit") & (F.col(y) == 1), "fp": F.col("hit") & (F.col(y) == 0), "fn": ~F.col("hit") & (F.col(y) == 1), "tn": ~F.col("hit") & (F.col(y) == 0)}
    aggs = [F.max("threshold").alias("threshold")] + [F.count_if(c).alias(k) for k, c in kinds.items()]
    aggs += [F.avg(F.when(test, F.col(c).isNull().cast("int"))).alias(f"z_{k}_{i}") for i, c in enumerate(columns) for k, test in kinds.items()]
    each = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"z_fn_{i}") - F.col(f"z_tp_{i}")).alias("fn_missing"), (F.col(f"z_fp_{i}") - F.col(f"z_tn_{i}")).alias("fp_missing")) for i, c in enumerate(columns)])
    whole = rows.agg(*aggs).select("threshold", "tp", "fp", "fn", "tn", F.explode(each).alias("r")).select("threshold", "tp", "fp", "fn", "tn", "r.*")
    kind = F.coalesce(*[F.when(test, k) for k, test in kinds.items()])
    middle = quantiles_by(unpivot(rows.withColumn("_kind", kind), columns, ["_kind"]), "x", [0.5], ["column", "_kind"])
    of = lambda k: F.max(F.when(F.col("_kind") == k, F.col("edges")[0]))
    gaps = middle.groupBy("column").agg((of("fn") - of("tp")).alias("fn_gap"), (of("fp") - of("tn")).alias("fp_gap"))
    return whole.join(F.broadcast(gaps), "column", "left").select("column", "threshold", "tp", "fp", "fn", "tn", "fn_gap", "fp_gap", "fn_missing", "fp_missing")  # a row a column


def stack_scores(df: DataFrame, y: str, scores: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """(keep..., y, candidate, p): one row a row and candidate, so one plan measures all candidates."""
    options = F.array(*[F.struct(F.lit(k).alias("candidate"), c.cast("double").alias("p")) for k, c in scores.items()])
    return df.select(*(keep or []), F.col(y).alias("y"), F.explode(options).alias("s")).select(*(keep or []), "y", "s.candidate", "s.p")
