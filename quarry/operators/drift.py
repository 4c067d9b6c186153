"""Drift between an early and a late part, ranks and quantiles. ``late`` is a boolean column; statistics of many columns come from
one pass over an unpivoted table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.schema import finite, quantiles_by, running_totals, unpivot

#: Quantiles are exact by default, from counts of values summed in ranges; accuracy (as of percentile_approx, e.g. 10000) asks for sketches.
DECILES = tuple(k / 10 for k in range(11))
FLOOR, LEAST = 1e-4, 50


def quantile_edges(df: DataFrame, columns: list[str], shares: tuple[float, ...] = DECILES, where: Column | None = None, accuracy: int | None = None) -> DataFrame:
    """(column, edges)"""
    rows = unpivot(df if where is None else df.where(where), columns, [])
    return quantiles_by(rows, "x", shares, ["column"], accuracy)


def decile_histogram(df: DataFrame, columns: list[str], late: str, accuracy: int | None = None) -> DataFrame:
    """(column, bin, early, late): counts in the early part's deciles. Equal edges are one; the outer ones are open; a value on
    an edge belongs above it."""
    rows = unpivot(df, columns, [late])
    edges = quantiles_by(rows.where(~F.col(late)), "x", DECILES, ["column"], accuracy).withColumn("edges", F.array_distinct("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = rows.join(F.broadcast(edges), "column").withColumn("bin", F.aggregate(inner, F.lit(0), lambda a, e: a + (F.col("x") >= e).cast("int")))  # edges: a row a column
    counts = binned.groupBy("column", "bin", "edges").agg(F.count_if(~F.col(late)).alias("early"), F.count_if(F.col(late)).alias("late"))
    return counts.select("column", "bin", "early", "late", F.size("edges").alias("n_edges"))


def psi(df: DataFrame, columns: list[str], late: str, accuracy: int | None = None) -> DataFrame:
    """(column, psi): sum of (q - p) ln(q / p) over the early part's deciles, shares at least 1e-4. 0 if either part has
    fewer than 50 numbers or the deciles fewer than 3 different edges."""
    hist = decile_histogram(df, columns, late, accuracy)
    whole = Window.partitionBy("column")  # a row a bin; a bin without rows on either side has twice the least share and adds nothing
    full = hist.withColumns({"ne": F.sum("early").over(whole), "nl": F.sum("late").over(whole)})
    p = F.greatest(F.try_divide(F.col("early"), F.col("ne")), F.lit(FLOOR))
    q = F.greatest(F.try_divide(F.col("late"), F.col("nl")), F.lit(FLOOR))
    total = full.groupBy("column", "n_edges", "ne", "nl").agg(F.sum((q - p) * F.ln(q / p)).alias("s"))
    measured = total.select("column", F.when((F.col("ne") < LEAST) | (F.col("nl") < LEAST) | (F.col("n_edges") < 3), 0.0).otherwise(F.col("s")).alias("psi"))
    return _every(df, columns, measured, "psi", 0.0)


def adversarial_auc(df: DataFrame, columns: list[str], late: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(column, adv_auc): the chance that a late value exceeds an early one, ties half; 0.5 with fewer than 50 on a side.

    Counts by value come first; their running sums are taken in ranges of the values. keep writes the counts, which are read thrice.
    """
    counts = unpivot(df, columns, [late]).groupBy("column", "x").agg(F.count_if(~F.col(late)).alias("e"), F.count_if(F.col(late)).alias("l"))
    pairs = running_totals(keep(counts) if keep else counts, "x", ["e"], ["column"]).withColumn("under", F.col("cum_e") - F.col("e"))
    got = pairs.groupBy("column").agg(F.sum("e").alias("ne"), F.sum("l").alias("nl"), F.sum(F.col("l") * (F.col("under") + F.col("e") / 2.0)).alias("s"))
    measured = got.select("column", F.when((F.col("ne") < LEAST) | (F.col("nl") < LEAST), 0.5).otherwise(F.try_divide(F.col("s"), F.col("ne") * F.col("nl"))).alias("adv_auc"))
    return _every(df, columns, measured, "adv_auc", 0.5)


def _every(df: DataFrame, columns: list[str], measured: DataFrame, name: str, default: float) -> DataFrame:
    """A row for each column, those without any number too."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(measured, "column", "left").select("column", F.coalesce(name, F.lit(default)).alias(name))


def stability(df: DataFrame, columns: list[str], late: str, psi_max: float = 0.25, band: float = 0.15, accuracy: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(column, psi, adv_auc, stable)"""
    both = psi(df, columns, late, accuracy).join(adversarial_auc(df, columns, late, keep), "column")
    return both.withColumn("stable", (F.col("psi") <= psi_max) & (F.abs(F.col("adv_auc") - 0.5) <= band))


def drift_table(df: DataFrame, numbers: list[str], categories: list[str], late: str, unseen_max: float = 0.2, **limits) -> DataFrame:
    """(column, kind, psi, adv_auc, unseen, shifted): numbers by the stability screen, categories by their unseen share."""
    out = None
    if numbers:
        out = stability(df, numbers, late, **limits).select("column", F.lit("numeric").alias("kind"), "psi", "adv_auc", F.lit(None).cast("double").alias("unseen"), (~F.col("stable")).alias("shifted"))
    if categories:
        from quarry.operators.encode import unseen_rate

        cats = unseen_rate(df.where(~F.col(late)), df.where(F.col(late)), categories)
        cats = cats.select("column", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("psi"), F.lit(None).cast("double").alias("adv_auc"), F.col("unseen_rate").alias("unseen"), (F.col("unseen_rate") > unseen_max).alias("shifted"))
        out = cats if out is None else out.unionByName(cats)
    return out


def average_rank(c: str, by: list[str] | None = None) -> Column:
    """1-based rank with ties sharing their mean."""
    keys = by or [F.lit(0)]
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0


def spearman(df: DataFrame, columns: list[str], rid: str) -> DataFrame:
    """(a, b, rho) for a before b in ``columns``: correlation of average ranks over rows without a missing value.

    The ranks of all columns come from running sums of (column, value) counts, then one aggregate has all pairs.
    """
    whole = df.dropna(subset=columns)
    rows = unpivot(whole, columns, [rid])
    counts = rows.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(counts, "x", ["n"], ["column"]).select("column", "x", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("r"))
    wide = rows.join(ranks, ["column", "x"]).groupBy(rid).agg(*[F.max(F.when(F.col("column") == c, F.col("r"))).alias(f"r{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    got = wide.agg(*[F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in pairs])
    return got.select(F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"c{i}_{j}").alias("rho")) for i, j in pairs])).alias("p")).select("p.*")


def deduplicate(df: DataFrame, columns: list[str], rid: str, limit: float = 0.95) -> list[str]:
    """The columns that stay, in order: each is dropped if it follows a kept one with |rho| of at least ``limit``."""
    near = {(r["a"], r["b"]) for r in spearman(df, columns, rid).where(F.abs(F.col("rho")) >= limit).collect()} if len(columns) > 1 else set()
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in near for k in kept):
            kept.append(c)
    return kept


def stump_gain(df: DataFrame, columns: list[str], target: str, bins: int = 64, accuracy: int | None = None) -> DataFrame:
    """(column, gain): the largest share of the target's variance that one split at a quantile edge explains."""
    rows = unpivot(df, columns, [target])
    shares = [k / bins for k in range(1, bins)]
    edges = quantiles_by(rows, "x", shares, ["column"], accuracy).withColumn("edges", F.array_distinct("edges"))
    binned = rows.join(F.broadcast(edges), "column").withColumn("bin", F.aggregate("edges", F.lit(0), lambda a, e: a + (F.col("x") >= e).cast("int")))  # a row a column
    sums = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("q"))
    below, every = Window.partitionBy("column").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("column")
    cut = sums.withColumns({"nl": F.sum("n").over(below), "sl": F.sum("s").over(below), "nt": F.sum("n").over(every), "st": F.sum("s").over(every), "qt": F.sum("q").over(every)})
    nr, sr = F.col("nt") - F.col("nl"), F.col("st") - F.col("sl")
    between = F.col("sl") * F.col("sl") / F.col("nl") + F.try_divide(sr * sr, nr) - F.col("st") * F.col("st") / F.col("nt")
    var = F.col("qt") - F.col("st") * F.col("st") / F.col("nt")
    return cut.groupBy("column").agg(F.coalesce(F.max(F.when(F.col("nl").isNotNull(), F.try_divide(between, var))), F.lit(0.0)).alias("gain"))


def class_gap(df: DataFrame, columns: list[str], first: Column, second: Column, top: int = 5) -> DataFrame:
    """(column, gap): the ``top`` columns by |median of first rows - median of second rows| over the interquartile range."""
    each = unpivot(df.withColumns({"_a": first, "_b": second}), columns, ["_a", "_b"])
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("_a"), "first"), F.when(F.col("_b"), "second")))
    found = quantiles_by(each.select("column", "x", F.explode(kinds).alias("kind")), "x", [0.25, 0.5, 0.75], ["column", "kind"])
    of = lambda kind, k: F.max(F.when(F.col("kind") == kind, F.col("edges")[k]))
    gap = F.try_divide(of("first", 1) - of("second", 1), of("all", 2) - of("all", 0))
    return found.groupBy("column").agg(gap.alias("gap")).where("gap is not null").orderBy(F.desc(F.abs(F.col("gap"))), "column").limit(top)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with missing numbers of the columns replaced by the median of the others; 0 if there is none."""
    middle = quantiles_by(unpivot(df, columns, []), "x", [0.5], ["column"])
    med = middle.agg(*[F.max(F.when(F.col("column") == c, F.col("edges")[0])).alias(f"_m{i}") for i, c in enumerate(columns)])
    return df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"_m{i}"), F.lit(0.0)) for i, c in enumerate(columns)}).drop(*[f"_m{i}" for i in range(len(columns))])  # one row


#: Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9): numerator and
#: denominator in the middle, then in the tails, highest power first; and where the lower tail ends.
_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAILS = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
_TAIL = 0.02425


def normal_quantile(share: Column) -> Column:
    """The standard normal's quantile of a share between 0 and 1; shares nearer to either than 1e-12 count as that."""
    p = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    power = lambda cs, x: reduce(lambda a, c: a * x + F.lit(c), cs[1:], F.lit(cs[0]))
    middle, square = p - 0.5, (p - 0.5) * (p - 0.5)
    far = lambda q: (lambda x: power(_TAILS[0], x) / power(_TAILS[1], x))(F.sqrt(-2 * F.ln(q)))
    inner = power(_MIDDLE[0], square) * middle / power(_MIDDLE[1], square)
    return F.when(share.isNotNull(), F.when(p < _TAIL, far(p)).when(p > 1 - _TAIL, -far(1 - p)).otherwise(inner))


def inverse_normal(df: DataFrame, columns: list[str], rid: str) -> DataFrame:
    """df with <c>_z: the normal quantile of each value's rank share (average rank - 0.5) / n."""
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        run = running_totals(counts, "_v", ["_n"])
        ranks = run.select("_v", normal_quantile((F.col("cum__n") - F.col("_n") / 2.0) / F.col("total__n")).alias(f"{c}_z"))  # once a value
        df = df.join(ranks, df[c] == F.col("_v"), "left").drop("_v")
    return df
