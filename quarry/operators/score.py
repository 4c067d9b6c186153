"""Residual scoring of candidates: cross-fitted ridge residuals, correlation with the model's residual, greedy entry, step-up
selection and noise floors.

All linear algebra comes from one aggregate: the cross-products of base columns, candidates and residual by fold. It
holds (k + 2)**2 sums a fold whatever the number of rows; a fold's regression uses the totals less its own sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.drift import impute_median
from quarry.operators.split import lottery, stratified_folds  # noqa: F401  (folds are part of this module's interface)
from quarry.plans.schema import with_position


def residual(df: DataFrame, y: str, p: str | None, name: str = "residual") -> DataFrame:
    """df with y - p; without p, y less its mean."""
    if p:
        return df.withColumn(name, F.col(y) - F.col(p))
    mean = df.agg(F.avg(y).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(name, F.col(y) - F.col("_mean")).drop("_mean")  # one row


def shuffled_folds(df: DataFrame, rid: str, k: int, seed: int = 0, name: str = "_fold") -> DataFrame:
    """k folds by the row's ticket: no sort is needed, sizes are equal up to chance."""
    return df.withColumn(name, F.pmod(F.conv(F.substring(lottery(seed, rid), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


@dataclass
class Gram:
    """Sums of products of (1, columns...) by fold."""

    columns: list[str]
    folds: list[int]
    sums: np.ndarray  # folds x (k + 1) x (k + 1)

    def total(self, without: int | None = None) -> np.ndarray:
        return self.sums.sum(axis=0) - (self.sums[without] if without is not None else 0)

    def place(self, names: list[str]) -> list[int]:
        return [1 + self.columns.index(n) for n in names]


def gram(df: DataFrame, columns: list[str], fold: str) -> Gram:
    """One pass over the rows; columns must hold numbers without nulls."""
    aggs, at = [F.count(F.lit(1)).cast("double").alias("s0_0")], [(0, 0)]
    for i, a in enumerate(columns, 1):
        aggs.append(F.sum(F.col(a).cast("double")).alias(f"s0_{i}"))
        at.append((0, i))
        for j, b in enumerate(columns[i - 1 :], i):
            aggs.append(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{i}_{j}"))
            at.append((i, j))
    rows = df.groupBy(fold).agg(*aggs).orderBy(fold).collect()
    sums = np.zeros((len(rows), len(columns) + 1, len(columns) + 1))
    for r, row in enumerate(rows):
        for i, j in at:
            sums[r, i, j] = sums[r, j, i] = row[f"s{i}_{j}"] or 0.0
    return Gram(list(columns), [row[fold] for row in rows], sums)


def ridge(g: np.ndarray, base: list[int], targets: list[int], alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients for standardised base columns: (means, scales, weights [base x targets], target means)."""
    n = max(g[0, 0], 1.0)
    mean, tmean = g[0, base] / n, g[0, targets] / n
    cov = g[np.ix_(base, base)] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1.0
    a = cov / np.outer(scale, scale) * n + alpha * np.eye(len(base))
    b = (g[np.ix_(base, targets)] / n - np.outer(mean, tmean)) / scale[:, None] * n
    return mean, scale, np.linalg.solve(a, b) if base else np.zeros((0, len(targets))), tmean


def residual_moments(g: Gram, base: list[str], candidates: list[str], r: str, alpha: float = 1.0) -> dict[str, tuple[float, float, float, float, float, float]]:
    """Of each candidate, the sums over all rows that its score needs: n, sum e, sum e**2, sum e*r, sum r, sum r**2 with e the
    out-of-fold ridge residual of the candidate on the base columns - from the cross-products alone."""
    b, c, rr = g.place(base), g.place(candidates), g.place([r])[0]
    out = np.zeros((len(candidates), 6))
    for k in range(len(g.folds)):
        mean, scale, w, tmean = ridge(g.total(k), b, c, alpha)
        own = g.sums[k]
        slope = w / scale[:, None]
        const = tmean - mean @ slope
        for i, col in enumerate(c):
            # e = candidate - const - base @ slope, written as a combination of (1, columns...)
            v = np.zeros(own.shape[0])
            v[col] += 1
            v[0] -= const[i]
            v[b] -= slope[:, i]
            ev = own @ v
            out[i] += own[0, 0], ev[0], v @ ev, ev[rr], own[0, rr], own[rr, rr]
    return {name: tuple(row) for name, row in zip(candidates, out.tolist(), strict=True)}


def correlation(moments: tuple[float, ...], raw_variance: float, least: float = 1e-6) -> float:
    """corr(e, r); 0 if e keeps no more than ``least`` of the candidate's variance, or nothing varies."""
    n, se, see, ser, sr, srr = moments
    if n < 2:
        return 0.0
    ve, vr = see / n - (se / n) ** 2, srr / n - (sr / n) ** 2
    if ve <= least * raw_variance or ve <= 0 or vr <= 0:
        return 0.0
    return (ser / n - se * sr / n**2) / math.sqrt(ve * vr)


def scores_of(g: Gram, base: list[str], candidates: list[str], r: str, alpha: float = 1.0) -> dict[str, float]:
    t = g.total()
    n = max(t[0, 0], 1.0)
    raw = {c: t[i, i] / n - (t[0, i] / n) ** 2 for c, i in zip(candidates, g.place(candidates), strict=True)}
    return {c: correlation(m, raw[c]) for c, m in residual_moments(g, base, candidates, r, alpha).items()}


def candidate_scores(df: DataFrame, base: list[str], candidates: list[str], r: str, rid: str, folds: int = 5, seed: int = 0, alpha: float = 1.0) -> dict[str, float]:
    """Correlation of each candidate's cross-fitted residual with r. Missing numbers take the column's median."""
    columns = list(dict.fromkeys([*base, *candidates]))
    rows = shuffled_folds(impute_median(df.select(rid, r, *columns), columns), rid, folds, seed)
    return scores_of(gram(rows, [*columns, r], "_fold"), base, candidates, r, alpha)


def entry_threshold(positives: int, alpha: float = 0.05) -> float:
    """z(1 - alpha) over the square root of the positives."""
    return NormalDist().inv_cdf(1 - alpha) / math.sqrt(max(positives, 1))


def greedy_entry(g: Gram, base: list[str], candidates: list[str], r: str, threshold: float, most: int = 12, alpha: float = 1.0) -> tuple[list[str], dict[str, float]]:
    """Candidates that enter one by one, the strongest first (ties: the earlier), each judged given those before; and all
    first-pass scores. Every step is algebra on the same cross-products."""
    entered, first, pool = [], {}, list(candidates)
    while pool and len(entered) < most:
        s = scores_of(g, base + entered, pool, r, alpha)
        first = first or s
        best = max(pool, key=lambda c: abs(s[c]))
        if abs(s[best]) < threshold:
            break
        entered.append(best)
        pool.remove(best)
    return entered, first


def residualise(df: DataFrame, base: list[str], target: str, fold: str, name: str, alpha: float = 1.0) -> DataFrame:
    """df with the target's out-of-fold ridge residual: a fold's coefficients, from the other folds, become one Column."""
    g = gram(df, [*base, target], fold)
    out = None
    for k, f in enumerate(g.folds):
        mean, scale, w, tmean = ridge(g.total(k), g.place(base), g.place([target]), alpha)
        fitted = F.lit(float(tmean[0]))
        for c, m, s, b in zip(base, mean.tolist(), scale.tolist(), w[:, 0].tolist(), strict=True):
            fitted = fitted + F.lit(b) * (F.col(c) - F.lit(m)) / F.lit(s)
        value = F.col(target) - fitted
        out = F.when(F.col(fold) == f, value) if out is None else out.when(F.col(fold) == f, value)
    return df.withColumn(name, out if out is not None else F.lit(None).cast("double"))


def correlation_scores(df: DataFrame, candidates: list[str], r: str) -> DataFrame:
    """(column, score): plain correlation of each candidate with r over rows where both are there; 0 if nothing varies."""
    got = df.agg(*[F.corr(c, r).alias(f"c{i}") for i, c in enumerate(candidates)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.nanvl(f"c{i}", F.lit(0.0)), F.lit(0.0)).alias("score")) for i, c in enumerate(candidates)])).alias("r")).select("r.*")


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc(F.abs(F.col("score"))), "column").limit(k)


def step_up(tests: DataFrame, p: str, key: str, q: float = 0.1) -> DataFrame:
    """tests with (rank, adjusted, selected) by Benjamini-Hochberg: all up to the last rank k with p <= q k / m.

    Ranks are numbered in ranges by many tasks; the minimum from the end is taken in stretches of ranks, and the
    minima of the later stretches, one a stretch, are carried.
    """
    spark, m = tests.sparkSession, tests.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = with_position(tests, [p, key], "_at").withColumn("rank", (F.col("_at") + 1).cast("int"))
    marked = placed.withColumns({"_value": F.col(p) * F.lit(m) / F.col("rank"), "_part": F.floor(F.col("_at") * parts / max(m, 1)).cast("int")})
    least = dict(marked.groupBy("_part").agg(F.min("_value")).collect())  # as many rows as stretches
    later, carried = None, []
    for k in sorted(least, reverse=True):
        carried.append((k, later))
        later = min((v for v in (later, least[k]) if v is not None), default=None)
    carried = spark.createDataFrame(carried, "_p int, _later double")
    from_end = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = F.least(F.lit(1.0), F.min("_value").over(from_end), F.col("_later"))
    ranked = marked.join(F.broadcast(carried), F.col("_part") == F.col("_p")).withColumn("adjusted", adjusted)
    return ranked.select(*tests.columns, "rank", "adjusted", (F.col("adjusted") <= q).alias("selected"))


def noise_floor(scores: DataFrame, seat: str, key: str, threshold: float, most: int) -> DataFrame:
    """Of each seat, at most ``most`` candidates whose |score| reaches the seat's floor: the threshold or the largest |score| of
    its noise columns (is_noise), whichever is larger."""
    w = Window.partitionBy(seat)
    floor = F.greatest(F.lit(threshold), F.coalesce(F.max(F.when(F.col("is_noise"), F.abs(F.col("score")))).over(w), F.lit(0.0)))
    kept = scores.withColumn("floor", floor).where(~F.col("is_noise") & (F.abs(F.col("score")) >= F.col("floor")))
    order = Window.partitionBy(seat).orderBy(F.desc(F.abs(F.col("score"))), key)
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def trailing_check(df: DataFrame, base: list[str], entered: list[str], r: str, rid: str, pos: str, first_scores: dict[str, float], cycle: int, threshold: float, share: float = 0.3, **kw) -> dict[str, bool]:
    """Whether each entered candidate holds over the last share of the rows: in cycle 1 its sign stays; later, |score| also
    reaches half the threshold with the sign kept."""
    n = df.count()
    tail = df.where(F.col(pos) >= n - round(share * n))
    s = candidate_scores(tail, base, entered, r, rid, **kw)
    same = {c: s[c] * first_scores[c] > 0 for c in entered}
    return same if cycle == 1 else {c: same[c] and abs(s[c]) >= threshold / 2 for c in entered}
