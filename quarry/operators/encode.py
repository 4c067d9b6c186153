"""Encodings of categories. Null is a category of its own; lookups are null-safe. Every encoding is a grouped aggregate
joined back, so no pass over the rows is needed per fold or block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.schema import with_position

ALPHA = 20.0


def smoothed(total: Column, n: Column, prior: Column | float, alpha: float = ALPHA) -> Column:
    return (total + F.lit(alpha) * prior) / (n + alpha)


def target_map(df: DataFrame, c: str, y: str, alpha: float = ALPHA) -> DataFrame:
    """(c, n, te): the smoothed mean label of each value."""
    mean = df.agg(F.avg(y).alias("_mean"))
    sums = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("_s"))
    return sums.crossJoin(F.broadcast(mean)).select(c, "n", smoothed(F.col("_s"), F.col("n"), F.col("_mean"), alpha).alias("te"))  # mean has one row


def lookup(df: DataFrame, table: DataFrame, c: str, value: str, default: float | Column, name: str) -> DataFrame:
    """df with table's value for its category; default where the table lacks it. Spark chooses the join by the table's size."""
    side = table.select(F.col(c).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_met"))
    default = default if isinstance(default, Column) else F.lit(default)
    return df.join(side, df[c].eqNullSafe(side["_key"]), "left").withColumn(name, F.when(F.col("_met"), F.col("_value")).otherwise(default)).drop("_key", "_value", "_met")


def out_of_fold(df: DataFrame, c: str, y: str, fold: str, alpha: float = ALPHA) -> DataFrame:
    """df with te_oof and freq_oof: what the other folds say of the row's value. Unseen there: their mean label, and 0.

    One aggregate by (value, fold) serves all folds: the other folds' sums are the value's sums less the fold's own.
    """
    cell = df.groupBy(c, fold).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))
    whole = Window.partitionBy(c)
    cell = cell.select(F.col(c).alias("_c"), F.col(fold).alias("_f"), (F.sum("_n").over(whole) - F.col("_n")).alias("_on"), (F.sum("_s").over(whole) - F.col("_s")).alias("_os"))
    folds = df.groupBy(fold).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))  # one row a fold
    every = Window.partitionBy(F.lit(0))
    folds = folds.select(F.col(fold).alias("_g"), (F.sum("_n").over(every) - F.col("_n")).alias("_tn"), (F.sum("_s").over(every) - F.col("_s")).alias("_ts"))
    out = df.join(cell, df[c].eqNullSafe(F.col("_c")) & (df[fold] == F.col("_f"))).join(F.broadcast(folds), F.col(fold) == F.col("_g"))
    prior = F.try_divide(F.col("_ts"), F.col("_tn"))
    te = F.when(F.col("_on") > 0, smoothed(F.col("_os"), F.col("_on"), prior, alpha)).otherwise(prior)
    return out.withColumns({"te_oof": te, "freq_oof": F.coalesce(F.try_divide(F.col("_on"), F.col("_tn")), F.lit(0.0))}).drop("_c", "_f", "_on", "_os", "_g", "_tn", "_ts")


def expanding_blocks(df: DataFrame, c: str, y: str, block: str, alpha: float = ALPHA, first: float = 0.5) -> DataFrame:
    """df with te_exp: the smoothed mean label of the row's value over earlier blocks; ``first`` in the first block."""
    cell = df.groupBy(c, block).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))
    past = Window.partitionBy(c).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.select(F.col(c).alias("_c"), F.col(block).alias("_b"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_pn"), F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_ps"))
    blocks = df.groupBy(block).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))  # one row a block
    before = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(block).alias("_g"), F.sum("_n").over(before).alias("_tn"), F.sum("_s").over(before).alias("_ts"))
    out = df.join(cell, df[c].eqNullSafe(F.col("_c")) & (df[block] == F.col("_b"))).join(F.broadcast(blocks), F.col(block) == F.col("_g"))
    te = F.when(F.col("_tn").isNull(), F.lit(first)).otherwise(smoothed(F.col("_ps"), F.col("_pn"), F.col("_ts") / F.col("_tn"), alpha))
    return out.withColumn("te_exp", te).drop("_c", "_b", "_pn", "_ps", "_g", "_tn", "_ts")


def forward(df: DataFrame, c: str, y: str, pos: str, blocks: int = 64, alpha: float = ALPHA) -> DataFrame:
    """df with te_fwd and freq_fwd: each row sees the rows before its position only.

    The prior is (positives before + 1) / (position + 2). The running sum over all rows is taken in ranges of
    positions, each by its own task, plus the sums of the ranges before.
    """
    past = Window.partitionBy(c).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    n = df.agg(F.max(pos)).first()[0]
    size = max(1, -(-((n or 0) + 1) // blocks))
    df = df.withColumn("_range", F.floor(F.col(pos) / size).cast("int"))
    sums = {r["_range"]: r["s"] for r in df.groupBy("_range").agg(F.sum(y).alias("s")).collect()}  # at most `blocks` rows
    start, at = {}, 0
    for k in sorted(sums):
        start[k] = at
        at += sums[k] or 0
    offset = F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("_range")] if start else F.lit(0)
    inside = Window.partitionBy("_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(y).over(inside), F.lit(0)) + offset
    prior = (seen + 1) / (F.col(pos) + 2)
    count, total = F.coalesce(F.count(F.lit(1)).over(past), F.lit(0)), F.coalesce(F.sum(y).over(past), F.lit(0))
    return df.withColumns({"te_fwd": smoothed(total, count, prior, alpha), "freq_fwd": count / F.greatest(F.col(pos), F.lit(1))}).drop("_range")


def frequency_map(df: DataFrame, c: str) -> DataFrame:
    """(c, n, freq): the share of each value, null included."""
    whole = df.agg(F.count(F.lit(1)).alias("_all"))
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole)).select(c, "n", (F.col("n") / F.col("_all")).alias("freq"))  # one row


def sorted_codes(df: DataFrame, c: str) -> DataFrame:
    """(c, code): values numbered from 0 in string order; null is its own category, named as such."""
    values = df.select(F.col(c), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("_s")).distinct()
    codes = with_position(values.select("_s").distinct(), ["_s"], "code")
    return values.join(codes, "_s").select(c, F.col("code").cast("int").alias("code"))


def appearance_codes(df: DataFrame, c: str, pos: str) -> DataFrame:
    """(c, code): values that aren't null numbered from 0 by their first row."""
    firsts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(pos).alias("_at"))
    return with_position(firsts, ["_at"], "code").select(c, F.col("code").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, c: str, name: str) -> DataFrame:
    """df with the code of its value; -1 where there is none."""
    return lookup(df, codes, c, "code", -1, name)


def unseen_rate(early: DataFrame, late: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unseen_rate): the share of late rows whose value is not among the early ones; null is a value."""
    out = None
    for c in columns:
        known = early.select(F.col(c).alias("_v")).distinct().withColumn("_met", F.lit(1))
        met = late.join(known, late[c].eqNullSafe(known["_v"]), "left").agg((F.count_if(F.col("_met").isNull()) / F.count(F.lit(1))).alias("unseen_rate"))
        row = met.select(F.lit(c).alias("column"), "unseen_rate")
        out = row if out is None else out.unionByName(row)
    return out


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with te_std (population), te_range and, for each column, <c>_delta: its value less the mean of the others."""
    k = len(columns)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    mean = total / k
    var = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in columns[1:]), (F.col(columns[0]) - mean) * (F.col(columns[0]) - mean)) / k
    deltas = {f"{c}_delta": F.col(c) - (total - F.col(c)) / (k - 1) for c in columns} if k > 1 else {f"{c}_delta": F.lit(0.0) for c in columns}
    return df.withColumns({"te_std": F.sqrt(var), "te_range": (F.greatest(*columns) - F.least(*columns)) if k > 1 else F.lit(0.0), **deltas})


def calendar(seconds: Column) -> dict[str, Column]:
    """Time of day as a share of 24 h with its sine and cosine, and the day of the week (Monday 0), of epoch seconds."""
    day = (seconds - F.floor(seconds / 86400.0) * 86400.0) / 86400.0
    angle = day * 2 * 3.141592653589793
    days = F.floor(seconds / 86400.0) + 3
    return {"tod": day, "tod_sin": F.sin(angle), "tod_cos": F.cos(angle), "dow": (days - F.floor(days / 7) * 7).cast("int")}


def log_form(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))
