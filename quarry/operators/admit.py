"""Permutation importance, shadow references and exits. Permutations are deterministic: a column's values are dealt to the rows in
the order of their tickets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.metrics import average_precision
from quarry.operators.split import lottery
from quarry.plans.schema import cut_lineage, together, with_position

#: Permuted columns that one plan joins to the rows.
JOINED = 8


def permute(df: DataFrame, column: str, rid: str, seed: int | str = 0, within: str | None = None, name: str | None = None) -> DataFrame:
    """df with the column's values dealt anew over all rows, or within groups.

    The k-th row by id takes the value of the k-th row by ticket. Both orders are numbered in ranges by many tasks.
    """
    name = name or f"{column}_shuffled"
    if within:
        base = df.select(rid, column, within).withColumn("_ticket", _ticket(column, rid, seed))
        dealt = base.select(within, F.row_number().over(Window.partitionBy(within).orderBy("_ticket", rid)).alias("_k"), F.col(column).alias(name))
        rows = df.withColumn("_k", F.row_number().over(Window.partitionBy(within).orderBy(rid)))
        return rows.join(dealt.withColumnRenamed(within, "_w"), (F.col(within).eqNullSafe(F.col("_w"))) & (rows["_k"] == dealt["_k"])).drop(dealt["_k"]).drop("_k", "_w")
    return with_position(df, [rid], "_k").join(_dealt(df, column, rid, seed, name), "_k").drop("_k")


def _ticket(column: str, rid: str, seed: int | str) -> Column:
    return F.conv(F.substring(lottery(f"{seed}|{column}", rid), 1, 13), 16, 10).cast("long")


def _dealt(df: DataFrame, column: str, rid: str, seed: int | str, name: str) -> DataFrame:
    """(_k, name): the column's values in the order of their tickets."""
    return with_position(df.select(rid, column).withColumn("_ticket", _ticket(column, rid, seed)), ["_ticket", rid], "_k").select("_k", F.col(column).alias(name))


def with_permuted(df: DataFrame, columns: list[str], rid: str, seed: int | str = 0, within: str | None = None, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, list[str]]:
    """df, written by keep, with each column permuted as permute() does it, and the new columns' names. Rows are numbered by id once for all columns."""
    names = [f"_moved{i}" for i in range(len(columns))]
    if within:
        for c, n in zip(columns, names, strict=True):
            df = permute(df, c, rid, seed, within, n)
        return keep(df), names
    dealt = together(df.sparkSession, [lambda c=c, n=n: _dealt(df, c, rid, seed, n) for c, n in zip(columns, names, strict=True)])
    out = with_position(df, [rid], "_k")
    for i, values in enumerate(dealt):
        out = (keep(out) if i and i % JOINED == 0 else out).join(values, "_k")
    return keep(out.drop("_k")), names


def with_shadows(df: DataFrame, columns: list[str], rid: str, seed: int | str = 0) -> tuple[DataFrame, list[str]]:
    """df with a shadow of each column, and their names: the columns' values dealt together to other rows, so that shadows
    relate to each other as the columns do and to nothing else. One deal, whatever the number of columns."""
    names = [f"{c}__shadow" for c in columns]
    dealt = with_position(df.select(rid, _ticket("shadow", rid, seed).alias("_ticket"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]), ["_ticket", rid], "_k").select("_k", *names)
    return with_position(df, [rid], "_k").join(dealt, "_k").drop("_k"), names


def permutation_importance(df: DataFrame, y: str, features: list[str], rid: str, predict: Callable[[DataFrame], DataFrame], seed: int = 0, by: list[str] | None = None, within: str | None = None, keep: Callable[[DataFrame], DataFrame] = cut_lineage, wide: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """(by..., feature, importance): average precision lost when the feature is permuted. predict adds a column p.

    All permuted values are written beside the rows. From there each row is stacked as it is and once for every feature with that feature's
    value moved, so that predict may read the stack as often as it likes without another shuffle. wide is what with_permuted() gave, where the caller has it.
    """
    by = by or []
    wide, moved = wide or with_permuted(df, features, rid, seed, within, keep)
    stacked = wide.withColumn("feature", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in features])))
    stacked = stacked.withColumns({f: F.when(F.col("feature") == f, F.col(m)).otherwise(F.col(f)) for f, m in zip(features, moved, strict=True)}).drop(*moved)
    aps = average_precision(predict(stacked), y, "p", [*by, "feature"])
    plain = F.max(F.when(F.col("feature").isNull(), F.col("ap"))).over(Window.partitionBy(*(by or [F.lit(0)])))  # of a row a feature
    return aps.select(*by, "feature", (plain - F.col("ap")).alias("importance")).where("feature is not null")


def shadow_admit(importance: DataFrame, shadows: list[str], by: str) -> DataFrame:
    """(feature): those whose importance exceeds every shadow's in each group of ``by``."""
    is_shadow = F.col("feature").isin(shadows)
    best = importance.where(is_shadow).groupBy(by).agg(F.max("importance").alias("_best"))
    real = importance.where(~is_shadow).join(best, by, "left")
    return real.groupBy("feature").agg(F.min((F.col("importance") > F.coalesce("_best", F.lit(0.0))).cast("int")).alias("all")).where("all = 1").select("feature")


def exits(importance: DataFrame, most: int = 2) -> DataFrame:
    """At most ``most`` features of no or negative importance, the worst first."""
    return importance.where("importance <= 0").orderBy("importance", "feature").limit(most)
