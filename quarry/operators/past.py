"""Aggregates over the earlier rows of a key, whatever share of all rows one key has.

Rows of a key are in the order of (time, row id). A key of at most ``most_rows`` rows is one window partition. A larger one is cut at
quantiles of its time into stretches of about that many rows; each stretch is a window partition of its own, to which the last rows
before it are copied, as far as bounded frames reach back, and which a small table tells what lies before those.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.schema import cut_lineage

#: Rows that one window partition holds at most, but for rows of one key and one time, which stay together.
MOST_ROWS = 2_000_000
#: Rows of a table sent to all tasks at most; beyond that Spark joins as it sees fit.
BROADCAST_ROWS = 100_000
AGGREGATES = ("count", "sum", "mean", "std", "std_samp", "last", "min", "max")


@dataclass(frozen=True)
class Past:
    """agg of the value column over the last ``window`` rows (0: all) of those at least ``shift`` rows before."""

    agg: str
    value: str | None = None
    window: int = 0
    shift: int = 1

    def __post_init__(self):
        if self.agg not in AGGREGATES or self.window < 0 or self.shift < 1 or (self.value is None) != (self.agg == "count"):
            raise ValueError(f"not an aggregate of earlier rows: {self}")

    @property
    def reach(self) -> int:
        return self.window + self.shift - 1


def _aggregates(p: Past, keys: list[str], time: str, rid: str, ties: bool):
    """A function that takes an aggregate over p's frame; with ties, over that of the first row of the same key and time."""
    frame = Window.partitionBy(*keys).orderBy(time, rid).rowsBetween(-p.reach if p.window else Window.unboundedPreceding, -p.shift)
    tied = Window.partitionBy(*keys, time).orderBy(rid).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lambda agg: F.first(agg.over(frame)).over(tied) if ties else agg.over(frame)


_PLAIN = {"sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "std_samp": F.stddev_samp, "last": F.last, "min": F.min, "max": F.max}


def _column(p: Past, keys: list[str], time: str, rid: str, ties: bool) -> Column:
    return _aggregates(p, keys, time, rid, ties)(F.count(F.lit(1)) if p.agg == "count" else _PLAIN[p.agg](p.value))


def _with_carry(p: Past, carry: str, keys: list[str], time: str, rid: str, ties: bool) -> Column:
    """As _column, in a stretch: together with what the carry (a struct column) has of the rows before. Bounded frames need none."""
    if p.window:
        return _column(p, keys, time, rid, ties)
    seen, before = _aggregates(p, keys, time, rid, ties), F.col(carry)
    rows = seen(F.count(F.lit(1)))
    if p.agg == "count":
        return rows + F.coalesce(before["rows"], F.lit(0))
    old, now = before[f"of_{p.value}"], _column(p, keys, time, rid, ties)
    if p.agg == "last":
        return F.when(rows > 0, now).otherwise(old["last"]["v"])
    if p.agg in ("min", "max"):
        return (F.least if p.agg == "min" else F.greatest)(now, old[p.agg])
    n0, s0, n1 = F.coalesce(old["n"], F.lit(0)), F.coalesce(old["s"], F.lit(0.0)), seen(F.count(p.value))
    s1, n = F.coalesce(seen(F.sum(p.value)), F.lit(0.0)), n0 + n1
    if p.agg == "sum":
        return F.when(n > 0, s0 + s1)
    if p.agg == "mean":
        return F.try_divide(s0 + s1, n)
    apart = F.coalesce(F.try_divide(s1, n1) - F.try_divide(s0, n0), F.lit(0.0))
    spread = F.coalesce(old["spread"], F.lit(0.0)) + F.coalesce(seen(F.var_pop(p.value)) * n1, F.lit(0.0)) + apart * apart * n0 * n1 / F.greatest(n, F.lit(1))
    least = 0 if p.agg == "std" else 1
    return F.when(n > least, F.sqrt(spread / (n - least)))


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def _named(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def large_keys(df: DataFrame, keys: list[str], time: str, most_rows: int) -> DataFrame | None:
    """(_k0.., _cuts): keys of more rows, with the times that cut them; None if there are none. At most rows / most_rows keys and cuts."""
    if df.count() <= most_rows:
        return None
    sizes = cut_lineage(df.groupBy(*_named(keys)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_rows))
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    pieces = -(-most // most_rows)
    known = df.join(_sent(sizes), _same(keys)).groupBy(*[f"_k{i}" for i in range(len(keys))], "_n")
    cuts = known.agg(F.percentile_approx(F.col(time).cast("double"), [k / pieces for k in range(1, pieces)], max(1000, 20 * pieces)).alias("_cuts"))
    share = F.ceil(F.col("_n") / most_rows) / pieces  # a smaller key needs fewer of the cuts
    few = F.filter("_cuts", lambda x, i: F.floor((i + 1) * share) > F.floor(i * share))
    return cut_lineage(cuts.select(*[f"_k{i}" for i in range(len(keys))], F.array_distinct(few).alias("_cuts")))


def _carries(rows: DataFrame, starts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(_k0.., _c, _carry): for each stretch, what all rows before those copied to it come to.

    Sums of squares are taken around the key's mean, so that large values keep their digits.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    means = rows.groupBy(*_named(keys)).agg(*[F.avg(v).alias(f"_mean{i}") for i, v in enumerate(values)], F.lit(0).alias("_one"))
    at = F.size(F.filter("_starts", lambda s: F.col("_pos") >= s["s"] - F.col("_reach"))) - 1  # the stretch whose copied rows, or own, this row is among
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(values):
        x = F.col(v).cast("double") - F.col(f"_mean{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.sum(F.col(v).cast("double")).alias(f"s{i}"), F.sum(x).alias(f"d{i}"), F.sum(x * x).alias(f"q{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.max_by(F.struct("_pos", F.col(v).alias("v")), "_pos").alias(f"last{i}")]
    sums = rows.join(_sent(cut_lineage(means)), _same(keys)).groupBy(*ks, at.alias("_at")).agg(*aggs)
    ranks = starts.select(*ks, F.posexplode("_starts").alias("_at", "start"))
    # a stretch's carry is all sums of smaller _at; its own rank stands first among equals
    both = sums.withColumn("_c", F.lit(None).cast("int")).unionByName(ranks.select(*ks, "_at", F.col("start.c").alias("_c")), allowMissingColumns=True)
    w = Window.partitionBy(*ks).orderBy("_at", F.col("_c").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda how, name: how(name).over(w)
    parts = [run(F.sum, "rows").alias("rows")]
    for i, v in enumerate(values):
        n, d = run(F.sum, f"n{i}"), run(F.sum, f"d{i}")
        spread = F.greatest(run(F.sum, f"q{i}") - F.try_divide(d * d, n), F.lit(0.0))
        parts.append(F.struct(n.alias("n"), run(F.sum, f"s{i}").alias("s"), spread.alias("spread"), run(F.min, f"min{i}").alias("min"), run(F.max, f"max{i}").alias("max"), run(F.max, f"last{i}").alias("last")).alias(f"of_{v}"))
    return both.select(*ks, "_c", F.struct(*parts).alias("_carry")).where("_c is not null")


def with_past(df: DataFrame, keys: list[str], wanted: dict[str, Past], time: str, rid: str, ties: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a column for each of wanted, null where there are no earlier rows (count: 0). Null is a key like others.

    With ties, rows of one key and time don't see each other. Rows of one key and one time are one task's work.
    """
    hot = large_keys(df, keys, time, most_rows)
    plain = {name: _column(p, keys, time, rid, ties) for name, p in wanted.items()}
    if hot is None:
        return df.withColumns(plain)
    ks = [f"_k{i}" for i in range(len(keys))]
    cold = df.join(_sent(hot.drop("_cuts")), _same(keys), "left_anti").withColumns(plain)

    cut = df.join(_sent(hot), _same(keys)).withColumn("_c", F.aggregate("_cuts", F.lit(0), lambda a, b: a + F.coalesce((F.col(time).cast("double") > b).cast("int"), F.lit(0)))).drop("_cuts", *ks)
    cut = cut_lineage(cut.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(time, rid)) - 1))
    sizes = cut.groupBy(*_named(keys), "_c").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*ks).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = cut_lineage(sizes.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct(F.col("_c").alias("c"), "s"))).alias("_starts")))  # a stretch an entry

    reach = max(p.reach for p in wanted.values())
    placed = cut.join(_sent(starts), _same(keys)).drop(*ks).withColumn("_reach", F.lit(reach))
    placed = placed.withColumn("_pos", F.filter("_starts", lambda s: s["c"] == F.col("_c"))[0]["s"] + F.col("_in"))
    values = sorted({p.value for p in wanted.values() if p.value and not p.window})
    carries = cut_lineage(_carries(placed, starts, keys, values))
    copies = F.filter("_starts", lambda s: (s["c"] == F.col("_c")) | (s["c"] > F.col("_c")) & (F.col("_pos") >= s["s"] - F.col("_reach")))
    spread = placed.withColumn("_to", F.explode(F.transform(copies, lambda s: s["c"]))).drop("_starts", "_reach", "_pos", "_in")
    met = spread.join(_sent(carries.withColumnRenamed("_c", "_of")), _same(keys) & (F.col("_to") == F.col("_of"))).drop(*ks, "_of")
    warm = met.withColumns({name: _with_carry(p, "_carry", [*keys, "_to"], time, rid, ties) for name, p in wanted.items()})
    return cold.unionByName(warm.where("_to = _c").drop("_to", "_c", "_carry"))
