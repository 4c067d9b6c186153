"""Causal entity history: what an entity's strictly earlier events say, by window functions (operators/past.py).

Rows of one entity are ordered by (time, row id). Events of the same time never see each other: an aggregate over the
rows before, taken at the head of its group of equal times, holds exactly the strictly earlier events, and the
others of the group take the head's. All requests with the same entity share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, combinations, islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.past import MOST_ROWS, Past, with_past

AGGREGATES = ("count", "repeat", "sum", "mean", "std", "last", "deviation", "time_since")
VALUELESS = frozenset({"count", "repeat", "time_since"})


@dataclass(frozen=True)
class HistorySpec:
    """entity: one or two columns (null is a key); window: the last w visible events, 0 for all; shift: 1 sees up to the
    latest earlier event, more skips as many less one."""

    entity: tuple[str, ...]
    agg: str
    value: str | None = None
    window: int = 0
    shift: int = 1

    def __post_init__(self):
        if self.agg not in AGGREGATES or self.shift < 1 or self.window < 0 or not 1 <= len(self.entity) <= 2:
            raise ValueError(f"not a history request: {self}")
        if (self.value is None) != (self.agg in VALUELESS):
            raise ValueError(f"{self.agg} {'takes no' if self.agg in VALUELESS else 'needs a'} value column")

    @property
    def name(self) -> str:
        return "_".join(["hist", "x".join(self.entity), self.agg, *([self.value] if self.value else []), f"w{self.window}", f"s{self.shift}"])


#: What a request asks of the earlier events, and what it makes of that: its answer without any, and the rest by value and time.
_ASKS = {"count": "count", "repeat": "count", "sum": "sum", "mean": "mean", "std": "std", "last": "last", "deviation": "mean", "time_since": "last"}


def _answer(spec: HistorySpec, got: Column, value: Column, time: Column) -> Column:
    if _ASKS[spec.agg] == "count":
        return got.cast("double") if spec.agg == "count" else (got > 0).cast("double")
    told = {"deviation": value - got, "time_since": time - got}.get(spec.agg, got)
    return F.coalesce(told, F.lit(-1.0 if spec.agg == "time_since" else 0.0))


def with_history(df: DataFrame, specs: Iterable[HistorySpec], time: str, rid: str, forbidden: Iterable[str] = (), names: dict[HistorySpec, str] | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a column a spec (named spec.name, or as names says). The label and the time cannot be values. Entities of more than
    most_rows events are taken in stretches of time (with_past)."""
    specs = list(specs)
    for s in specs:
        if s.value == time or s.value in set(forbidden):
            raise ValueError(f"{s.value} cannot be a history value")
    values = {v: f"_v{i}" for i, v in enumerate(sorted({s.value for s in specs if s.value}))}
    by_entity: dict[tuple[str, ...], list[HistorySpec]] = {}
    for s in specs:
        by_entity.setdefault(s.entity, []).append(s)
    df = df.withColumns({tmp: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v, tmp in values.items()}) if values else df
    for entity, own in by_entity.items():  # one shuffle and sort an entity, whatever the number of its requests
        asked: dict[Past, str] = {}
        answers = {}
        for s in own:
            agg = _ASKS[s.agg]
            past = Past(agg, None if agg == "count" else values[s.value] if s.value else time, s.window, s.shift)
            got = F.col(asked.setdefault(past, f"_p{len(asked)}"))
            answers[(names or {}).get(s, s.name)] = _answer(s, got, F.col(values[s.value]) if s.value else F.lit(0.0), F.col(time))
        df = with_past(df, list(entity), {n: p for p, n in asked.items()}, time, rid, ties=True, most_rows=most_rows)
        df = df.withColumns(answers).drop(*asked.values())
    return df.drop(*values.values())


def query_history(history: DataFrame, queries: DataFrame, specs: Iterable[HistorySpec], time: str, rid: str, **kw) -> DataFrame:
    """History columns of the query rows, which see the history's events and earlier query rows."""
    both = history.withColumn("_query", F.lit(False)).unionByName(queries.withColumn("_query", F.lit(True)), allowMissingColumns=True)
    return with_history(both, specs, time, rid, **kw).where("_query").drop("_query")


#: How many entities, pairs of them and numbers the library asks about, and its aggregates in order.
LIBRARY_ENTITIES, LIBRARY_PAIRS, LIBRARY_NUMBERS = 4, 3, 3
LIBRARY_AGGREGATES = ("count", "repeat", "time_since", "deviation")


def history_library(entities: list[str], numbers: list[str], timed: bool = True) -> list[HistorySpec]:
    """The fixed requests: every library aggregate of every key, keys being the first entities and their first pairs."""
    singles = combinations(entities[:LIBRARY_ENTITIES], 1)
    pairs = islice(combinations(entities[:LIBRARY_ENTITIES], 2), LIBRARY_PAIRS)
    asked = [(a, v) for a in LIBRARY_AGGREGATES if timed or a != "time_since" for v in ((None,) if a in VALUELESS else numbers[:LIBRARY_NUMBERS])]
    return [HistorySpec(key, a, v) for key, (a, v) in product(chain(singles, pairs), asked)]


def rolling_grid(entity: str, value: str, aggs: Iterable[str], windows: Iterable[int]) -> list[HistorySpec]:
    return [HistorySpec((entity,), a, value, w) for a in aggs for w in windows]


# ------------------------------------------------------------------ the bank: row order, so ties do see earlier rows


def prior_count(df: DataFrame, keys: list[str], time: str, rid: str, name: str, **kw) -> DataFrame:
    return with_past(df, keys, {name: Past("count")}, time, rid, **kw)


def gap(df: DataFrame, keys: list[str], time: str, rid: str, name: str, **kw) -> DataFrame:
    """Seconds since the row before; null at the first."""
    return lagged(df, keys, time, 1, time, rid, name, **kw).withColumn(name, F.col(time) - F.col(name))


def mean_ratio(df: DataFrame, keys: list[str], value: str, time: str, rid: str, name: str, **kw) -> DataFrame:
    """value / (|mean of earlier values| + 1) over values that aren't null; null without any."""
    return with_past(df, keys, {name: Past("mean", value)}, time, rid, **kw).withColumn(name, F.col(value) / (F.abs(F.col(name)) + 1))


def prior_distinct(df: DataFrame, entity: str, other: str, time: str, rid: str, name: str, **kw) -> DataFrame:
    """How many different values of ``other`` the entity had in its rows before."""
    marked = prior_count(df, [entity, other], time, rid, "_fresh", **kw).withColumn("_fresh", (F.col("_fresh") == 0).cast("long"))
    return with_past(marked, [entity], {name: Past("sum", "_fresh")}, time, rid, **kw).withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long")).drop("_fresh")


# ------------------------------------------------------------------ template aggregates

_SAMPLE = {"mean": "mean", "sum": "sum", "max": "max", "min": "min", "std": "std_samp"}


def rolling(df: DataFrame, entity: str, value: str, window: int, time: str, rid: str, names: dict[str, str], shift: int = 1, **kw) -> DataFrame:
    """A column for each of names {name: mean, sum, max, min or std (sample)}: over the ``window`` rows that end ``shift`` rows before; null if none."""
    return with_past(df, [entity], {n: Past(_SAMPLE[how], value, window, shift) for n, how in names.items()}, time, rid, **kw)


def lagged(df: DataFrame, keys: list[str], value: str, shift: int, time: str, rid: str, name: str, **kw) -> DataFrame:
    return with_past(df, keys, {name: Past("last", value, 1, shift)}, time, rid, **kw)


def expanding(df: DataFrame, entity: str, value: str, time: str, rid: str, names: dict[str, str], **kw) -> DataFrame:
    return rolling(df, entity, value, 0, time, rid, names, **kw)


def group_statistic(fit: DataFrame, apply: DataFrame, entity: str, value: str, how: str, name: str) -> DataFrame:
    """apply with the entity's statistic over the fit rows (null if it isn't there)."""
    stat = {"mean": F.avg(value), "std": F.stddev_samp(value), "max": F.max(value), "min": F.min(value), "count": F.count(F.lit(1)).cast("double")}[how]
    table = fit.groupBy(entity).agg(stat.alias("_value")).withColumnRenamed(entity, "_key")
    return apply.join(table, apply[entity].eqNullSafe(F.col("_key")), "left").withColumn(name, F.col("_value")).drop("_key", "_value")
