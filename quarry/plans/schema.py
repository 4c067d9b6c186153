"""Datasets as DataFrames: roles of columns, row ids, positions, validation, column profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "_rid"


@dataclass(frozen=True)
class DatasetSpec:
    """Which column is what. Names in drop and entity_cols are matched without regard to case."""

    label: str
    time_col: str | None = None
    entity_cols: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    rid: str = RID

    def dropped(self, column: str) -> bool:
        return column.lower() in {d.lower() for d in self.drop}


@dataclass(frozen=True)
class ColumnPlan:
    """The representation fixed on the learning part: categorical, numeric and binary columns, and those with a log form."""

    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    logged: tuple[str, ...] = ()
    stats: dict = field(default_factory=dict, compare=False)

    @property
    def base(self) -> list[str]:
        return [*self.numeric, *self.binary, *[f"{c}_log" for c in self.logged], *[f"{c}_code" for c in self.categorical]]


def is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def epoch_seconds(df: DataFrame, c: str) -> Column:
    """A time column as seconds since 1970 (double): timestamps with or without zone, dates, numbers, date strings."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        return F.col(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)") / 1e6
    if isinstance(kind, T.StringType):
        return F.unix_micros(F.try_to_timestamp(c)) / 1e6
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def finite(c: Column) -> Column:
    """The value as a double; null for NaN and infinities, so that null alone means missing."""
    d = c.try_cast("double")
    return F.when((F.abs(d) < F.lit(float("inf"))) & ~F.isnan(d), d)


def with_position(df: DataFrame, order: list[str], name: str = "_pos", parts: int | None = None, first_nulls: bool = True) -> DataFrame:
    """df with each row's 0-based place in the total order of ``order`` (ascending, nulls first).

    No single task sees all rows: rows fall into ranges of the first order column, each range is numbered by its own
    task, and the sizes of the ranges before are added. The bounds come from one aggregate, the sizes from
    another; both are as long as there are ranges. Rows that tie in the first column stay in one range.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lead = F.col(order[0])
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        kind = df.schema[order[0]].dataType
        if isinstance(kind, T.StringType):  # the first six bytes as a number: strings sort by their bytes
            key = F.conv(F.rpad(F.hex(F.substring(lead.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
        else:
            key = lead.cast("double") if isinstance(kind, T.NumericType | T.BooleanType) else epoch_seconds(df, order[0])
        bounds = df.select(key.cast("double").alias("k")).agg(F.percentile_approx("k", shares, 1000).alias("b")).first()[0] or []
        bounds = sorted({b for b in bounds if b is not None})
        bucket = F.lit(0)
        for b in bounds:
            bucket = bucket + F.coalesce((key.cast("double") > b).cast("int"), F.lit(0))
    else:
        bounds, bucket = [], F.lit(0)
    marked = df.withColumn("_range", bucket.cast("int"))
    sizes = {r["_range"]: r["n"] for r in marked.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()} if bounds else {}
    start, at = {}, 0
    for k in sorted(sizes):
        start[k] = at
        at += sizes[k]
    w = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    place = F.row_number().over(w).cast("long") - 1
    if start:
        offsets = F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(v).cast("long"))])
        place = place + offsets[F.col("_range")]
    return marked.withColumn(name, place).drop("_range")


def running_totals(df: DataFrame, order: str, sums: list[str], keys: list[str] | None = None, descending: bool = False, parts: int | None = None) -> DataFrame:
    """df (one row a key and value of the numeric column ``order``) with cum_<s>, the sum of s over the key's rows up to each in that
    order, and total_<s>. Ranges of the order, bounded by each key's approximate quantiles, are summed by tasks of their own; a
    table with one row a key and range carries what lies before.
    """
    keys = keys or []
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    bounds = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.percentile_approx(F.col(order).cast("double"), shares, 1000).alias("_bounds"))  # a row a key

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return left.join(right if keys else F.broadcast(right), on).drop(*[f"_k_{k}" for k in keys])

    value = F.col(order).cast("double")
    marked = met(df, bounds).withColumn("_range", F.aggregate("_bounds", F.lit(0), lambda a, b: a + (value > b).cast("int"))).drop("_bounds")
    sizes = marked.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    group = [F.col(k) for k in keys] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(F.desc("_range") if descending else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    carried = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *[F.sum(f"_{s}").over(every).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = marked.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = summed.join(F.broadcast(carried) if not keys else carried, on)  # without keys as many rows as ranges
    return joined.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_b_{s}") for s in sums}).drop("_range", "_r", *[f"_k_{k}" for k in keys], *[f"_b_{s}" for s in sums])


#: Values that one task may count at most, all of them different at worst.
MOST_VALUES = 4_000_000


def quantiles_by(rows: DataFrame, x: str, shares: Iterable[float], keys: list[str], accuracy: int | None = None, name: str = "edges", most_values: int = MOST_VALUES) -> DataFrame:
    """(keys..., name): an array of the quantiles of x by key, null left out; exact with linear interpolation, or from sketches of an
    accuracy as of percentile_approx. For few keys (columns, kinds of rows): a row a key goes to all tasks.

    Up to most_values values are counted by a task a key. Beyond that, sketches bound ranges of each key's values, whose sizes say in
    which ranges the wanted places lie; the values of those ranges alone are counted and summed, each range by a task of its own.
    """
    shares, present = list(shares), rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    if accuracy is not None:
        return present.groupBy(*keys).agg(F.percentile_approx("_x", shares, accuracy).alias(name))
    if rows.count() <= most_values:
        return present.groupBy(*keys).agg(F.percentile("_x", F.array(*[F.lit(s) for s in shares])).alias(name))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    ks = [f"_k{i}" for i in range(len(keys))]

    bounds = present.groupBy(*named).agg(F.percentile_approx("_x", [k / parts for k in range(1, parts)], 1000).alias("_bounds"))
    marked = present.join(F.broadcast(bounds), same).select(*keys, "_x", F.aggregate("_bounds", F.lit(0), lambda a, b: a + (F.col("_x") > b).cast("int")).alias("_range"))
    sizes = marked.groupBy(*named, F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_size"))
    key = Window.partitionBy(*ks)
    start = F.coalesce(F.sum("_size").over(key.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*ks, "_r", "_size", start.alias("_start"), F.sum("_size").over(key).alias("_total"))
    place = [F.lit(s) * (F.col("_total") - 1) for s in shares]
    asked = F.array(*[F.struct(F.lit(j).alias("j"), side(p).cast("long").alias("at"), (p - F.floor(p)).alias("part"), F.lit(up).alias("up")) for j, p in enumerate(place) for up, side in ((False, F.floor), (True, F.ceil))])
    inside = F.filter(asked, lambda a: (a["at"] >= F.col("_start")) & (a["at"] < F.col("_start") + F.col("_size")))
    wanted = sizes.select(*ks, "_r", "_start", inside.alias("_asked")).where(F.size("_asked") > 0)

    here = same & (F.col("_range") == F.col("_r"))
    counts = marked.join(F.broadcast(wanted), here).groupBy(*keys, "_range", "_start", "_asked", "_x").agg(F.count(F.lit(1)).alias("_n"))
    cum = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_x"))
    found = counts.withColumn("_cum", cum).select(*keys, "_x", F.explode(F.filter("_asked", lambda a: (a["at"] < F.col("_cum")) & (a["at"] >= F.col("_cum") - F.col("_n")))).alias("_a"))
    of = lambda up: F.max(F.when(F.col("_a.up") == up, F.col("_x")))
    edges = found.groupBy(*keys, "_a.j").agg(of(False).alias("low"), of(True).alias("high"), F.max("_a.part").alias("part"))
    edge = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", edge.alias("x")))).alias("_e")).select(*keys, F.transform("_e", lambda e: e["x"]).alias(name))


def row_count(df: DataFrame) -> int:
    return df.count()


def unpivot(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., column, x): numbers only; missing values are left out."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c)).alias("x")) for c in columns])
    return df.select(*keep, F.explode(each).alias("v")).select(*keep, "v.column", "v.x").where("x is not null")


def validate(df: DataFrame, spec: DatasetSpec, least_rows: int = 500, least_class: int = 25) -> DataFrame:
    """One row of findings in one pass: n_rows, n_positive, n_negative, bad_labels, null_times, valid."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("column names must be unique")
    missing = [c for c in [spec.label, *([spec.time_col] if spec.time_col else []), *spec.entity_cols] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    y = F.col(spec.label)
    nulls = F.count_if(F.col(spec.time_col).isNull()) if spec.time_col else F.lit(0).cast("long")
    found = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(y == 1).alias("n_positive"), F.count_if(y == 0).alias("n_negative"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_labels"), nulls.alias("null_times"),
    )
    fine = (F.col("n_rows") >= least_rows) & (F.col("n_positive") >= least_class) & (F.col("n_negative") >= least_class) & (F.col("bad_labels") == 0) & (F.col("null_times") == 0)
    return found.withColumn("valid", fine)


def require_valid(df: DataFrame, spec: DatasetSpec, **limits) -> DataFrame:
    found = validate(df, spec, **limits).first()
    if not found["valid"]:
        raise ValueError(f"dataset is not valid: {found.asDict()}")
    return df


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column: (column, n_missing, n_unique, minimum, median, maximum), all columns in one pass.

    Figures of text columns are null; NaN and infinities count as missing.
    """
    columns = columns or df.columns
    numbers = [c for c in columns if is_number(df, c)]
    aggs = []
    for i, c in enumerate(columns):
        v = finite(F.col(c)) if c in numbers else F.col(c)
        num = v if c in numbers else F.lit(None).cast("double")
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"), F.count_distinct(v).alias(f"u{i}"), F.min(num).alias(f"a{i}"), F.max(num).alias(f"b{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"), F.col(f"u{i}").alias("n_unique"), F.col(f"a{i}").alias("minimum"), F.col(f"b{i}").alias("maximum")) for i, c in enumerate(columns)])
    found = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    middle = quantiles_by(unpivot(df, numbers, []), "x", [0.5], ["column"]) if numbers else found.select("column", F.lit(None).cast("array<double>").alias("edges"))
    return found.join(F.broadcast(middle), "column", "left").select("column", "n_missing", "n_unique", "minimum", F.col("edges")[0].alias("median"), "maximum")  # a row a column


def sample_skewness(c: Column) -> Column:
    """Skewness adjusted for sample size; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def classify(df: DataFrame, spec: DatasetSpec, least: int = 10, most: int = 50_000, log_skew: float = 2.0) -> ColumnPlan:
    """Roles of the columns from one pass: at most two values - binary; numbers - numeric, and also categorical if integers
    with more than ``least`` and fewer than min(most, rows / 2) values; others categorical. Numeric columns that are
    never negative and skewed beyond log_skew get a log form."""
    columns = [c for c in df.columns if c not in (spec.label, spec.rid) and not spec.dropped(c) and c != spec.time_col]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = finite(F.col(c)) if is_number(df, c) else F.col(c)
        aggs.append(F.count_distinct(v).alias(f"u{i}"))
        if is_number(df, c):
            aggs += [F.min(v).alias(f"a{i}"), sample_skewness(v).alias(f"s{i}")]
    got = df.agg(*aggs).first()
    cat, num, bins, logs = [], [], [], []
    for i, c in enumerate(columns):
        unique, numeric = got[f"u{i}"], is_number(df, c)
        if isinstance(df.schema[c].dataType, T.BooleanType) or numeric and unique <= 2:
            bins.append(c)
        elif numeric:
            num.append(c)
            if isinstance(df.schema[c].dataType, T.IntegralType) and least < unique < min(most, got["n"] / 2):
                cat.append(c)
            if got[f"a{i}"] is not None and got[f"a{i}"] >= 0 and (got[f"s{i}"] or 0) > log_skew:
                logs.append(c)
        else:
            cat.append(c)
    return ColumnPlan(tuple(cat), tuple(num), tuple(bins), tuple(logs), got.asDict())


def detect_entities(df: DataFrame, columns: list[str], least: int = 20, most: int = 4) -> list[str]:
    """Columns of at least ``least`` and at most rows / 2 values, those of most values first, then by name."""
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)]).first()
    fit = [(-got[f"u{i}"], c) for i, c in enumerate(columns) if least <= got[f"u{i}"] <= got["n"] / 2]
    return [c for _, c in sorted(fit)[:most]]


def content_hash(df: DataFrame) -> str:
    """A fingerprint of the rows that doesn't depend on their order."""
    got = df.select(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{got['n']:x}-{got['s'] or 0:x}-{(got['x'] or 0) & (2**64 - 1):016x}"


def together(spark: SparkSession, calls: Iterable[Callable[[], object]], most: int = 4) -> list:
    """The results of calls that don't wait for each other, at most ``most`` at a time: many of their jobs are too small to fill all cores."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return sc.getCheckpointDir()


class Tables:
    """Frames written as Parquet in the checkpoint folder: as checkpoints they cut lineage and outlive executors, but a reader takes only the
    columns it needs and the rows aren't serialized objects. They stay until discard()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        import uuid

        path = f"{checkpoint_folder(self.spark)}/table-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        """Delete all, once nothing that is still to run reads them."""
        sc = self.spark.sparkContext
        while self.paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint: later plans start from its files, and a lost executor costs no more than reading them again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
