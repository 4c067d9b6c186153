"""Registered queries of the analytics operators, each with the SQL that another engine runs to check it.

A query names its columns with kinds: i whole number, f number (rounded to 6 places), g large number (to 4), s text, b
boolean. Both sides are brought to these kinds; a small shift before rounding keeps decimal ties from falling to either side. SQL is written from an operator's meaning, not from its plan: histories are self-joins there,
folds are correlated sums, ranks are comparisons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.expr import STRICT, WIDE, ExpressionError, compile_expression, with_expressions
from quarry.operators import admit, drift, encode, experts, formula, gate, history, metrics, score, split
from quarry.operators.history import HistorySpec
from quarry.plans import schema
from quarry.plans.schema import DatasetSpec, epoch_seconds, with_position
from quarry.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ tables


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """rid, t, user_id, event_type, value, y; p and q stand for two models' scores."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("rid"), epoch_seconds(e, "ts").alias("t"), "user_id", "event_type", "value", (F.col("event_type") == "error").cast("int").alias("y"),
        (1 / (1 + F.abs(F.col("value")) / 10)).alias("p"), (1 / (1 + F.abs(F.col("value") - 20) / 10)).alias("q"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    """rid, t (with ties), cust, prio, price, y."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("rid"), epoch_seconds(o, "o_orderdate").alias("t"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def placed(df: DataFrame) -> DataFrame:
    return with_position(df, ["t", "rid"])


def parted(df: DataFrame) -> DataFrame:
    """events with _pos and part: I the first 64 %, V the next 16, T the rest by time."""
    return split.chronological(df, "t", "rid")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


EV = "ev AS (SELECT event_id AS rid, epoch_us(ts) / 1e6 AS t, user_id, event_type, value, CAST(event_type = 'error' AS INTEGER) AS y, 1 / (1 + abs(value) / 10) AS p, 1 / (1 + abs(value - 20) / 10) AS q FROM events)"
EP = EV + ", ep AS (SELECT *, row_number() OVER (ORDER BY t, rid) - 1 AS pos, count(*) OVER () AS n FROM ev), pt AS (SELECT *, CASE WHEN pos < CAST(floor(0.8 * floor(0.8 * n)) AS BIGINT) THEN 'I' WHEN pos < CAST(floor(0.8 * n) AS BIGINT) THEN 'V' ELSE 'T' END AS part FROM ep)"
OD = "od AS (SELECT o_orderkey AS rid, epoch_us(o_orderdate) / 1e6 AS t, o_custkey AS cust, o_orderpriority AS prio, o_totalprice AS price, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"
OP = OD + ", op AS (SELECT *, row_number() OVER (ORDER BY t, rid) - 1 AS pos, count(*) OVER () AS n FROM od)"


def register(name: str, columns: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """columns: "name:kind ..."; build may give more columns, which are left out."""
    kinds = [c.split(":") for c in columns.split()]

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = build(spark, d)
        shapes = {"f": lambda c: F.round(F.when(~F.isnan(c.cast("double")), c.cast("double")) + F.lit(3.7e-8), 6) + F.lit(0.0), "g": lambda c: F.round(c.cast("double") + F.lit(3.7e-6), 4) + F.lit(0.0), "i": lambda c: c.cast("long"), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
        return df.select(*[shapes[k](F.col(f"`{c}`")).alias(c) for c, k in kinds])

    QUERIES[name] = query
    if sql is not None:
        shapes = {"f": "round(CAST({0} AS DOUBLE) + 3.7e-8, 6) + CAST(0 AS DOUBLE)", "g": "round(CAST({0} AS DOUBLE) + 3.7e-6, 4) + CAST(0 AS DOUBLE)", "i": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
        ORACLE[name] = "SELECT " + ", ".join(f'{shapes[k].format(chr(34) + c + chr(34))} AS "{c}"' for c, k in kinds) + f" FROM ({sql}) AS _q"


# ------------------------------------------------------------------ sources, selection, splits

register("src_normalize_names", "p_partkey:i retail_price_usd:f", lambda s, d: io.normalise_names(table(s, d, "part").select(F.col("p_partkey").alias(" P-PartKey "), F.col("p_retailprice").alias("Retail Price (USD)"))), "SELECT p_partkey, p_retailprice AS retail_price_usd FROM part")
register("scan_count", "n:i", lambda s, d: io.count_rows(lines(s, d)), "SELECT count(*) AS n FROM lineitem")
register("scan_time_range", "rid:i t:f", lambda s, d: io.time_range(orders(s, d), "t", "rid", 100, 50), f"WITH {OP} SELECT rid, t FROM op WHERE pos >= 100 AND pos < 150")
register("prep_epoch", "event_id:i sec:i", lambda s, d: table(s, d, "events").select("event_id", F.floor(epoch_seconds(table(s, d, "events"), "ts")).alias("sec")), "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM events")
register("prep_strip", "n_nationkey:i n_name:s", lambda s, d: io.strip_quotes(table(s, d, "nation").withColumn("n_name", F.concat(F.lit("'"), "n_name", F.lit("'")))), "SELECT n_nationkey, trim('''' || n_name || '''', '''') AS n_name FROM nation")
register("prep_label", "event_id:i y:i", lambda s, d: table(s, d, "events").select("event_id", io.label_of("event_type", "error").alias("y")), "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events")
register("prep_dates", "o_orderkey:i y:i day:s", lambda s, d: table(s, d, "orders").withColumn("dmy", F.date_format("o_orderdate", "dd-MM-yyyy")).select("o_orderkey", io.year_of("o_orderdate").alias("y"), F.date_format(io.day_first_date("dmy"), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
register("val_schema", "n_rows:i n_positive:i n_negative:i bad_labels:i null_times:i valid:b", lambda s, d: schema.validate(events(s, d), DatasetSpec("y", "t")), f"WITH {EV} SELECT count(*) AS n_rows, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative, count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS bad_labels, count(*) FILTER (t IS NULL) AS null_times, count(*) >= 500 AND count(*) FILTER (y = 1) >= 25 AND count(*) FILTER (y = 0) >= 25 AS valid FROM ev")
register("split_chrono", "rid:i part:s", lambda s, d: parted(events(s, d)).withColumnRenamed("_part", "part"), f"WITH {EP} SELECT rid, part FROM pt")
_STRAT = "tk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || rid), rid) AS k, count(*) OVER (PARTITION BY y) AS m FROM ev), st AS (SELECT *, round(m * 0.2::DOUBLE) AS nt, round((m - round(m * 0.2::DOUBLE)) * 0.2::DOUBLE) AS nv FROM tk)"
register("split_strat", "rid:i part:s", lambda s, d: split.stratified(events(s, d), "y", "rid", name="part"), f"WITH {EV}, {_STRAT} SELECT rid, CASE WHEN k <= nt THEN 'T' WHEN k <= nt + nv THEN 'V' ELSE 'I' END AS part FROM st")


def _blocks(s, d):
    v = with_position(parted(events(s, d)).where("_part = 'V'").drop("_pos"), ["t", "rid"])
    n = v.count()
    return v.withColumn("block", split.weighted_blocks(F.col("_pos"), n)).withColumn("half", split.block_of(F.col("_pos"), n, 2) + 1)


register("val_blocks", "rid:i block:i half:i", _blocks, f"WITH {EP}, v AS (SELECT rid, row_number() OVER (ORDER BY t, rid) - 1 AS k, count(*) OVER () AS m FROM pt WHERE part = 'V') SELECT rid, 1 + CAST(k >= round_even(m * 3 / 5.0, 0) AS INT) + CAST(k >= round_even(m * 4 / 5.0, 0) AS INT) AS block, CASE WHEN k < (m + 1) // 2 THEN 1 ELSE 2 END AS half FROM v")
register("class_balance", "part:s n:i positives:i rate:f", lambda s, d: parted(events(s, d)).groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg("y").alias("rate")), f"WITH {EP} SELECT part, count(*) AS n, sum(y) AS positives, avg(y) AS rate FROM pt GROUP BY part")
register("slice_mask", "rid:i inside:b is_view:b", lambda s, d: events(s, d).select("rid", experts.SliceRule("value", 10.0, 50.0).mask().alias("inside"), experts.SliceRule("event_type", value="view").mask().alias("is_view")), f"WITH {EV} SELECT rid, coalesce(value > 10 AND value <= 50, FALSE) AS inside, coalesce(event_type = 'view', FALSE) AS is_view FROM ev")
register("neg_subsample", "rid:i y:i", lambda s, d: split.keep_positives(events(s, d), "y", "rid", 1.5, 3), f"WITH {EV}, tk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('3|' || rid), rid) AS k FROM ev) SELECT rid, y FROM tk WHERE y = 1 OR k <= floor(1.5 * (SELECT count(*) FROM ev WHERE y = 1))")
register("discovery_rows", "rid:i", lambda s, d: split.sample_rows(events(s, d), "rid", 500, 1), f"WITH {EV} SELECT rid FROM ev ORDER BY md5('1|' || rid), rid LIMIT 500")
register("audit_rows", "rid:i y:i", lambda s, d: split.audit_sample(events(s, d), "y", "rid", 1000, 2), f"WITH {EV}, tk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('2|' || rid), rid) AS k, count(*) OVER (PARTITION BY y) AS m, count(*) OVER () AS n FROM ev) SELECT rid, y FROM tk WHERE k <= round(m * (least(1000, n) / n::DOUBLE))")
register("few_shot", "rid:i y:i", lambda s, d: split.few_shot(events(s, d), "y", "rid", 8, 4), f"WITH {EV} SELECT rid, y FROM ev QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('4|' || rid), rid) <= 8")


def _linspace(s, d):
    df = placed(events(s, d))
    return df.where(F.col("_pos").isin(split.even_places(df.count(), 25)))


register("linspace_rows", "rid:i", _linspace, f"WITH {EP} SELECT rid FROM ep WHERE pos IN (SELECT (i * (n - 1)) // 24 FROM range(25) AS r(i), (SELECT max(n) AS n FROM ep))")
register("tail_holdout", "rid:i holdout:b", lambda s, d: split.tail_holdout(orders(s, d), "t", "rid", name="holdout"), f"WITH {OP} SELECT rid, pos >= n - CAST(floor(n * (1 / 9.0::DOUBLE)) AS BIGINT) AS holdout FROM op")
register("folds", "rid:i fold:i", lambda s, d: split.stratified_folds(events(s, d), "y", "rid", 4, 11, "fold"), f"WITH {EV} SELECT rid, (row_number() OVER (PARTITION BY y ORDER BY md5('11|' || rid), rid) - 1) % 4 AS fold FROM ev")
register("ntile_blocks", "rid:i block:i", lambda s, d: (lambda df: df.withColumn("block", split.block_of(F.col("_pos"), df.count(), 7) + 1))(placed(events(s, d))), f"WITH {EV} SELECT rid, ntile(7) OVER (ORDER BY t, rid) AS block FROM ev")
register("recency_windows", "level:i n:i first_rid:i", lambda s, d: (lambda df, n: df.select("rid", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), split.recent(F.col("_pos"), n, k).alias("on")) for k in range(4)])).alias("m")).where("m.on").groupBy("m.level").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid")))((df := placed(events(s, d))), df.count()), f"WITH {EP} SELECT k AS level, count(*) AS n, min(rid) AS first_rid FROM ep, range(4) AS r(k) WHERE pos >= n - n // CAST(power(2, k) AS BIGINT) GROUP BY k")
register("split_disjoint", "n_common:i n_all:i", lambda s, d: (lambda df: df.where("_part = 'I'").select("rid").intersect(df.where("_part <> 'I'").select("rid")).agg(F.count(F.lit(1)).alias("n_common")).crossJoin(F.broadcast(df.agg(F.count_distinct("rid").alias("n_all")))))(parted(events(s, d))), f"WITH {EP} SELECT (SELECT count(*) FROM (SELECT rid FROM pt WHERE part = 'I' INTERSECT SELECT rid FROM pt WHERE part <> 'I')) AS n_common, (SELECT count(DISTINCT rid) FROM pt) AS n_all")

# ------------------------------------------------------------------ expressions

_COLUMNS = ["value", "user_id", "rid", "t"]
_EXPRESSIONS = {
    "add": "df['value'] + df['user_id'] - 3", "neg": "-df['value'] * +2", "div": "df['value'] / ((df['user_id'] - 5) * 7.3)", "pow": "(df['value'] / 100) ** 3", "np_power": "np.power(df['value'], 2)",
    "mod": "(df['value'] - 50) % 7", "compare": "(df['value'] > 10) & (df['value'] <= 100)", "logic": "~(df['value'] >= 50) | (df['user_id'] == 3)", "not_equal": "df['user_id'] != 7",
    "abs": "np.abs(df['value'] - 50) + (df['value'] - 20).abs()", "log": "np.log(df['value'])", "log1p": "np.log1p(df['value'])", "exp": "np.exp(df['value'] / -100)", "expm1": "np.expm1(df['value'] / 1000)",
    "sqrt": "np.sqrt(df['value'])", "maximum": "np.maximum(df['value'], df['user_id'])", "minimum": "np.minimum(df['value'], df['value'] / ((df['user_id'] - 5) * 7.3))", "where": "np.where(df['value'] > 50, df['value'], -1)",
    "square": "np.square(df['value'])", "sign": "np.sign(df['value'] - 50)", "to_numeric": "pd.to_numeric(df['value'], errors='coerce')", "fillna": "(df['value'] / ((df['user_id'] - 5) * 7.3)).fillna(-1)",
    "clip": "df['value'].clip(5, 60) + np.clip(df['user_id'], 1, 100)", "astype": "df['value'].astype('int') * 2", "replace": "df['user_id'].replace({3: 30, 5: 50})", "to_numpy": "df['value'].to_numpy()",
}
_WIDE = {
    "isna": "(df['value'] / (df['user_id'] - 5)).isna()", "isfinite": "np.isfinite(df['value']) & ~np.isnan(df['value'])", "method_pow": "df['value'].pow(2)", "between": "df['value'].between(10, 40)",
    "isin": "df['user_id'].isin([1, 2, 3])", "round": "(df['value'] * 4).round(0)",
}


#: What each expression means, written for SQL by hand; Q has no value where user_id is 5.
_Q = "(value / nullif((user_id - 5) * 7.3::DOUBLE, 0))"
_MEANING = {
    "add": "value + user_id - 3", "neg": "-2 * value", "div": _Q, "pow": "(value / 100) * (value / 100) * (value / 100)", "np_power": "value * value",
    "mod": "(value - 50) - 7 * floor((value - 50) / 7)", "compare": "CASE WHEN value > 10 AND value <= 100 THEN 1 ELSE 0 END", "logic": "CASE WHEN value < 50 OR user_id = 3 THEN 1 ELSE 0 END",
    "not_equal": "CASE WHEN user_id = 7 THEN 0 ELSE 1 END", "abs": "greatest(value - 50, 50 - value) + greatest(value - 20, 20 - value)", "log": "CASE WHEN value > 0 THEN ln(value) END", "log1p": "ln(1 + value)",
    "exp": "power(2.718281828459045::DOUBLE, -value / 100)", "expm1": "power(2.718281828459045::DOUBLE, value / 1000) - 1", "sqrt": "power(value, 0.5::DOUBLE)",
    "maximum": "CASE WHEN value >= user_id THEN value ELSE user_id END", "minimum": f"CASE WHEN {_Q} IS NULL THEN NULL WHEN value <= {_Q} THEN value ELSE {_Q} END", "where": "CASE WHEN value > 50 THEN value ELSE -1 END",
    "square": "power(value, 2)", "sign": "CASE WHEN value > 50 THEN 1 WHEN value < 50 THEN -1 ELSE 0 END", "to_numeric": "value", "fillna": f"coalesce({_Q}, -1)",
    "clip": "CASE WHEN value < 5 THEN 5 WHEN value > 60 THEN 60 ELSE value END + CASE WHEN user_id < 1 THEN 1 WHEN user_id > 100 THEN 100 ELSE user_id END", "astype": "2 * floor(value)",
    "replace": "CASE user_id WHEN 3 THEN 30 WHEN 5 THEN 50 ELSE user_id END", "to_numpy": "value", "isna": "CASE WHEN user_id = 5 OR value IS NULL THEN 1 ELSE 0 END", "isfinite": "CASE WHEN value IS NULL THEN 0 ELSE 1 END",
    "method_pow": "value * value", "between": "CASE WHEN value >= 10 AND value <= 40 THEN 1 ELSE 0 END", "isin": "CASE WHEN user_id = 1 OR user_id = 2 OR user_id = 3 THEN 1 ELSE 0 END",
    "round": "CASE WHEN 4 * value - floor(4 * value) = 0.5 THEN 2 * round(2 * value) ELSE floor(4 * value + 0.5) END",
}


def _register_expressions() -> None:
    for dialect, pool in ((STRICT, _EXPRESSIONS), (WIDE, _WIDE)):
        for name, text in pool.items():
            e = compile_expression(text, _COLUMNS, None, dialect)
            register(f"fn_{name}", "rid:i x:f", lambda s, d, e=e: events(s, d).select("rid", e.column().alias("x")), f"WITH {EV} SELECT rid, {_MEANING[name]} AS x FROM ev")


_register_expressions()
_REJECTED = [
    "df['value'] + df['absent']", "__import__('os').getcwd()", "df['value'].apply(len)", "df.groupby('user_id')", "lambda x: x", "[x for x in df]", "df['value'].__class__", "open('x')", "np.load('x')", "df['value'] if True else 1",
    "df['value'].rolling(3).mean()", "1 + " * 9000 + "1", "df['value'] + 1",
]


def _rejections(s, d):
    """Which texts the validator turns away; the last is fine."""
    from quarry.functions.expr import ExpressionError

    def fine(text: str) -> bool:
        try:
            compile_expression(text, _COLUMNS)
            return True
        except ExpressionError:
            return False

    return s.createDataFrame([(k, not fine(t)) for k, t in enumerate(_REJECTED)], "place int, rejected boolean")


register("expr_reject", "place:i rejected:b", _rejections, f"SELECT i AS place, i < {len(_REJECTED) - 1} AS rejected FROM range({len(_REJECTED)}) AS r(i)")
_RATIO = "np.where(df['value'] > 20, np.log1p(df['value']) / (np.abs(df['user_id'] - 40) + 1.0), np.sqrt(df['value']) * 0.5)"
register("expr_eval", "rid:i x:f", lambda s, d: events(s, d).select("rid", compile_expression(_RATIO, _COLUMNS).column().alias("x")), f"WITH {EV} SELECT rid, CASE WHEN value > 20 THEN ln(1 + value) / (abs(user_id - 40) + 1.0) ELSE sqrt(value) * 0.5 END AS x FROM ev")
_POOL = {"a": "df['value'] / (df['user_id'] - 5)", "b": "df['value'] * 0 + 1", "c": "np.log1p(df['value'])", "d": "df['c'] * 2 - df['user_id']"}


def _validity(s, d):
    df = with_expressions(events(s, d), _POOL)
    got = df.agg(*[x for n in _POOL for x in (F.count_if(F.col(n).isNull()).alias(f"z_{n}"), (F.min(n) == F.max(n)).alias(f"k_{n}"))])
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"z_{n}").alias("n_bad"), F.col(f"k_{n}").alias("constant")) for n in _POOL])).alias("r")).select("r.*")


register("expr_validity", "name:s n_bad:i constant:b", _validity, f"WITH {EV}, x AS (SELECT unnest(['a', 'b', 'c', 'd']) AS name, unnest([value / nullif(user_id - 5, 0), value * 0 + 1, ln(1 + value), ln(1 + value) * 2 - user_id]) AS x FROM ev) SELECT name, count(*) FILTER (x IS NULL) AS n_bad, min(x) = max(x) AS constant FROM x GROUP BY name")

# ------------------------------------------------------------------ lookups and encodings

_IV = "i AS (SELECT * FROM pt WHERE part = 'I'), v AS (SELECT * FROM pt WHERE part = 'V')"


def iv(s, d):
    df = parted(events(s, d))
    return df.where("_part = 'I'"), df.where("_part = 'V'")


register("lookup_left", "rid:i seen:i", lambda s, d: (lambda i, v: encode.lookup(v, i.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "n", 0, "seen"))(*iv(s, d)), f"WITH {EP}, {_IV} SELECT rid, (SELECT count(*) FROM i WHERE i.user_id = v.user_id) AS seen FROM v")
register("unseen_rate", "column:s unseen_rate:f", lambda s, d: (lambda i, v: encode.unseen_rate(i.where("user_id % 10 < 7"), v, ["user_id", "event_type"]))(*iv(s, d)), f"WITH {EP}, {_IV}, j AS (SELECT * FROM i WHERE user_id % 10 < 7) SELECT 'user_id' AS \"column\", avg(CAST(user_id NOT IN (SELECT user_id FROM j) AS INT)) AS unseen_rate FROM v UNION ALL SELECT 'event_type', avg(CAST(event_type NOT IN (SELECT event_type FROM j) AS INT)) FROM v")
register("oof_realign", "rid:i y:i p:f", lambda s, d: (lambda df: df.select("rid", "y").join(df.where("_part <> 'T'").select("rid", "p"), "rid"))(parted(events(s, d))), f"WITH {EP} SELECT rid, y, p FROM pt WHERE part <> 'T'")
register("grp_mean", "rid:i m:f", lambda s, d: (lambda i, v: formula.grouped(i, v, "GroupByThenMean", "value", "event_type", "m"))(*iv(s, d)), f"WITH {EP}, {_IV} SELECT rid, (SELECT avg(value) FROM i WHERE i.event_type = v.event_type) AS m FROM v")
register("union_hist", "rid:i n:f", lambda s, d: (lambda i, v: history.query_history(i.drop("_part", "_pos"), v.drop("_part", "_pos"), [HistorySpec(("user_id",), "count")], "t", "rid", names={HistorySpec(("user_id",), "count"): "n"}))(*iv(s, d)), f"WITH {EP}, {_IV}, u AS (SELECT * FROM i UNION ALL SELECT * FROM v) SELECT rid, (SELECT count(*) FROM u WHERE u.user_id = v.user_id AND u.t < v.t) AS n FROM v")
register("te_map", "user_id:i n:i te:f", lambda s, d: encode.target_map(events(s, d), "user_id", "y"), f"WITH {EV} SELECT user_id, count(*) AS n, (sum(y) + 20 * (SELECT avg(y) FROM ev)) / (count(*) + 20) AS te FROM ev GROUP BY user_id")


def _folded(s, d):
    """A fifth of the users stand for null, to keep null a category."""
    df = split.stratified_folds(events(s, d), "y", "rid", 5, 7, "fold")
    return df.withColumn("k", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))


_FOLDED = EV + ", f AS (SELECT rid, y, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k, (row_number() OVER (PARTITION BY y ORDER BY md5('7|' || rid), rid) - 1) % 5 AS fold FROM ev)"
_OTHER = ", o AS (SELECT g.fold, h.k, count(*) AS n, sum(h.y) AS s FROM (SELECT DISTINCT fold FROM f) g JOIN f h ON h.fold <> g.fold GROUP BY ALL), tot AS (SELECT g.fold, count(*) AS n, avg(h.y) AS m FROM (SELECT DISTINCT fold FROM f) g JOIN f h ON h.fold <> g.fold GROUP BY ALL)"
register("oof_te", "rid:i te:f", lambda s, d: encode.out_of_fold(_folded(s, d), "k", "y", "fold").withColumnRenamed("te_oof", "te"), f"WITH {_FOLDED}{_OTHER} SELECT f.rid, CASE WHEN o.n IS NULL THEN tot.m ELSE (o.s + 20 * tot.m) / (o.n + 20) END AS te FROM f JOIN tot USING (fold) LEFT JOIN o ON o.fold = f.fold AND o.k IS NOT DISTINCT FROM f.k")
register("oof_freq", "rid:i freq:f", lambda s, d: encode.out_of_fold(_folded(s, d), "k", "y", "fold").withColumnRenamed("freq_oof", "freq"), f"WITH {_FOLDED}{_OTHER} SELECT f.rid, coalesce(o.n, 0) / tot.n::DOUBLE AS freq FROM f JOIN tot USING (fold) LEFT JOIN o ON o.fold = f.fold AND o.k IS NOT DISTINCT FROM f.k")
register("apply_te", "rid:i te:f", lambda s, d: (lambda i, v: encode.lookup(v, encode.target_map(i, "user_id", "y"), "user_id", "te", i.agg(F.avg("y")).first()[0], "te"))(*iv(s, d)), f"WITH {EP}, {_IV}, m AS (SELECT user_id, count(*) AS n, sum(y) AS s FROM i GROUP BY 1) SELECT v.rid, CASE WHEN m.n IS NULL THEN g.m ELSE (m.s + 20 * g.m) / (m.n + 20) END AS te FROM v LEFT JOIN m USING (user_id), (SELECT avg(y) AS m FROM i) g")
register("apply_freq", "rid:i freq:f", lambda s, d: (lambda i, v: encode.lookup(v, encode.frequency_map(i, "user_id"), "user_id", "freq", 0.0, "freq"))(*iv(s, d)), f"WITH {EP}, {_IV} SELECT rid, (SELECT count(*) FROM i WHERE i.user_id = v.user_id) / (SELECT count(*)::DOUBLE FROM i) AS freq FROM v")


def _expanding(s, d):
    df = placed(events(s, d))
    return encode.expanding_blocks(df.withColumn("block", split.block_of(F.col("_pos"), df.count(), 5)), "user_id", "y", "block")


register("expanding_te", "rid:i te_exp:f", _expanding, f"WITH {EV}, b AS (SELECT *, ntile(5) OVER (ORDER BY t, rid) AS k FROM ev), g AS (SELECT a.k, avg(c.y) AS m FROM (SELECT DISTINCT k FROM b) a JOIN b c ON c.k < a.k GROUP BY 1), h AS (SELECT a.k, c.user_id, count(*) AS n, sum(c.y) AS s FROM (SELECT DISTINCT k FROM b) a JOIN b c ON c.k < a.k GROUP BY 1, 2) SELECT b.rid, CASE WHEN g.m IS NULL THEN 0.5 ELSE (coalesce(h.s, 0) + 20 * g.m) / (coalesce(h.n, 0) + 20) END AS te_exp FROM b LEFT JOIN g USING (k) LEFT JOIN h ON h.k = b.k AND h.user_id = b.user_id")
_FWD = "w AS (SELECT *, coalesce(sum(y) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sp, coalesce(sum(y) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS us, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS un FROM ep)"
register("forward_te", "rid:i te_fwd:f", lambda s, d: encode.forward(placed(events(s, d)), "user_id", "y", "_pos"), f"WITH {EP}, {_FWD} SELECT rid, (us + 20 * ((sp + 1) / (pos + 2)::DOUBLE)) / (un + 20) AS te_fwd FROM w")
register("forward_freq", "rid:i freq_fwd:f", lambda s, d: encode.forward(placed(events(s, d)), "user_id", "y", "_pos"), f"WITH {EP}, {_FWD} SELECT rid, un / greatest(pos, 1)::DOUBLE AS freq_fwd FROM w")
register("freq_insample", "rid:i freq:f", lambda s, d: (lambda df: encode.lookup(df, encode.frequency_map(df.where("k is not null"), "k"), "k", "freq", 0.0, "freq"))(_folded(s, d)), f"WITH {_FOLDED} SELECT rid, coalesce((SELECT count(*) FROM f g WHERE g.k = f.k) / (SELECT count(k)::DOUBLE FROM f), 0) AS freq FROM f")
register("ordinal_code", "rid:i code:i", lambda s, d: encode.apply_codes(_folded(s, d), encode.sorted_codes(_folded(s, d).where("coalesce(k, 0) % 3 <> 1"), "k"), "k", "code"), f"WITH {_FOLDED}, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(CAST(k AS VARCHAR), '__missing__') AS v FROM f WHERE coalesce(k, 0) % 3 <> 1)) SELECT rid, coalesce(code, -1) AS code FROM f LEFT JOIN c ON c.v = coalesce(CAST(k AS VARCHAR), '__missing__')")
register("appearance_code", "rid:i code:i", lambda s, d: (lambda df: encode.apply_codes(df, encode.appearance_codes(df.where("_pos >= 100"), "event_type", "_pos"), "event_type", "code"))(placed(events(s, d))), f"WITH {EP}, c AS (SELECT event_type, row_number() OVER (ORDER BY min(pos)) - 1 AS code FROM ep WHERE pos >= 100 GROUP BY 1) SELECT rid, coalesce(code, -1) AS code FROM ep LEFT JOIN c USING (event_type)")
register("cat_code", "rid:i code:i", lambda s, d: (lambda i, v: encode.apply_codes(v, encode.sorted_codes(i.where("event_type <> 'click'"), "event_type"), "event_type", "code"))(*iv(s, d)), f"WITH {EP}, {_IV}, c AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM i WHERE event_type <> 'click')) SELECT rid, coalesce(code, -1) AS code FROM v LEFT JOIN c USING (event_type)")
register("log_columns", "l_orderkey:i a:f b:f", lambda s, d: lines(s, d).select("l_orderkey", encode.log_form(F.col("l_extendedprice")).alias("a"), encode.log_form(F.col("l_quantity") - 10).alias("b")), "SELECT l_orderkey, ln(1 + greatest(l_extendedprice, 0)) AS a, ln(1 + greatest(l_quantity - 10, 0)) AS b FROM lineitem")
_PROFILED = ["l_quantity", "l_discount", "l_returnflag", "l_linenumber"]
_PROFILE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, count(DISTINCT {c}) AS n_unique, " + (f"min({c})::DOUBLE AS minimum, median({c})::DOUBLE AS median, max({c})::DOUBLE AS maximum" if c != "l_returnflag" else "CAST(NULL AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS maximum") + " FROM lineitem" for c in _PROFILED)
register("col_summary", "column:s n_missing:i n_unique:i minimum:f median:f maximum:f", lambda s, d: schema.profile(lines(s, d), _PROFILED), _PROFILE_SQL)


def _roles(s, d):
    plan = schema.classify(lines(s, d).drop("l_shipdate"), DatasetSpec("l_linestatus", drop=("L_COMMENT",)))
    return s.createDataFrame([(c, c in plan.categorical, c in plan.numeric, c in plan.binary, c in plan.logged) for c in sorted({*plan.categorical, *plan.numeric, *plan.binary})], "column string, cat boolean, num boolean, bin boolean, logged boolean")


_ROLE_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, min({c})::DOUBLE AS lo, skewness({c}) AS sk, {int(k == 'i')} AS whole, count(*) AS n FROM lineitem" for c, k in (("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"), ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f")))
register("col_profile", "column:s cat:b num:b bin:b logged:b", _roles, f"SELECT \"column\", u > 2 AND whole = 1 AND u > 10 AND u < least(50000, n / 2) AS cat, u > 2 AS num, u <= 2 AS bin, u > 2 AND lo >= 0 AND coalesce(sk, 0) > 2 AS logged FROM ({_ROLE_SQL}) UNION ALL SELECT 'l_returnflag', TRUE, FALSE, FALSE, FALSE")
_KEYS = ["c_name", "c_mktsegment", "c_nationkey", "c_custkey"]
register("entity_detect", "place:i column:s", lambda s, d: s.createDataFrame(list(enumerate(schema.detect_entities(table(s, d, "customer"), _KEYS))), "place int, column string"), "WITH u AS (SELECT unnest(['c_name', 'c_mktsegment', 'c_nationkey', 'c_custkey']) AS \"column\", unnest([count(DISTINCT c_name), count(DISTINCT c_mktsegment), count(DISTINCT c_nationkey), count(DISTINCT c_custkey)]) AS k, unnest([count(*), count(*), count(*), count(*)]) AS n FROM customer) SELECT row_number() OVER (ORDER BY k DESC, \"column\") - 1 AS place, \"column\" FROM u WHERE k >= 20 AND k <= n / 2 ORDER BY k DESC, \"column\" LIMIT 4")
register("persistence", "share:f", lambda s, d: (lambda df, n: df.where(F.col("_pos") >= int(0.8 * n)).join(df.where(F.col("_pos") < int(0.8 * n)).select(F.col("cust").alias("_k")).distinct().withColumn("_m", F.lit(1)), F.col("cust") == F.col("_k"), "left").agg(F.avg(F.coalesce("_m", F.lit(0))).alias("share")))((df := placed(orders(s, d))), df.count()), f"WITH {OP} SELECT avg(CAST(cust IN (SELECT cust FROM op WHERE pos < floor(0.8 * n)) AS INT)) AS share FROM op WHERE pos >= floor(0.8 * n)")
_THREE = lambda s, d: encode.spread(lines(s, d).select("l_orderkey", "l_discount", "l_tax", (F.col("l_quantity") / 50).alias("qty")), ["l_discount", "l_tax", "qty"])
_THREE_SQL = "t3 AS (SELECT l_orderkey, l_discount AS a, l_tax AS b, l_quantity / 50 AS c, (l_discount + l_tax + l_quantity / 50) / 3 AS m FROM lineitem)"
register("te_cross_std", "l_orderkey:i te_std:f", _THREE, f"WITH {_THREE_SQL} SELECT l_orderkey, sqrt(((a - m)^2 + (b - m)^2 + (c - m)^2) / 3) AS te_std FROM t3")
register("te_cross_range", "l_orderkey:i te_range:f", _THREE, f"WITH {_THREE_SQL} SELECT l_orderkey, greatest(a, b, c) - least(a, b, c) AS te_range FROM t3")
register("te_ctx_delta", "l_orderkey:i l_discount_delta:f l_tax_delta:f qty_delta:f", _THREE, f"WITH {_THREE_SQL} SELECT l_orderkey, a - (b + c) / 2 AS l_discount_delta, b - (a + c) / 2 AS l_tax_delta, c - (a + b) / 2 AS qty_delta FROM t3")
register("calendar", "rid:i tod:f tod_sin:f tod_cos:f dow:i", lambda s, d: events(s, d).withColumns(encode.calendar(F.col("t"))), f"WITH {EV} SELECT rid, (t - floor(t / 86400) * 86400) / 86400 AS tod, sin((t - floor(t / 86400) * 86400) / 86400 * 2 * pi()) AS tod_sin, cos((t - floor(t / 86400) * 86400) / 86400 * 2 * pi()) AS tod_cos, isodow(to_timestamp(t) AT TIME ZONE 'UTC') - 1 AS dow FROM ev")

# ------------------------------------------------------------------ formula operators: fitted on I, applied to V

for _name, _op, _sql in (
    ("abs", "abs", "abs(x)"), ("log", "log", "ln(abs(nullif(x, 0)))"), ("sqrt", "sqrt", "sqrt(abs(x))"), ("square", "square", "x * x"),
    ("sigmoid", "sigmoid", "1 / (1 + exp(-x))"), ("round", "round", "floor(x)"), ("residual", "residual", "x - floor(x)"),
):
    register(f"of_{_name}", "rid:i z:f", lambda s, d, op=_op: events(s, d).select("rid", formula.UNARY[op](F.col("value") / 7.3 - 5).alias("z")), f"WITH {EV}, x AS (SELECT rid, value / 7.3 - 5 AS x FROM ev) SELECT rid, {_sql} AS z FROM x")
register("of_arith", "rid:i a:f b:f c:f", lambda s, d: events(s, d).select("rid", *[formula.BINARY[o](F.col("value"), F.col("user_id") * 0.37).alias(n) for n, o in zip("abc", "+-*", strict=True)]), f"WITH {EV} SELECT rid, value + user_id * 0.37::DOUBLE AS a, value - user_id * 0.37::DOUBLE AS b, value * (user_id * 0.37::DOUBLE) AS c FROM ev")
register("of_div", "rid:i z:f", lambda s, d: events(s, d).select("rid", formula.BINARY["/"](F.col("value"), (F.col("user_id") - 5) * 7.3).alias("z")), f"WITH {EV} SELECT rid, value / nullif((user_id - 5) * 7.3::DOUBLE, 0) AS z FROM ev")
register("of_minmax", "rid:i a:f b:f", lambda s, d: events(s, d).withColumn("k", F.when(F.col("user_id") > 5, F.col("user_id").cast("double"))).select("rid", formula.BINARY["min"](F.col("value"), F.col("k")).alias("a"), formula.BINARY["max"](F.col("value"), F.col("k")).alias("b")), f"WITH {EV} SELECT rid, CASE WHEN user_id > 5 THEN least(value, user_id) END AS a, CASE WHEN user_id > 5 THEN greatest(value, user_id) END AS b FROM ev")


def _of(text: str):
    def build(s, d):
        i, v = iv(s, d)
        i = i.where("user_id <> 3")
        return formula.evaluate(formula.parse_formula(text), i, v, "rid", "z")

    return build


_J = f"WITH {EP}, {_IV}, j AS (SELECT * FROM i WHERE user_id <> 3)"
register("of_freq", "rid:i z:f", _of("freq(user_id)"), f"{_J} SELECT v.rid, g.n AS z FROM v LEFT JOIN (SELECT user_id, count(*) AS n FROM j GROUP BY 1) g USING (user_id)")
register("of_combine", "rid:i z:f", _of("Combine(user_id,event_type)"), f"{_J}, g AS (SELECT user_id, event_type, row_number() OVER (ORDER BY min(rid)) - 1 AS n FROM j GROUP BY 1, 2) SELECT v.rid, g.n AS z FROM v LEFT JOIN g USING (user_id, event_type)")
register("of_combfreq", "rid:i z:f", _of("CombineThenFreq(user_id,event_type)"), f"{_J} SELECT v.rid, g.n AS z FROM v LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM j GROUP BY 1, 2) g USING (user_id, event_type)")
for _name, _op, _sql in (("gmin", "Min", "min(value)"), ("gmax", "Max", "max(value)"), ("gmean", "Mean", "avg(value)"), ("gmedian", "Median", "median(value)"), ("gstd", "Std", "stddev_samp(value)"), ("gnunique", "NUnique", "count(DISTINCT value)")):
    register(f"of_{_name}", "rid:i z:f", _of(f"GroupByThen{_op}(value,user_id)"), f"{_J} SELECT v.rid, g.n AS z FROM v LEFT JOIN (SELECT user_id, {_sql} AS n FROM j GROUP BY 1) g USING (user_id)")
register("of_grank", "rid:i z:f", _of("GroupByThenRank(value,user_id)"), f"{_J} SELECT v.rid, (SELECT count(*) FILTER (j.value <= v.value) / nullif(count(*), 0)::DOUBLE FROM j WHERE j.user_id = v.user_id) AS z FROM v")
register("of_grank_fit", "rid:i z:f", lambda s, d: formula.fit_rank(iv(s, d)[0], "value", "user_id", "z"), f"WITH {EP}, {_IV} SELECT a.rid, (count(*) FILTER (b.value < a.value) + (count(*) FILTER (b.value = a.value) + 1) / 2.0::DOUBLE) / count(*) AS z FROM i a JOIN i b USING (user_id) GROUP BY a.rid, a.value")
register("of_tree", "rid:i z:f", _of("/(GroupByThenMean(value,user_id),sqrt(GroupByThenMax(abs(value),event_type)))"), f"{_J} SELECT v.rid, (SELECT avg(value) FROM j WHERE j.user_id = v.user_id) / sqrt(abs((SELECT max(abs(value)) FROM j WHERE j.event_type = v.event_type))) AS z FROM v")

# ------------------------------------------------------------------ histories: orders have tied times

_PAIRS = "pr AS (SELECT a.rid, b.t AS bt, b.price AS bv, row_number() OVER (PARTITION BY a.rid ORDER BY b.t DESC, b.rid DESC) AS k FROM od a JOIN od b ON a.cust = b.cust AND b.t < a.t)"
_FINISH = {
    "count": "coalesce(g.n, 0)", "repeat": "CASE WHEN g.n > 0 THEN 1 ELSE 0 END", "sum": "coalesce(g.s, 0)", "mean": "coalesce(g.m, 0)", "std": "coalesce(g.sd, 0)", "last": "coalesce(g.lv, 0)",
    "deviation": "coalesce(od.price - g.m, 0)", "time_since": "coalesce(od.t - g.lt, -1)",
}


def _history_sql(agg: str, w: int, shift: int, out: str = "z") -> str:
    seen = f"k >= {shift}" + (f" AND k < {shift + w}" if w else "")
    return f"WITH {OD}, {_PAIRS}, g AS (SELECT rid, count(*) AS n, sum(bv) AS s, avg(bv) AS m, stddev_pop(bv) AS sd, arg_min(bv, k) AS lv, arg_min(bt, k) AS lt FROM pr WHERE {seen} GROUP BY rid) SELECT od.rid, {_FINISH[agg]} AS {out} FROM od LEFT JOIN g USING (rid)"


def _history(*specs: HistorySpec, names: list[str]):
    return lambda s, d: history.with_history(orders(s, d), specs, "t", "rid", {"y"}, dict(zip(specs, names, strict=True)))


for _agg, _w, _s in (("count", 0, 1), ("repeat", 0, 1), ("sum", 0, 1), ("mean", 5, 1), ("std", 0, 1), ("last", 1, 2), ("deviation", 5, 1), ("time_since", 0, 1), ("mean", 3, 2)):
    _spec = HistorySpec(("cust",), _agg, None if _agg in history.VALUELESS else "price", _w, _s)
    register(f"hist_{_agg}" + ("_shifted" if (_agg, _s) == ("mean", 2) else ""), f"rid:i z:{'f' if _agg in ('count', 'repeat') else 'g'}", _history(_spec, names=["z"]), _history_sql(_agg, _w, _s))
_LIB = [s for s in history.history_library(["cust", "prio"], ["price"])]
_LIB_NAMES = [f"{'x'.join(s.entity)}_{s.agg}" for s in _LIB]


def _lib_sql() -> str:
    parts, keys = [], {"cust": "a.cust = b.cust", "prio": "a.prio = b.prio", "custxprio": "a.cust = b.cust AND a.prio = b.prio"}
    ctes = []
    for k, on in keys.items():
        if k == "prio":  # few values: a running frame by time stands for the join
            ctes.append("g_prio AS (SELECT rid, count(*) OVER w AS n, avg(price) OVER w AS m, max(t) OVER w AS lt FROM od WINDOW w AS (PARTITION BY prio ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP))")
        else:
            ctes.append(f"g_{k} AS (SELECT a.rid, count(*) AS n, avg(b.price) AS m, max(b.t) AS lt FROM od a JOIN od b ON {on} AND b.t < a.t GROUP BY 1)")
        parts += [f"coalesce(g_{k}.n, 0) AS {k}_count", f"CASE WHEN g_{k}.n > 0 THEN 1 ELSE 0 END AS {k}_repeat", f"coalesce(od.t - g_{k}.lt, -1) AS {k}_time_since", f"CASE WHEN g_{k}.n > 0 THEN od.price - g_{k}.m ELSE 0 END AS {k}_deviation"]
    return f"WITH {OD}, {', '.join(ctes)} SELECT od.rid, {', '.join(parts)} FROM od " + " ".join(f"LEFT JOIN g_{k} USING (rid)" for k in keys)


register("hist_library", "rid:i " + " ".join(f"{n}:g" for n in _LIB_NAMES), _history(*_LIB, names=_LIB_NAMES), _lib_sql())
_GRID = history.rolling_grid("cust", "price", ("mean", "std", "last"), (5, 10, 20))
_GRID_NAMES = [f"{s.agg}_{s.window}" for s in _GRID]
register("roll_grid", "rid:i " + " ".join(f"{n}:g" for n in _GRID_NAMES), _history(*_GRID, names=_GRID_NAMES), f"WITH {OD}, {_PAIRS}, " + ", ".join(f"g{w} AS (SELECT rid, avg(bv) AS m, stddev_pop(bv) AS sd, arg_min(bv, k) AS lv FROM pr WHERE k <= {w} GROUP BY rid)" for w in (5, 10, 20)) + " SELECT od.rid, " + ", ".join(f"coalesce(g{w}.{c}, 0) AS {a}_{w}" for a, c in (("mean", "m"), ("std", "sd"), ("last", "lv")) for w in (5, 10, 20)) + " FROM od " + " ".join(f"LEFT JOIN g{w} USING (rid)" for w in (5, 10, 20)))
_ROWS = "SELECT a.rid, b.rid AS brid, b.t AS bt, b.price AS bv, b.prio AS bprio, row_number() OVER (PARTITION BY a.rid ORDER BY b.t DESC, b.rid DESC) AS k FROM od a JOIN od b ON a.cust = b.cust AND (b.t < a.t OR b.t = a.t AND b.rid < a.rid)"
register("bank_prior_count", "rid:i z:i", lambda s, d: history.prior_count(orders(s, d), ["cust"], "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, count(r.brid) AS z FROM od LEFT JOIN r USING (rid) GROUP BY 1")
register("bank_gap", "rid:i z:f", lambda s, d: history.gap(orders(s, d), ["cust"], "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, od.t - r.bt AS z FROM od LEFT JOIN r ON r.rid = od.rid AND k = 1")
register("bank_mean_ratio", "rid:i z:f", lambda s, d: history.mean_ratio(orders(s, d), ["cust"], "price", "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, any_value(od.price) / (abs(avg(r.bv)) + 1) AS z FROM od LEFT JOIN r USING (rid) GROUP BY 1")
register("pair_prior", "rid:i z:i", lambda s, d: history.prior_count(orders(s, d), ["cust", "prio"], "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, count(r.brid) FILTER (r.bprio = od.prio) AS z FROM od LEFT JOIN r USING (rid) GROUP BY 1")
register("pair_gap", "rid:i z:f", lambda s, d: history.gap(orders(s, d), ["cust", "prio"], "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, any_value(od.t) - max(r.bt) FILTER (r.bprio = od.prio) AS z FROM od LEFT JOIN r USING (rid) GROUP BY 1")
register("prior_nunique", "rid:i z:i", lambda s, d: history.prior_distinct(orders(s, d), "cust", "prio", "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, count(DISTINCT r.bprio) AS z FROM od LEFT JOIN r USING (rid) GROUP BY 1")
register("agg_rolling", "rid:i a:g b:g c:g", lambda s, d: history.rolling(orders(s, d), "cust", "price", 4, "t", "rid", {"a": "mean", "b": "max", "c": "std"}), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, avg(bv) AS a, max(bv) AS b, stddev_samp(bv) AS c FROM od LEFT JOIN r ON r.rid = od.rid AND k <= 4 GROUP BY 1")
register("agg_lag", "rid:i z:f", lambda s, d: history.lagged(orders(s, d), ["cust"], "price", 2, "t", "rid", "z"), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, r.bv AS z FROM od LEFT JOIN r ON r.rid = od.rid AND k = 2")
register("agg_expanding", "rid:i a:g b:g", lambda s, d: history.expanding(orders(s, d), "cust", "price", "t", "rid", {"a": "mean", "b": "min"}), f"WITH {OD}, r AS ({_ROWS}) SELECT od.rid, avg(bv) AS a, min(bv) AS b FROM od LEFT JOIN r USING (rid) GROUP BY 1")
register("agg_group", "rid:i z:f", lambda s, d: (lambda i, v: history.group_statistic(i, v, "user_id", "value", "std", "z"))(*iv(s, d)), f"WITH {EP}, {_IV} SELECT v.rid, g.z FROM v LEFT JOIN (SELECT user_id, stddev_samp(value) AS z FROM i GROUP BY 1) g USING (user_id)")
register("agg_periodic", "rid:i tod_sin:f tod_cos:f dow:i", lambda s, d: orders(s, d).withColumns(encode.calendar(F.col("t"))), f"WITH {OD} SELECT rid, sin(t / 86400 * 2 * pi()) AS tod_sin, cos((t % 86400) / 86400 * 2 * pi()) AS tod_cos, isodow(to_timestamp(t) AT TIME ZONE 'UTC') - 1 AS dow FROM od")

# ------------------------------------------------------------------ drift, ranks, quantiles: the first 80 % of I and V against the rest


def late_part(s, d):
    df = placed(events(s, d))
    n = df.count()
    return df.withColumns({"late": F.col("_pos") >= int(0.8 * n), "w": F.col("value") * (1 + F.col("_pos") / n), "u": F.col("user_id").cast("double") + 0.25})


_COLS = ["value", "w", "u"]
_LATE = EP + ", lt AS (SELECT rid, y, pos >= floor(0.8 * n) AS late, value, value * (1 + pos / n::DOUBLE) AS w, user_id + 0.25::DOUBLE AS u FROM ep), un AS (SELECT rid, y, late, unnest(['value', 'w', 'u']) AS \"column\", unnest([value, w, u]) AS x FROM lt)"
_EDGES = ", ed AS (SELECT \"column\", unnest(list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))) AS e FROM un WHERE NOT late GROUP BY 1), inn AS (SELECT \"column\", e FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY e) AS k, count(*) OVER (PARTITION BY \"column\") AS m FROM ed) WHERE k > 1 AND k < m), bn AS (SELECT un.*, (SELECT count(*) FROM inn WHERE inn.\"column\" = un.\"column\" AND un.x >= inn.e) AS bin FROM un), hs AS (SELECT \"column\", bin, count(*) FILTER (NOT late) AS early, count(*) FILTER (late) AS late FROM bn GROUP BY 1, 2)"
_PSI = ", gr AS (SELECT c.\"column\", b.bin FROM (SELECT DISTINCT \"column\" FROM un) c, (SELECT unnest(range(10)) AS bin) b WHERE b.bin <= (SELECT count(*) FROM inn WHERE inn.\"column\" = c.\"column\")), sh AS (SELECT gr.\"column\", greatest(coalesce(early, 0) / sum(coalesce(early, 0)) OVER w::DOUBLE, 1e-4) AS p, greatest(coalesce(late, 0) / sum(coalesce(late, 0)) OVER w::DOUBLE, 1e-4) AS q FROM gr LEFT JOIN hs USING (\"column\", bin) WINDOW w AS (PARTITION BY gr.\"column\")), ps AS (SELECT \"column\", sum((q - p) * ln(q / p)) AS psi FROM sh GROUP BY 1)"
_AUC = ", ct AS (SELECT \"column\", x, count(*) FILTER (NOT late) AS e, count(*) FILTER (late) AS l FROM un GROUP BY 1, 2), au AS (SELECT \"column\", sum(l * (coalesce(under, 0) + e / 2.0)) / (sum(e) * sum(l))::DOUBLE AS adv_auc FROM (SELECT *, sum(e) OVER (PARTITION BY \"column\" ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM ct) GROUP BY 1)"
register("quantiles", "column:s edge:f", lambda s, d: drift.quantile_edges(late_part(s, d), _COLS).select("column", F.explode("edges").alias("edge")), f"WITH {_LATE} SELECT \"column\", unnest(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM un GROUP BY 1")
register("decile_hist", "column:s bin:i early:i late:i", lambda s, d: drift.decile_histogram(late_part(s, d), _COLS, "late"), f"WITH {_LATE}{_EDGES} SELECT * FROM hs")
register("psi", "column:s psi:f", lambda s, d: drift.psi(late_part(s, d), _COLS, "late"), f"WITH {_LATE}{_EDGES}{_PSI} SELECT * FROM ps")
register("adv_auc", "column:s adv_auc:f", lambda s, d: drift.adversarial_auc(late_part(s, d), _COLS, "late"), f"WITH {_LATE}{_AUC} SELECT * FROM au")
register("stability_screen", "column:s psi:f adv_auc:f stable:b", lambda s, d: drift.stability(late_part(s, d), _COLS, "late"), f"WITH {_LATE}{_EDGES}{_PSI}{_AUC} SELECT \"column\", psi, adv_auc, psi <= 0.25 AND abs(adv_auc - 0.5) <= 0.15 AS stable FROM ps JOIN au USING (\"column\")")
register("drift_table", "column:s kind:s psi:f adv_auc:f unseen:f shifted:b", lambda s, d: drift.drift_table(late_part(s, d), _COLS, ["event_type"], "late"), f"WITH {_LATE}{_EDGES}{_PSI}{_AUC} SELECT \"column\", 'numeric' AS kind, psi, adv_auc, NULL AS unseen, psi > 0.25 OR abs(adv_auc - 0.5) > 0.15 AS shifted FROM ps JOIN au USING (\"column\") UNION ALL SELECT 'event_type', 'categorical', NULL, NULL, avg(CAST(event_type NOT IN (SELECT event_type FROM ep WHERE pos < floor(0.8 * n)) AS INT)), avg(CAST(event_type NOT IN (SELECT event_type FROM ep WHERE pos < floor(0.8 * n)) AS INT)) > 0.2 FROM ep WHERE pos >= floor(0.8 * n)")
register("spearman", "a:s b:s rho:f", lambda s, d: drift.spearman(late_part(s, d), _COLS, "rid"), f"WITH {_LATE}, rk AS (SELECT rid, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rv, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS rw, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0::DOUBLE AS ru FROM lt) SELECT 'value' AS a, 'w' AS b, corr(rv, rw) AS rho FROM rk UNION ALL SELECT 'value', 'u', corr(rv, ru) FROM rk UNION ALL SELECT 'w', 'u', corr(rw, ru) FROM rk")
register("dedup", "column:s", lambda s, d: (lambda df: s.createDataFrame([(c,) for c in drift.deduplicate(df.withColumn("v2", F.col("value") * 2), ["value", "v2", "w", "u"], "rid")], "column string"))(late_part(s, d)), f"WITH {_LATE}, rk AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rv, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS rw, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0::DOUBLE AS ru FROM lt), c AS (SELECT corr(rv, rw) AS vw, corr(rv, ru) AS vu, corr(rw, ru) AS wu FROM rk) SELECT 'value' AS \"column\" FROM c UNION ALL SELECT 'w' FROM c WHERE abs(vw) < 0.95 UNION ALL SELECT 'u' FROM c WHERE abs(vu) < 0.95 AND (abs(wu) < 0.95 OR abs(vw) >= 0.95)")
register("stump_gain", "column:s gain:f", lambda s, d: drift.stump_gain(late_part(s, d), _COLS, "y", 16), f"WITH {_LATE}, ed AS (SELECT DISTINCT \"column\", unnest(quantile_cont(x, [i / 16.0::DOUBLE FOR i IN range(1, 16)])) AS e FROM un GROUP BY 1), tt AS (SELECT \"column\", count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM un GROUP BY 1), sp AS (SELECT ed.\"column\", ed.e, count(*) FILTER (x < e) AS nl, sum(y) FILTER (x < e) AS sl FROM ed JOIN un USING (\"column\") GROUP BY 1, 2) SELECT \"column\", coalesce(max((sl * sl / nl::DOUBLE + (s - sl) * (s - sl) / (n - nl)::DOUBLE - s * s / n::DOUBLE) / (q - s * s / n::DOUBLE)), 0) AS gain FROM sp JOIN tt USING (\"column\") WHERE nl > 0 AND nl < n GROUP BY 1")
register("posneg_gap", "column:s gap:f", lambda s, d: drift.class_gap(late_part(s, d), _COLS, F.col("y") == 1, F.col("y") == 0), f"WITH {_LATE} SELECT \"column\", (median(x) FILTER (y = 1) - median(x) FILTER (y = 0)) / (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS gap FROM un GROUP BY 1")
register("impute_median", "rid:i x:f", lambda s, d: drift.impute_median(events(s, d).withColumn("x", F.when(F.col("user_id") % 4 != 0, F.col("value"))), ["x"]), f"WITH {EV} SELECT rid, CASE WHEN user_id % 4 <> 0 THEN value ELSE (SELECT median(value) FROM ev WHERE user_id % 4 <> 0) END AS x FROM ev")
register("disagreement", "rid:i z:f", lambda s, d: experts.disagreement(events(s, d), ["p", "q"], "z"), f"WITH {EV} SELECT rid, abs(p - q) / 2 AS z FROM ev")
_NORMAL = """x AS (SELECT rid, greatest(least((rank() OVER (ORDER BY value) - 1 + (count(*) OVER (PARTITION BY value)) / 2.0::DOUBLE) / count(*) OVER (), 1 - 1e-12), 1e-12) AS p FROM ev),
    z AS (SELECT rid, p, p - 0.5::DOUBLE AS m, (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM x)
    SELECT rid, CASE WHEN least(p, 1 - p) < 0.02425 THEN sign(0.5 - p) * (((((-7.784894002430293e-03 * t - 3.223964580411365e-01) * t - 2.400758277161838e+00) * t - 2.549732539343734e+00) * t + 4.374664141464968e+00) * t + 2.938163982698783e+00)
            / ((((7.784695709041462e-03 * t + 3.224671290700398e-01) * t + 2.445134137142996e+00) * t + 3.754408661907416e+00) * t + 1)
        ELSE (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r - 2.759285104469687e+02) * r + 1.383577518672690e+02) * r - 3.066479806614716e+01) * r + 2.506628277459239e+00) * m
            / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r - 1.556989798598866e+02) * r + 6.680131188771972e+01) * r - 1.328068155288572e+01) * r + 1) END AS value_z FROM z"""
register("normal_scores", "rid:i value_z:f", lambda s, d: drift.inverse_normal(events(s, d), ["value"], "rid"), f"WITH {EV}, {_NORMAL}")

# ------------------------------------------------------------------ metrics


def _ap_sql(rows: str, keys: str = "") -> str:
    """rows: a table (keys..., y, s)."""
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT {k}sum(pos * cp / (cn * tp)::DOUBLE) AS ap FROM (SELECT {k}s, pos, sum(n) OVER ({part}ORDER BY s DESC) AS cn, sum(pos) OVER ({part}ORDER BY s DESC) AS cp, sum(pos) OVER ({part[:-1]}) AS tp FROM (SELECT {k}s, count(*) AS n, sum(y) AS pos FROM {rows} GROUP BY {k}s)) " + (f"GROUP BY {keys}" if keys else "")


_EVS = EV + ", sc AS (SELECT y, round(p, 2) AS s FROM ev)"
_rounded = lambda s, d: events(s, d).withColumn("s", F.round("p", 2))
register("avg_precision", "ap:f", lambda s, d: metrics.average_precision(_rounded(s, d), "y", "s"), f"WITH {_EVS} {_ap_sql('sc')}")
register("roc_auc", "auc:f", lambda s, d: metrics.roc_auc(_rounded(s, d), "y", "s"), f"WITH {_EVS}, g AS (SELECT s, sum(y) AS a, sum(1 - y) AS b FROM sc GROUP BY 1) SELECT sum(g.a * (h.b * CASE WHEN h.s < g.s THEN 1.0::DOUBLE WHEN h.s = g.s THEN 0.5::DOUBLE ELSE 0 END)) / (SELECT sum(a) * sum(b) FROM g) AS auc FROM g, g AS h")
register("pr_points", "precision_at_recall_50:f precision_at_recall_80:f recall_at_precision_50:f recall_at_precision_80:f recall_in_top:f", lambda s, d: metrics.pr_points(_rounded(s, d), "y", "s"), f"WITH {_EVS}, c AS (SELECT cp / cn::DOUBLE AS pr, cp / tp::DOUBLE AS re, cn, tn FROM (SELECT sum(n) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(pos) OVER () AS tp, sum(n) OVER () AS tn FROM (SELECT s, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1))) SELECT max(pr) FILTER (re >= 0.5) AS precision_at_recall_50, max(pr) FILTER (re >= 0.8) AS precision_at_recall_80, coalesce(max(re) FILTER (pr >= 0.5), 0) AS recall_at_precision_50, coalesce(max(re) FILTER (pr >= 0.8), 0) AS recall_at_precision_80, coalesce(max(re) FILTER (cn <= ceil(tn * 0.01)), 0) AS recall_in_top FROM c")
register("ap_quarters", "quarter:i ap:f", lambda s, d: (lambda df: metrics.average_precision(df.withColumn("quarter", split.block_of(F.col("_pos"), df.count(), 4) + 1), "y", "p", ["quarter"]))(placed(events(s, d))), f"WITH {EP}, sc AS (SELECT ntile(4) OVER (ORDER BY pos) AS quarter, y, p AS s FROM ep) {_ap_sql('sc', 'quarter')}")
register("error_profile", "column:s threshold:f tp:i fp:i fn:i tn:i fn_gap:f fp_gap:f", lambda s, d: metrics.best_f1_profile(_rounded(s, d), "y", "s", ["value", "user_id"]), f"WITH {EV}, sc AS (SELECT *, round(p, 2) AS s FROM ev), c AS (SELECT s, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER () AS tp FROM (SELECT s, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1) WINDOW w AS (ORDER BY s DESC)), b AS (SELECT s AS th FROM c ORDER BY 2 * cp / (cn + tp)::DOUBLE DESC, s DESC LIMIT 1), r AS (SELECT sc.*, b.th, s >= th AS hit FROM sc, b), u AS (SELECT th, hit, y, unnest(['value', 'user_id']) AS \"column\", unnest([value, user_id::DOUBLE]) AS x FROM r) SELECT \"column\", any_value(th) AS threshold, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn, median(x) FILTER (NOT hit AND y = 1) - median(x) FILTER (hit AND y = 1) AS fn_gap, median(x) FILTER (hit AND y = 0) - median(x) FILTER (NOT hit AND y = 0) AS fp_gap FROM u GROUP BY 1")

# ------------------------------------------------------------------ residual scoring and selection

register("residual", "rid:i r:f r0:f", lambda s, d: score.residual(score.residual(events(s, d), "y", "p", "r"), "y", None, "r0"), f"WITH {EV} SELECT rid, y - p AS r, y - (SELECT avg(y) FROM ev) AS r0 FROM ev")
_CANDS = {"c1": "value", "c2": "user_id", "c3": "value * user_id", "c4": "ln(1 + value)"}
_cands = lambda s, d: score.residual(events(s, d).withColumns({"c1": F.col("value"), "c2": F.col("user_id").cast("double"), "c3": F.col("value") * F.col("user_id"), "c4": F.log1p("value")}), "y", "p", "r")
_CAND_SQL = EV + ", cd AS (SELECT rid, y, y - p AS r, value AS c1, user_id::DOUBLE AS c2, value * user_id AS c3, ln(1 + value) AS c4 FROM ev)"
_SCORES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, r) AS score FROM cd" for c in _CANDS)
register("corr_score", "column:s score:f", lambda s, d: score.correlation_scores(_cands(s, d), list(_CANDS), "r"), f"WITH {_CAND_SQL} {_SCORES}")
register("topk_scores", "column:s score:f", lambda s, d: score.top_scores(score.correlation_scores(_cands(s, d), list(_CANDS), "r"), 2), f"WITH {_CAND_SQL} SELECT * FROM ({_SCORES}) ORDER BY abs(score) DESC, \"column\" LIMIT 2")


def _folds5(df):
    return df.withColumn("fold", (F.col("rid") % 5).cast("int"))


_RIDGE1 = ", fd AS (SELECT *, rid % 5 AS fold FROM cd), st AS (SELECT g.fold, count(*) AS n, avg(c1) AS mx, var_pop(c1) AS vx, avg(c4) AS my, covar_pop(c1, c4) AS cxy FROM (SELECT DISTINCT fold FROM fd) g JOIN fd h ON h.fold <> g.fold GROUP BY 1), rs AS (SELECT rid, r, c4, c4 - my - (n * cxy / sqrt(vx) / (n + 1)) * (c1 - mx) / sqrt(vx) AS e FROM fd JOIN st USING (fold))"
register("resid_cand", "rid:i e:f", lambda s, d: score.residualise(_folds5(_cands(s, d)), ["c1"], "c4", "fold", "e"), f"WITH {_CAND_SQL}{_RIDGE1} SELECT rid, e FROM rs")
register("resid_score", "score:f", lambda s, d: s.createDataFrame([(score.scores_of(score.gram(_folds5(_cands(s, d)), ["c1", "c4", "r"], "fold"), ["c1"], ["c4"], "r")["c4"],)], "score double"), f"WITH {_CAND_SQL}{_RIDGE1} SELECT corr(e, r) AS score FROM rs")


def _greedy(s, d):
    g = score.gram(_folds5(_cands(s, d)), [*_CANDS, "r"], "fold")
    entered, first = score.greedy_entry(g, [], list(_CANDS), "r", 0.02)
    return s.createDataFrame([(c, float(first[c]), entered.index(c) + 1 if c in entered else None) for c in _CANDS], "column string, first double, place int")


register("greedy_entry", "column:s first:f place:i", _greedy)


def _trailing(s, d):
    df = placed(_cands(s, d))
    holds = score.trailing_check(df, [], list(_CANDS), "r", "rid", "_pos", score.candidate_scores(df, [], list(_CANDS), "r", "rid"), 1, 0.02)
    return s.createDataFrame([(c, holds[c]) for c in _CANDS], "column string, holds boolean")


#: Without base columns a residual is the candidate less its mean over other folds; the signs are those of the plain correlations.
_SIGNS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, r) * corr({c}, r) FILTER (pos >= n - round(0.3 * n)) > 0 AS holds FROM tr" for c in _CANDS)
register("trailing_check", "column:s holds:b", _trailing, f"WITH {_CAND_SQL}, tr AS (SELECT cd.*, row_number() OVER (ORDER BY t, rid) - 1 AS pos, count(*) OVER () AS n FROM cd JOIN (SELECT rid, t FROM ev) USING (rid)) {_SIGNS}")
_TESTS = "ts AS (SELECT p_partkey AS k, (p_partkey * 7919 % 1000 + 1) / 1001.0::DOUBLE * (p_size / 50.0::DOUBLE) AS pv FROM part)"
_tests = lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001.0 * (F.col("p_size") / 50.0)).alias("pv"))
register("bh_select", "k:i adjusted:f selected:b", lambda s, d: score.step_up(_tests(s, d), "pv", "k", 0.3), f"WITH {_TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY pv, k) AS rk, count(*) OVER () AS m FROM ts), a AS (SELECT k, least(1, min(pv * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM r) SELECT k, adjusted, adjusted <= 0.3 AS selected FROM a")
_FLOOR = lambda s, d: score.noise_floor(_tests(s, d).select("k", (F.col("k") % 3).alias("seat"), (F.col("k") % 7 == 0).alias("is_noise"), (F.col("pv") - 0.3).alias("score")), "seat", "k", 0.2, 10)
register("noise_floor", "k:i seat:i floor:f place:i", _FLOOR, f"WITH {_TESTS}, x AS (SELECT k, k % 3 AS seat, k % 7 = 0 AS noise, pv - 0.3::DOUBLE AS score FROM ts), f AS (SELECT seat, greatest(0.2, max(abs(score)) FILTER (noise)) AS floor FROM x GROUP BY 1) SELECT k, seat, floor, row_number() OVER (PARTITION BY seat ORDER BY abs(score) DESC, k) AS place FROM x JOIN f USING (seat) WHERE NOT noise AND abs(score) >= floor QUALIFY place <= 10")
register("perm_exit", "feature:s importance:f", lambda s, d: admit.exits(_tests(s, d).select(F.concat(F.lit("f"), "k").alias("feature"), (F.col("pv") - 0.02).alias("importance")), 3), f"WITH {_TESTS} SELECT 'f' || k AS feature, pv - 0.02::DOUBLE AS importance FROM ts WHERE pv - 0.02::DOUBLE <= 0 ORDER BY 2, 1 LIMIT 3")
_TICKET = "tk AS (SELECT rid, value, ('0x' || substring(md5('5|value|' || rid), 1, 13))::BIGINT AS ticket FROM ev)"
register("permute_col", "rid:i value_shuffled:f", lambda s, d: admit.permute(events(s, d), "value", "rid", 5), f"WITH {EV}, {_TICKET}, a AS (SELECT rid, row_number() OVER (ORDER BY rid) AS k FROM ev), b AS (SELECT value AS value_shuffled, row_number() OVER (ORDER BY ticket, rid) AS k FROM tk) SELECT rid, value_shuffled FROM a JOIN b USING (k)")
_predict = lambda df: df.withColumn("p", 1 / (1 + F.abs(F.col("value")) / 10) + F.col("user_id") / 10000)
_DEALT = ", ".join(f"{c}_k AS (SELECT {c} AS v, row_number() OVER (ORDER BY ('0x' || substring(md5('0|{c}|' || rid), 1, 13))::BIGINT, rid) AS k FROM ev)" for c in ("value", "user_id"))
_PERMUTED = f"""{EV}, {_DEALT}, base AS (SELECT *, row_number() OVER (ORDER BY rid) AS k, rid % 2 AS half FROM ev), f AS (SELECT b.half, b.y, unnest(['plain', 'value', 'user_id']) AS feature,
    unnest([1 / (1 + abs(b.value) / 10) + b.user_id / 10000, 1 / (1 + abs(a.v) / 10) + b.user_id / 10000, 1 / (1 + abs(b.value) / 10) + u.v / 10000]) AS s FROM base b JOIN value_k a USING (k) JOIN user_id_k u USING (k))"""
register("perm_importance", "feature:s importance:f", lambda s, d: admit.permutation_importance(events(s, d).drop("p"), "y", ["value", "user_id"], "rid", _predict), f"WITH {_PERMUTED}, a AS ({_ap_sql('f', 'feature')}) SELECT feature, (SELECT ap FROM a WHERE feature = 'plain') - ap AS importance FROM a WHERE feature <> 'plain'")


def _shadow(s, d):
    df = events(s, d).drop("p").withColumns({"half": F.col("rid") % 2, "noise": F.pmod(F.xxhash64("rid"), F.lit(1000)) / 1000.0})
    return admit.shadow_admit(admit.permutation_importance(df, "y", ["value", "user_id", "noise"], "rid", _predict, by=["half"]), ["noise"], "half")


#: The model doesn't read the shadow, so its importance is 0.
register("shadow_admit", "feature:s", _shadow, f"WITH {_PERMUTED}, a AS ({_ap_sql('f', 'half, feature')}) SELECT x.feature FROM a x JOIN a z ON z.half = x.half AND z.feature = 'plain' WHERE x.feature <> 'plain' GROUP BY 1 HAVING min(z.ap - x.ap) > 0")

# ------------------------------------------------------------------ gates, experts

register("bootstrap_se", "gain:f se:f lower:f upper:f repeats:i", lambda s, d: gate.bootstrap_gain(events(s, d), "y", "p", "q", "rid"))
register("gate", "region:i gain:f passed:b", lambda s, d: gate.decide(gate.bootstrap_gain(events(s, d).withColumn("region", F.col("rid") % 3), "y", "p", "q", "rid", ["region"])))
register("boot_gate", "seed:i gain:f lower:f passed:b", lambda s, d: gate.stratified_gate(events(s, d), "y", "p", "q", "rid"))
register("stack_gate", "stacked:b", lambda s, d: s.createDataFrame([(gate.stack_decision(gate.bootstrap_gain(events(s, d), "y", "p", "q", "rid")),)], "stacked boolean"))
_CORE = EV + ", sk AS (SELECT unnest(['p', 'q', 'm']) AS c, unnest([p, q, (p + q) / 2]) AS s, y FROM ev), aps AS (" + _ap_sql("sk", "c") + ")"
register("choose_core", "candidate:s ap:f chosen:b", lambda s, d: gate.choose_core(events(s, d).withColumn("m", (F.col("p") + F.col("q")) / 2), "y", ["p", "q", "m"]), f"WITH {_CORE} SELECT c AS candidate, ap, c = (SELECT c FROM aps ORDER BY ap DESC, instr('pqm', c) LIMIT 1) AS chosen FROM aps")


def _rules(s, d):
    rules = experts.slice_rules(events(s, d).withColumn("kind", F.col("user_id") % 10), ["value", "kind"], "rid")
    return s.createDataFrame([(r.column, r.low, r.high, None if r.value is None else float(r.value)) for r in rules], "column string, low double, high double, value double")


register("slice_rules", "column:s low:f high:f value:f", _rules, f"WITH {EV}, e AS (SELECT unnest(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS e FROM ev), b AS (SELECT e AS hi, lag(e) OVER (ORDER BY e) AS lo FROM (SELECT e FROM e UNION ALL SELECT NULL) ORDER BY e NULLS LAST), f AS (SELECT user_id % 10 AS v, min(rid) AS at FROM ev GROUP BY 1 ORDER BY 2 LIMIT 8) SELECT 'value' AS \"column\", CASE WHEN hi IS NULL THEN (SELECT max(e) FROM e) ELSE lo END AS low, hi AS high, NULL AS value FROM b UNION ALL SELECT 'kind', NULL, NULL, v FROM f")
_RULES = [experts.SliceRule("value", None, 10.0), experts.SliceRule("value", 10.0, 60.0), experts.SliceRule("user_id", value=3)]
register("slice_lift", "rule:s n:i positives:i coverage:f lift:f needed:f fits:b", lambda s, d: experts.slice_lift(score.residual(events(s, d), "y", "p", "r"), _RULES, "y", "r"), f"WITH {EV}, m AS (SELECT abs(y - p) AS r, y, unnest(['value in (None, 10.0]', 'value in (10.0, 60.0]', 'user_id=3']) AS rule, unnest([value <= 10, value > 10 AND value <= 60, user_id = 3]) AS k FROM ev), g AS (SELECT rule, count(*) FILTER (k) AS n, coalesce(sum(y) FILTER (k), 0) AS positives, avg(CAST(k AS INT)) AS coverage, avg(r) FILTER (k) / avg(r) FILTER (NOT k) AS lift, greatest(sqrt(sum(y) / nullif(sum(y) FILTER (k), 0)::DOUBLE), 1.15) AS needed FROM m GROUP BY 1) SELECT *, coalesce(coverage >= 0.05 AND coverage <= 0.6 AND positives >= 30 AND lift > needed, FALSE) AS fits FROM g")
register("recency_ladder", "level:i n:i positives:i auc:f direction:i", lambda s, d: (lambda df: experts.recency_ladder(df, "value", "y", "_pos", df.count()))(placed(events(s, d))), f"WITH {EP}, w AS (SELECT k AS level, y, value AS x FROM ep, range(4) AS r(k) WHERE pos >= n - n // CAST(power(2, k) AS BIGINT)), g AS (SELECT level, x, sum(y) AS a, sum(1 - y) AS b FROM w GROUP BY 1, 2), au AS (SELECT level, sum(a * (coalesce(under, 0) + b / 2.0::DOUBLE)) / (sum(a) * sum(b)) AS auc FROM (SELECT *, sum(b) OVER (PARTITION BY level ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM g) GROUP BY 1), z AS (SELECT level, count(*) AS n, sum(y) AS positives FROM w GROUP BY 1) SELECT level, n, positives, CASE WHEN n >= 400 AND positives >= 20 THEN auc END AS auc, CASE WHEN n >= 400 AND positives >= 20 THEN CASE WHEN auc >= 0.56 THEN 1 WHEN auc <= 0.44 THEN -1 ELSE 0 END END AS direction FROM z JOIN au USING (level)")
register("blend", "rid:i z:f", lambda s, d: events(s, d).withColumn("z", experts.blend(F.col("p"), F.col("q"), 0.3, F.col("value") > 20)), f"WITH {EV} SELECT rid, CASE WHEN value > 20 THEN 0.7 * p + 0.3 * q ELSE p END AS z FROM ev")


def _blend_grid(s, d):
    df = placed(events(s, d))
    return experts.blend_grid(df.withColumn("block", split.block_of(F.col("_pos"), df.count(), 5)), "y", "p", "q", "block")


register("blend_grid", "weight:f ap:f", _blend_grid, f"WITH {EP}, b AS (SELECT ntile(5) OVER (ORDER BY pos) - 1 AS block, y, p, q FROM ep), sk AS (SELECT block, weight, y, (1 - weight) * p + weight * q AS s FROM b, (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS weight) WHERE block > 0) SELECT weight, avg(ap) AS ap FROM ({_ap_sql('sk', 'block, weight')}) GROUP BY 1")
register("ensemble_avg", "rid:i z:f", lambda s, d: experts.ensemble_average(events(s, d).withColumn("k", F.when(F.col("user_id") % 2 == 0, F.col("q"))), {"p": 0.5, "k": 0.3}, "z"), f"WITH {EV} SELECT rid, CASE WHEN user_id % 2 = 0 THEN (0.5 * p + 0.3 * q) / 0.8 ELSE p END AS z FROM ev")

# ------------------------------------------------------------------ models and runs: no SQL form


def _oof(s, d):
    from quarry.operators import models

    return models.out_of_fold(events(s, d), ["value", "user_id"], "y", "rid")[0]


def _card(s, d):
    from quarry.operators import models

    card = models.probe_card(events(s, d), ["value", "user_id", "q"], "y", "rid")
    return s.createDataFrame(list(enumerate(card["columns"])), "place int, column string")


def _run(s, d):
    from quarry.plans.config import make_config
    from quarry.plans.pipeline import run

    df = events(s, d).select(F.col("rid").alias(schema.RID), "t", F.col("user_id").cast("string").alias("user"), "value", F.col("y").alias("target"))
    cfg = make_config(time_col="t", entity_cols=["user"], max_rounds=1, cycles=1, proposals=[{"name": "logv", "expression": "np.log1p(df['value'])"}])
    result = run(df, cfg)
    return s.createDataFrame([(k, v["ap"], v["auc"]) for k, v in result.scores.items()], "state string, ap double, auc double")


register("oof_fit", "rid:i p:f", _oof)
register("probe_card", "place:i column:s", _card)
register("run", "state:s ap:f auc:f", _run)
register("demo_table", "event_time:i customer:i target:i income:f", lambda s, d: io.demo(s, 2000))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events by time into parts, the history library, its drift, and its scores against the residual: the steady and telling first."""
    df = parted(events(spark, d))
    specs = [x for x in history.history_library(["user_id"], ["value"])]
    names = [x.name for x in specs]
    rows = score.residual(history.with_history(df.where("_part <> 'T'"), specs, "t", "rid", {"y"}), "y", "p", "r").withColumn("late", F.col("_part") == "V")
    drifted = drift.stability(rows, names, "late")
    return drifted.join(score.correlation_scores(rows.where("_part = 'I'"), names, "r"), "column").orderBy(F.desc("stable"), F.desc(F.abs(F.col("score"))), "column")
