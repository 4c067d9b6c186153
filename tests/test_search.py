import pytest
from pyspark.sql import functions as F

from quarry.operators import formula
from quarry.plans import search


def ladder(features):
    return len(set(features) & {"a", "b"}) + 0.1 * ("c" in features) - ("bad" in features)


def test_accept_blocks_and_refinement():
    blocks = [["a"], ["bad"], ["b", "c"], []]
    kept, log = search.accept_blocks(ladder, lambda k, seen: [{"name": n, "expression": "1"} for n in blocks[k]])
    assert list(kept) == ["a", "b", "c"] and [x["accepted"] for x in log] == [True, False, True]
    kept, _ = search.refine_columns(ladder, lambda k, seen: [{"name": n, "expression": "1"} for n in ("bad", "a")], lambda f: "tree", 1)
    assert list(kept) == ["a"]


def test_islands_keep_the_best():
    features, value = search.islands(ladder, lambda k, seen: [{"name": "abc"[k % 3], "expression": "1"}], rounds=30, seed=1)
    assert value == pytest.approx(2.1) and set(features) == {"a", "b", "c"}


def test_rules_and_formulas(spark):
    df = spark.range(400).select(F.col("id").alias("rid"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 3).alias("k"), ((F.col("id") % 20 > 12) | (F.col("id") % 17 == 0)).cast("int").alias("y"))
    out, used = search.class_rules(df, df, ["df['x'] > 12", "df['x'] > 99", "df['x'] + 1"], "y")
    assert used == ["df['x'] > 12"] and out.where("p > 0.5 and x <= 12").count() == 0
    with pytest.raises(ValueError):
        search.class_rules(df, df, ["df['x'] > 99"], "y")
    ranked = search.rank_formulas(df.withColumn("r", F.col("y") - 0.4), "r", "rid", [formula.parse_formula(t) for t in ("square(x)", "freq(k)", "GroupByThenMean(x,k)")])
    assert ranked[0][0] == "square(x)" and len(search.formula_grid(["x"], ["k"])) == 7 + 7 + 1


def test_moves(spark):
    assert search.prune_seats({"a": 0.6, "b": 0.39, "c": 0.01}) == {"a": 0.6 / 0.99, "b": 0.39 / 0.99}
    assert search.changed_seats({"a": ["x"], "b": []}, {"a": ["x"], "b": ["y"], "c": []}) == ["b"]
    saved = {"d": "df['e'] * 2", "e": "df['x'] + 1"}
    assert list(search.inject_plan(saved, ["x"], "y")) == ["e", "d"] and list(search.inject_plan(saved, ["x"], "y", "bank")) == ["e"]
    assert list(search.inject_plan(saved, ["x"], "y", "gated", lambda names: ["d"])) == ["e", "d"]
    black = search.Blacklist()
    black.add("s", ["x"])
    assert black.allowed("s", ["x", "z"]) == ["z"] and black.allowed("t", ["x"]) == ["x"]
    assert "swp_mul_b_a" in search.seed_sweep({"a": 0.1, "b": -0.9, "c": 0.01}, 2)
    pool = search.beam(["x1", "x2"], lambda p: {n: float("x1" in n) for n in p}, depths=2, width=2)
    assert len(pool) == 4
    df = spark.range(100).select(F.col("id").alias("rid"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + 0.0).alias("good"), F.rand(1).alias("noise"))
    assert search.greedy_weights(df, "y", ["noise", "good"], 3)["good"] >= 2 / 3
    assert {r["_eval"]: r["count"] for r in search.evaluation_folds(df, "rid", 3, "rid", 100).groupBy("_eval").count().collect()} == {None: 40, 0: 20, 1: 20, 2: 20}
    tests = spark.createDataFrame([("s", "f", 0.001), ("t", "f", 0.002), ("s", "g", 0.9)], "seat string, factor string, p double")
    assert [(r["seat"], r["factor"]) for r in search.select_pairs(tests, "seat", "factor", "p").collect()] == [("s", "f")]
    assert 2 <= search.holdout_mark(df, "rid").where("_holdout").count() <= 25


def test_nameless_columns_and_fallback(spark):
    assert search.anonymous_columns(["v1", "income", "V2_log", "col_3", "age2020"], 4) == (["v1", "income", "V2_log", "age2020"], ["col_3"])
    df = spark.createDataFrame([(1, 0.9, 0.1), (0, 0.2, 0.8), (1, 0.8, 0.3), (0, 0.1, 0.4)], "y int, good double, bad double")
    assert search.prefer_plain(df, "y", "good", "bad") and not search.prefer_plain(df, "y", "bad", "good")
