"""A run does each piece of work once."""

from pathlib import Path

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import admit, drift, metrics, models, split
from quarry.operators.history import HistorySpec
from quarry.plans.config import make_config
from quarry.plans.schema import Tables
from quarry.sources import io


def test_histories_of_a_cycle_are_computed_once(spark, monkeypatch):
    from quarry.plans import pipeline

    r = pipeline.Run(io.demo(spark, 1500), make_config(time_col="event_time", entity_cols=["customer"], oof_folds=2))
    r.partition()
    r.encode()
    state = r.fit_state("baseline", {})
    asked = {s.name: s for s in (HistorySpec(("customer",), "count"), HistorySpec(("customer",), "mean", r.raw[0]))}
    calls, plain = [], pipeline.history.with_history
    monkeypatch.setattr(pipeline.history, "with_history", lambda *a, **k: calls.append(1) or plain(*a, **k))
    r.enter(r.stable(asked, state), state)
    assert len(calls) == 1
    few = dict(list(asked.items())[:1])
    assert r.frame(few).select("_rid", *few).exceptAll(r.with_features(few).select("_rid", *few)).isEmpty()
    paths = [Path(p.removeprefix("file:")) for p in r.tables.paths]
    assert paths and all(p.exists() for p in paths)
    r.tables.discard()
    assert not any(p.exists() for p in paths)


def test_importance_predicts_without_a_shuffle_for_every_feature(spark):
    df = spark.range(600).select(F.col("id").alias("rid"), (F.col("id") % 7 == 0).cast("int").alias("y"), (F.col("id") % 14).cast("double").alias("a"), (F.hash("id") % 50).cast("double").alias("b"), (F.col("id") % 2).alias("half"))
    plans = []

    def predict(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.withColumn("p", 1 / (1 + F.abs("a") + F.abs("b") / 100))

    for by in ([], ["half"]):
        got = {tuple(r[c] for c in [*by, "feature"]): r["importance"] for r in admit.permutation_importance(df, "y", ["a", "b"], "rid", predict, 3, by).collect()}
        plain = {tuple(r[c] for c in by): r["ap"] for r in metrics.average_precision(predict(df), "y", "p", by).collect()}
        for f in ("a", "b"):
            moved = admit.permute(df, f, "rid", 3, name="m").withColumn(f, F.col("m"))
            for r in metrics.average_precision(predict(moved), "y", "p", by).collect():
                key = tuple(r[c] for c in by)
                assert got[(*key, f)] == pytest.approx(plain[key] - r["ap"], abs=1e-12)
        assert len(got) == 2 * len(plain)
    assert "Exchange" not in plans[0] and "Join" not in plans[0]


def test_permuted_columns_beyond_one_plan(spark, monkeypatch):
    monkeypatch.setattr(admit, "JOINED", 2)
    df = spark.range(90).select(F.col("id").alias("rid"), *[(F.col("id") * k).alias(f"c{k}") for k in range(1, 6)])
    wide, names = admit.with_permuted(df, df.columns[1:], "rid", 1)
    for c, n in zip(df.columns[1:], names, strict=True):
        assert wide.select("rid", n).exceptAll(admit.permute(df, c, "rid", 1, name=n).select("rid", n)).isEmpty()
    assert wide.count() == 90


@pytest.mark.parametrize("most", [0, 1, 37, 500, 4999, 5000, 6000])
def test_a_sample_is_the_smallest_tickets_without_a_sort_of_all(spark, most):
    df = spark.range(5000).select(F.col("id").alias("rid"), F.lit(1).alias("v"))
    got = split.sample_rows(df, "rid", most, 4)
    tickets = sorted((r["t"], r["rid"]) for r in df.select("rid", split.lottery(4, "rid").alias("t")).collect())
    assert sorted(r["rid"] for r in got.collect()) == sorted(k for _, k in tickets[:most])
    assert "TakeOrdered" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Sort" not in plan


def test_a_sample_of_repeated_and_missing_ids_has_its_size(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(None,)] * 4 + [(k,) for k in range(2, 30)], "rid int")
    for most in range(0, 42, 3):
        assert split.sample_rows(df, "rid", most, 1).count() == min(most, 41)


def test_logistic_probabilities_are_the_learners(spark):
    df = spark.range(400).select(F.col("id").alias("rid"), F.when(F.col("id") % 5 > 0, F.col("id") % 31).alias("a"), (F.hash("id") % 9).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    model = models.fit(df, ["a", "b"], "y")
    own = model.predict(df).select("rid", "p")
    theirs = model.fitted.transform(models.matrix(df, ["a", "b"])).select("rid", vector_to_array("probability")[1].alias("q"))
    assert own.join(theirs, "rid").where("abs(p - q) > 1e-12").isEmpty() and own.count() == 400


def test_stability_with_written_counts(spark):
    df = spark.range(3000).select((F.col("id") % 977).cast("double").alias("a"), F.when(F.col("id") > 1500, F.lit(1.0)).otherwise(F.col("id") % 5).alias("b"), F.lit(None).cast("double").alias("c"), (F.col("id") >= 2000).alias("late"))
    tables = Tables(spark)
    plain, kept = (sorted(tuple(r) for r in drift.stability(df, ["a", "b", "c"], "late", **kw).collect()) for kw in ({}, {"keep": tables.write}))
    assert [r[0] for r in plain] == ["a", "b", "c"] and plain[2][1:] == (0.0, 0.5, True)
    assert all(k[0] == p[0] and k[1:3] == pytest.approx(p[1:3]) for k, p in zip(kept, plain, strict=True))
    tables.discard()
