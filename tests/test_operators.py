import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import admit, drift, encode, experts, formula, gate, history, metrics, score, split
from quarry.operators.history import HistorySpec
from quarry.plans.schema import DatasetSpec, classify, content_hash, require_valid, running_totals, with_position


def test_tied_times_never_see_each_other(spark):
    df = spark.createDataFrame([(0, 1.0, 1, 10.0), (1, 2.0, 1, 20.0), (2, 2.0, 1, 900.0), (3, 3.0, 1, 40.0)], "rid long, t double, e long, v double")
    specs = {"mean": HistorySpec(("e",), "mean", "v"), "count": HistorySpec(("e",), "count"), "gap": HistorySpec(("e",), "time_since"), "last": HistorySpec(("e",), "last", "v", 1, 2)}
    rows = history.with_history(df, specs.values(), "t", "rid", names={s: n for n, s in specs.items()}).orderBy("rid").collect()
    assert [r["mean"] for r in rows] == [0, 10, 10, 310]
    assert [r["count"] for r in rows] == [0, 1, 1, 3]
    assert [r["gap"] for r in rows] == [-1, 1, 1, 1]
    assert [r["last"] for r in rows] == [0, 0, 0, 20]


def test_history_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randint(0, 12)), rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(9))])) for i in range(160)]
    df = spark.createDataFrame(rows, "rid long, t double, e string, v double")
    combos = list(itertools.product(["sum", "mean", "std", "last", "deviation", "count", "time_since", "repeat"], [(0, 1), (5, 1), (3, 2)]))
    specs = {f"{a}_{w}_{s}": HistorySpec(("e",), a, None if a in history.VALUELESS else "v", w, s) for a, (w, s) in combos}
    got = {r["rid"]: r for r in history.with_history(df, specs.values(), "t", "rid", names={s: n for n, s in specs.items()}).collect()}
    for rid, t, e, v in rows:
        past = sorted((x[1], x[0], x[3] or 0.0) for x in rows if x[2] == e and x[1] < t)
        for name, s in specs.items():
            seen = past[: len(past) - (s.shift - 1)] if s.shift > 1 else past
            seen = seen[-s.window :] if s.window else seen
            vals, n, own = [x[2] for x in seen], len(seen), v or 0.0
            want = {
                "count": n, "repeat": float(n > 0), "sum": sum(vals), "mean": np.mean(vals) if n else 0, "std": np.std(vals) if n else 0,
                "last": vals[-1] if n else 0, "deviation": own - np.mean(vals) if n else 0, "time_since": t - seen[-1][0] if n else -1,
            }[s.agg]
            assert got[rid][name] == pytest.approx(float(want), abs=1e-9), (rid, name)


def test_history_refuses_label_and_time(spark):
    df = spark.createDataFrame([(0, 1.0, 1, 1)], "rid long, t double, e long, y int")
    for column in ("y", "t"):
        with pytest.raises(ValueError):
            history.with_history(df, [HistorySpec(("e",), "mean", column)], "t", "rid", {"y"})
    with pytest.raises(ValueError):
        HistorySpec(("e",), "mean", "v", 0, 0)


def test_positions_are_a_total_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, 7.0, 7.5])) for i in range(300)]
    got = {r["rid"]: r["_pos"] for r in with_position(spark.createDataFrame(rows, "rid long, t double"), ["t", "rid"]).collect()}
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
    assert got == want
    assert with_position(spark.createDataFrame([], "rid long, t double"), ["t", "rid"]).count() == 0


def test_running_totals(spark):
    rng = random.Random(8)
    rows = [(k, float(x), rng.randint(0, 5)) for k in ("a", None, "c") for x in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    for r in running_totals(df, "x", ["n"], ["k"], parts=5).collect():
        assert r["cum_n"] == sum(n for k, x, n in rows if k == r["k"] and x <= r["x"]) and r["total_n"] == sum(n for k, _, n in rows if k == r["k"])
    one = df.where("k = 'a'")
    for r in running_totals(one, "x", ["n"], descending=True, parts=7).collect():
        assert r["cum_n"] == sum(n for k, x, n in rows if k == "a" and x >= r["x"])
    assert running_totals(one.limit(0), "x", ["n"]).count() == 0


def test_positions_by_strings(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, ""]) if i % 20 == 0 else "".join(rng.choice("abzé中") for _ in range(rng.randint(1, 9)))) for i in range(400)]
    got = {r["rid"]: r["_pos"] for r in with_position(spark.createDataFrame(rows, "rid long, s string"), ["s", "rid"]).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0])))}


def test_encodings_one_class_and_one_row(spark):
    df = spark.createDataFrame([(0, "a", 1, 0), (1, None, 1, 0), (2, "a", 1, 1)], "rid long, k string, y int, fold int")
    got = {r["rid"]: (r["te_oof"], r["freq_oof"]) for r in encode.out_of_fold(df, "k", "y", "fold").collect()}
    assert got == {0: (1.0, 1.0), 1: (1.0, 0.0), 2: (1.0, 0.5)}
    one = spark.createDataFrame([(0, "a", 1, 0)], "rid long, k string, y int, fold int")
    assert encode.out_of_fold(one, "k", "y", "fold").first()["te_oof"] is None


def test_formula_round_trip_and_errors():
    text = "/(GroupByThenMean(value,user_id),sqrt(abs(value)))"
    assert formula.parse_formula(text).name == text
    for bad in ("abs(", "f(x)", "abs(x))", "", "(x)"):
        with pytest.raises(ValueError):
            formula.parse_formula(bad)


def test_drift_of_equal_and_shifted_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(bool(i % 2), float(a), float(b + 2 * (i % 2)), 1.0, None) for i, (a, b) in enumerate(rng.normal(size=(4000, 2)))]
    df = spark.createDataFrame(rows, "late boolean, same double, moved double, flat double, empty double")
    got = {r["column"]: r for r in drift.stability(df, ["same", "moved", "flat", "empty"], "late").collect()}
    assert got["same"]["psi"] < 0.05 and abs(got["same"]["adv_auc"] - 0.5) < 0.05 and got["same"]["stable"]
    assert got["moved"]["psi"] > 0.25 and got["moved"]["adv_auc"] > 0.9 and not got["moved"]["stable"]
    near = {r["column"]: r["psi"] for r in drift.psi(df, ["same", "moved"], "late", accuracy=10_000).collect()}
    assert near["same"] < 0.05 and abs(near["moved"] - got["moved"]["psi"]) < 0.1
    assert (got["flat"]["psi"], got["empty"]["psi"], got["empty"]["adv_auc"]) == (0.0, 0.0, 0.5)


def test_greedy_entry(spark):
    rng = np.random.default_rng(5)
    x, signal, noise, r0 = rng.normal(size=(4, 3000))
    r = 0.5 * signal + 0.3 * x + r0
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, signal, 2 * signal, noise, r, strict=True))], "rid long, x double, signal double, copy double, noise double, r double")
    g = score.gram(score.shuffled_folds(df, "rid", 5), ["x", "signal", "copy", "noise", "r"], "_fold")
    entered, first = score.greedy_entry(g, ["x"], ["noise", "signal", "copy"], "r", score.entry_threshold(900))
    assert entered[0] in ("signal", "copy") and len(entered) == 1
    assert abs(first["noise"]) < 0.06 and abs(first["signal"]) > 0.3


def test_residual_scores_equal_direct_regression(spark):
    rng = np.random.default_rng(6)
    x, c, r = rng.normal(size=(3, 400))
    c = c + x
    df = spark.createDataFrame([(i, i % 4, *map(float, v)) for i, v in enumerate(zip(x, c, r, strict=True))], "rid long, fold int, x double, c double, r double")
    e = np.zeros(400)
    for k in range(4):
        tr, te = np.arange(400) % 4 != k, np.arange(400) % 4 == k
        z = (x[tr] - x[tr].mean()) / x[tr].std()
        b = z @ (c[tr] - c[tr].mean()) / (z @ z + 1)
        e[te] = c[te] - c[tr].mean() - b * (x[te] - x[tr].mean()) / x[tr].std()
    s = score.scores_of(score.gram(df, ["x", "c", "r"], "fold"), ["x"], ["c"], "r")["c"]
    assert s == pytest.approx(np.corrcoef(e, r)[0, 1], abs=1e-12)
    cols = score.residualise(df, ["x"], "c", "fold", "e").orderBy("rid").collect()
    assert np.allclose([q["e"] for q in cols], e)


def test_bootstrap_and_gate(spark):
    rows = [(i, i % 2, i / 100, i / 100 + 0.01 * (i % 2), 1 - i / 100 - 0.5 * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, y int, p double, q double, bad double")
    same = gate.bootstrap_gain(df, "y", "p", "p", "rid", repeats=40)
    assert same.first()["gain"] == 0 and same.first()["se"] == 0 and gate.harmless(same)
    assert not gate.harmless(gate.bootstrap_gain(df, "y", "q", "bad", "rid", repeats=40))
    assert not gate.harmless(gate.bootstrap_gain(df.where("y = 1"), "y", "p", "q", "rid", repeats=5))
    budget = gate.BlockBudget()
    assert [budget.use() for _ in range(3)] == [["1a", "1b"], ["2"], ["3"]]
    with pytest.raises(RuntimeError):
        budget.use()


def plain_ap(y, p, w, classwise=False):
    """Average precision of weighted rows: sum of recall gained times precision over distinct scores."""
    y, p, w = np.array(y), np.array(p), np.array(w, float)
    if classwise:
        w = np.where(y == 1, w * (y == 1).sum() / w[y == 1].sum(), w * (y == 0).sum() / w[y == 0].sum())
    total, out = w[y == 1].sum(), 0.0
    for v in np.unique(p):
        hit, above = w[(p == v) & (y == 1)].sum(), p >= v
        out += hit / total * w[above & (y == 1)].sum() / w[above].sum() if hit else 0.0
    return out


@pytest.mark.parametrize("classwise", [False, True])
def test_bootstrap_against_plain_replicates(spark, classwise):
    rng = np.random.default_rng(9)
    n, repeats = 3000, 40
    y, old, new = (rng.random(n) < 0.1).astype(int), rng.integers(0, 60, n) / 60, rng.random(n)
    new = np.where(rng.random(n) < 0.4, 0.5, np.where(y == 1, new + 0.1, new))  # one score has many rows
    df = spark.createDataFrame([(i, i % 2, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, old, new, strict=True))], "rid long, region int, y int, old double, new double")
    marks = np.array([r[0] for r in df.select("rid", F.xxhash64("rid", F.lit(3)).alias("m")).orderBy("rid").select("m").collect()]).view(np.uint64)
    w = gate.replicate_weights(marks, repeats, gate._poisson_table())
    assert abs(w[:, 1:].mean() - 1) < 0.02 and abs(w[:, 1:].var() - 1) < 0.05
    for region, mine in ((0, np.arange(n) % 2 == 0), (1, np.arange(n) % 2 == 1)):
        gains = [plain_ap(y[mine], new[mine], w[mine, k], classwise) - plain_ap(y[mine], old[mine], w[mine, k], classwise) for k in range(repeats + 1)]
        got = gate.bootstrap_gain(df, "y", "old", "new", "rid", ["region"], repeats, 3, classwise).where(F.col("region") == region).first()
        want = [gains[0], np.std(gains[1:], ddof=1), *np.quantile(gains[1:], [0.025, 0.975]), repeats]
        assert [got[c] for c in ("gain", "se", "lower", "upper", "repeats")] == pytest.approx(want, abs=1e-9)
    none = gate.bootstrap_gain(df.limit(0), "y", "old", "new", "rid", repeats=5).first()
    assert none["gain"] is None and none["repeats"] == 0


def test_stratified_gate(spark):
    rng = np.random.default_rng(10)
    rows = [(i, int(i % 5 == 0), float(rng.random()), float(rng.random() + 0.4 * (i % 5 == 0))) for i in range(2000)]
    df = spark.createDataFrame(rows, "rid long, y int, old double, new double")
    better = gate.stratified_gate(df, "y", "old", "new", "rid", repeats=60).collect()
    assert len(better) == 3 and all(r["passed"] and r["lower"] > 0 for r in better) and len({r["se"] for r in better}) == 3
    assert not gate.stratified_gate(df, "y", "new", "old", "rid", repeats=60).first()["passed"]


def test_ranks_of_tickets_in_ranges(spark):
    from quarry.operators import split

    df = spark.createDataFrame([(i, None if i % 50 == 0 else int(i % 20 == 0)) for i in range(1500)], "rid long, y int")
    got = split.ticket_rank(df, ["y"], 7, "rid", "k", "n")
    assert got.columns == ["rid", "y", "k", "n"]
    import hashlib

    for label in (None, 0, 1):
        own = sorted((hashlib.md5(f"7|{i}".encode()).hexdigest(), i) for i in range(1500) if (None if i % 50 == 0 else int(i % 20 == 0)) == label)
        rows = {r["rid"]: (r["k"], r["n"]) for r in got.where(F.col("y").eqNullSafe(F.lit(label))).collect()}
        assert rows == {i: (k, len(own)) for k, (_, i) in enumerate(own, 1)}


def test_vault_opens_once(spark):
    df = spark.createDataFrame([(i, i % 2, i / 10) for i in range(10)], "rid long, y int, p double")
    vault = gate.TestVault(df, "rid", "y")
    with pytest.raises(ValueError):
        vault.evaluate({"m": df.where("rid < 9")})
    got = vault.evaluate({"m": df})["m"]
    assert got["ap"] > 0 and 0 <= got["auc"] <= 1
    with pytest.raises(RuntimeError):
        vault.evaluate({"m": df})


def test_average_precision_of_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.average_precision(df, "y", "p").first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert metrics.average_precision(df.where("y = 0"), "y", "p").first()["ap"] is None
    assert metrics.roc_auc(df.where("y = 1"), "y", "p").first()["auc"] is None


def test_permute_keeps_values(spark):
    df = spark.createDataFrame([(i, i * 10, i % 3) for i in range(90)], "rid long, v long, g int")
    whole = admit.permute(df, "v", "rid", 1).collect()
    assert sorted(r["v_shuffled"] for r in whole) == sorted(r["v"] for r in whole) and any(r["v"] != r["v_shuffled"] for r in whole)
    inside = admit.permute(df, "v", "rid", 1, within="g").collect()
    assert all(r["v_shuffled"] // 10 % 3 == r["g"] for r in inside) and len(inside) == 90


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(8000).select(F.col("id").alias("rid"), F.col("id").cast("double").alias("t"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert {r["_part"]: r["count"] for r in split.chronological(df, "t", "rid").groupBy("_part").count().collect()} == {"I": 5120, "V": 1280, "T": 1600}
    strat = {(r["_part"], r["y"]): r["count"] for r in split.stratified(df, "y", "rid").groupBy("_part", "y").count().collect()}
    assert strat["T", 1] == 160 and strat["V", 1] == 128 and strat["I", 1] == 512
    sizes = [split.weighted_blocks(F.col("id"), 4800)]
    got = spark.range(4800).select(sizes[0].alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in got] == [2880, 960, 960]


def test_classify_and_validate(spark):
    df = spark.range(600).select((F.col("id") % 20 == 0).cast("int").alias("target"), (F.col("id") % 40).alias("code"), F.exp(F.col("id") / 60).alias("skewed"), (F.col("id") % 2).alias("flag"), F.lit("x").alias("DropMe"), F.concat(F.lit("n"), F.col("id") % 5).alias("name"))
    plan = classify(df, DatasetSpec("target", drop=("dropme",)))
    assert plan.categorical == ("code", "name") and plan.binary == ("flag",) and plan.logged == ("skewed",) and "DropMe" not in plan.base
    require_valid(df, DatasetSpec("target"))
    with pytest.raises(ValueError):
        require_valid(df.limit(100), DatasetSpec("target"))
    with pytest.raises(ValueError):
        require_valid(df, DatasetSpec("target", "when"))
    assert content_hash(df) == content_hash(df.repartition(7)) != content_hash(df.limit(599))


def test_slices_and_blend(spark):
    df = spark.createDataFrame([(1.0, 0.2, 0.8), (None, 0.2, 0.8), (5.0, 0.2, None)], "x double, p double, q double")
    rule = experts.SliceRule("x", None, 3.0)
    got = df.select(rule.mask().alias("m"), experts.blend(F.col("p"), F.col("q"), 0.5, rule.mask()).alias("b"), experts.blend(F.col("p"), F.col("q"), 0.5).alias("all")).collect()
    assert [tuple(r) for r in got] == [(True, 0.5, 0.5), (False, 0.2, 0.5), (False, 0.2, 0.2)]


def test_step_up_in_ranges(spark):
    rng = random.Random(31)
    rows = [(k, rng.choice([rng.random(), rng.random() ** 4, 0.25, 0.001 * rng.randrange(9)])) for k in range(3000)] + [(9000, None)]
    out = score.step_up(spark.createDataFrame(rows, "k long, p double"), "p", "k", 0.3)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()  # no task sorts all rows
    order, low, want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1.0, {}
    for at in range(len(order) - 1, -1, -1):
        k, p = order[at]
        low = low if p is None else min(low, p * len(order) / (at + 1))
        want[k] = (at + 1, pytest.approx(low), low <= 0.3)
    assert {r["k"]: (r["rank"], r["adjusted"], r["selected"]) for r in out.collect()} == want
    assert score.step_up(spark.createDataFrame([], "k long, p double"), "p", "k").count() == 0
