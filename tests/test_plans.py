import json

import pytest
from pyspark.sql import functions as F

from quarry.operators.history import HistorySpec
from quarry.plans import propose, templates
from quarry.plans.config import make_config, merge
from quarry.plans.templates import Template
from quarry.sources import io

RAW = ["income", "debt", "x1", "x2"]


def test_expansion_under_the_contract():
    ratio = Template("r", "pointwise", "{A}/(np.abs({B})+1.0)", {"A": ("*",), "B": ("*",)})
    past = Template("h", "aggregate", entities=("customer",), values=("income", "debt"), aggregations=("mean", "std"), windows=(0,))
    first = templates.contract(1, RAW, {})
    assert len(templates.expand(ratio, first, RAW, ["customer"]).candidates) == 12
    assert len(templates.expand(past, first, RAW, ["customer"]).candidates) == 4
    assert all(isinstance(s, HistorySpec) for s in templates.expand(past, first, RAW, ["customer"]).candidates.values())
    second = templates.contract(2, RAW, {1: ["a", "b"]})
    assert len(templates.expand(ratio, second, RAW, []).candidates) == 2 and not templates.expand(past, second, RAW, ["customer"]).candidates
    third = templates.contract(3, ["u", "v"], {1: ["a"], 2: ["z"]})
    assert len(templates.expand(ratio, third, ["u", "v"], []).candidates) == 6
    assert not templates.expand(Template("h", "aggregate", entities=("customer",), aggregations=("count",), shift=0), first, RAW, ["customer"]).candidates
    assert templates.expand(Template("r", "pointwise", "{A}", {"A": ("nope",)}), first, RAW, []).dropped == ["nope"]


def test_interleaving_and_names():
    a, b = templates.Expansion("a", {"a1": "x", "a2": "x", "a3": "x"}), templates.Expansion("b", {"b1": "x"})
    assert list(templates.interleave([a, b], 3)) == ["a1", "b1", "a2"]
    assert len(templates.safe_name(["x" * 200])) == 80
    assert templates.scorecard({"a1": "a", "b1": "b"}, ["a1", "b1"], ["a1"], []) == [{"template": "a", "candidates": 1, "entered": 1, "admitted": 0}, {"template": "b", "candidates": 1, "entered": 0, "admitted": 0}]


def test_generators_compile():
    from quarry.functions.expr import compile_expression

    pool = {**templates.sweep(RAW), **templates.idiom_grid(RAW)}
    for text in [*pool.values(), *templates.random_expressions(RAW, 30, 2), *[e for e, _, _ in templates.depth_grid(RAW, {1: ["x1"]}, 2).values()]]:
        compile_expression(text, RAW)
    assert templates.fuse_rulers([["a", "b"], ["b", "c"]], 2) == ["a", "b", "c"]


def test_config():
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert make_config({"label": "y"}, seed=3)["seed"] == 3
    with pytest.raises(ValueError):
        make_config(sede=3)


def test_audit_reasons(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("y"), F.lit("I").alias("_part"))
    valid, reasons = propose.audit(df, [{"name": n, "expression": e} for n, e in (("a", "df['x'] + 1"), ("b", "df['y']"), ("c", "df['x'] * 0"), ("d", "1 / df['x']"), ("e", "df['a'] * 2"), ("2", "df['x']"), ("f", "df['x'] * 3"))], "y", cap=2)
    assert list(valid) == ["a", "e"]
    assert [r["reason"] for r in reasons][2:4] == ["constant", "not finite everywhere"] and reasons[6]["reason"] == "over budget"


def test_proposer_modes(tmp_path):
    answer = json.dumps({"features": [{"name": "f", "expression": "df['x']"}]})
    (tmp_path / "said").write_text(f"Here:\n```json\n{answer}\n```")
    live = propose.Proposer("command", cache=str(tmp_path / "cache"), command=f"cat {tmp_path / 'said'}")
    card = {"columns": {"x": {}}}
    got = propose.propose(live, card, families=("ratios",))
    assert got == [{"name": "f", "expression": "df['x']", "family": "ratios"}]
    assert propose.propose(propose.Proposer("replay", cache=str(tmp_path / "cache")), card, families=("ratios",)) == got
    with pytest.raises(LookupError):
        propose.propose(propose.Proposer("replay", cache=str(tmp_path / "cache")), card, families=("other",))
    with pytest.raises(ValueError):
        propose.Proposer("api")
    with pytest.raises(ValueError):
        propose.parse_answer("nothing")


def test_frozen_features_and_cache(tmp_path):
    propose.save_frozen([{"name": "a", "expression": "df['x']"}], str(tmp_path / "f.json"), "d")
    assert propose.load_frozen(str(tmp_path / "f.json"), "d")[0]["name"] == "a"
    (tmp_path / "f.json").write_text((tmp_path / "f.json").read_text().replace('"a"', '"b"'))
    with pytest.raises(ValueError):
        propose.load_frozen(str(tmp_path / "f.json"))


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "'a'"), (2, "'b'")], "id int, name string")
    for kind in ("parquet", "csv", "json"):
        io.write_table(df, str(tmp_path / f"t.{kind}"), kind)
        assert io.read_any(spark, [str(tmp_path / f"t.{kind}")] * 2).count() == 4
    assert [r["name"] for r in io.strip_quotes(df).orderBy("id").collect()] == ["a", "b"]
    assert io.normalise_names(df.toDF("A b", "C-d ")).columns == ["a_b", "c_d"]
    with pytest.raises(ValueError):
        io.normalise_names(df.toDF("a b", "a-b"))
    io.append_log({"a": float("nan")}, str(tmp_path / "log"))
    assert json.loads((tmp_path / "log").read_text()) == {"a": None}
    with pytest.raises(ValueError):
        io.load(spark, "nope")
    io.register_loader("two", lambda s: s.range(2))
    assert io.load(spark, "two").count() == 2


def test_run_on_the_demo(spark):
    from quarry.plans.pipeline import run

    cfg = make_config(time_col="event_time", entity_cols=["customer"], max_rounds=1, cycles=1, oof_folds=2, max_initial_candidates=4)
    result = run(io.demo(spark, 3000), cfg)
    assert set(result.scores) == {"baseline", "core", "experts"} and result.scores["baseline"]["auc"] > 0.6
    assert result.scores["core"]["ap"] >= result.scores["baseline"]["ap"] - 0.05


def test_label_flip_leaves_the_surface(spark):
    from quarry.plans.pipeline import Run

    df = io.demo(spark, 2000)
    cfg = make_config(time_col="event_time", entity_cols=["customer"])
    seen = []
    for flip in (False, True):
        r = Run(df.withColumn("_rid", F.col("event_time").cast("long")), cfg)
        r.partition()
        if flip:
            r.rows = r.rows.withColumn("target", F.when(F.col("_part") == "V", 1 - F.col("target")).otherwise(F.col("target")))
        r.encode()
        seen.append(sorted(tuple(x) for x in r.surface.where("_part <> 'I'").select("_rid", *r.base).collect()))
    assert seen[0] == seen[1]


def test_shadow_admission_reads_no_label_of_v(spark):
    from quarry.plans.pipeline import Run, State

    df = io.demo(spark, 1500).withColumn("_rid", F.col("event_time").cast("long"))
    cfg = make_config(time_col="event_time", entity_cols=["customer"], oof_folds=2)
    seen = []
    for flip in (False, True):
        r = Run(df, cfg)
        r.partition()
        if flip:
            r.rows = r.rows.withColumn("target", F.when(F.col("_part") == "V", 1 - F.col("target")).otherwise(F.col("target")))
        r.encode()
        offered = {"strong": f"df['{r.raw[0]}'] * 1.0 + df['{r.raw[1]}']", "weak": f"df['{r.raw[0]}'] * 0 + df['event_time'] % 7"} if "event_time" in r.surface.columns else {"strong": f"df['{r.raw[0]}'] * 1.0"}
        seen.append(sorted(r.shadow(offered, State("baseline", {}, None, None))))
        assert {x["stage"] for x in r.report["stages"]} >= {"shadow"}
    assert seen[0] == seen[1]


def test_steady_window_is_the_longest_without_a_shift(spark):
    from quarry.operators import experts

    rows = [(i, float(i % 97) + (500.0 if i < 2000 else 0.0), float(i % 89), int(i % 10 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "_pos long, moved double, calm double, y int")
    assert experts.steady_window(df, ["moved", "calm"], "y", "_pos", 4000) == {"moved": 1, "calm": 0}


def test_forms_without_braces_and_dictionaries_in_forms():
    rule = templates.contract(1, RAW, {})
    bare = templates.expand(Template("b", "pointwise", "A - B * 2", {"A": (RAW[0],), "B": (RAW[1],)}), rule, RAW, [])
    assert list(bare.candidates.values()) == [f"df['{RAW[0]}'] - df['{RAW[1]}'] * 2"]
    kept = templates.expand(Template("k", "pointwise", "{A}.replace({3: 30})", {"A": (RAW[0],)}), rule, RAW, [])
    assert list(kept.candidates.values()) == [f"df['{RAW[0]}'].replace({{3: 30}})"]
