"""The whole run: load, split, encode, screen, propose, admit, gate, choose, evaluate once.

The loop and its decisions are on the driver; rows stay in DataFrames. The surface, each state's predictions and the
latest sets of features are written, so plans stay short and no history is computed twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import with_expressions
from quarry.operators import admit, drift, encode, experts, gate, history, models, score, split
from quarry.plans import propose, templates
from quarry.plans.schema import RID, ColumnPlan, DatasetSpec, Tables, classify, cut_lineage, detect_entities, epoch_seconds, is_number, require_valid, together
from quarry.plans.search import Blacklist
from quarry.sources.io import canonical_hash, json_safe, write_report


#: Written frames of features that a run keeps at most.
FRAMES = 3


@dataclass
class State:
    """A feature set with its out-of-fold predictions on I and predictions on V (rid, p)."""

    name: str
    features: dict
    oof: DataFrame
    valid: DataFrame


@dataclass
class Result:
    scores: dict
    features: dict
    report: dict
    predictions: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, folder: str) -> None:
        from pathlib import Path

        Path(folder).mkdir(parents=True, exist_ok=True)
        write_report({"scores": self.scores, "features": {k: str(v) for k, v in self.features.items()}, "report": self.report}, f"{folder}/report.json")

    def save_predictions(self, path: str) -> None:
        for name, df in self.predictions.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")


class Run:
    """One dataset under one configuration; each stage can be called alone.

    The session stops inferring filters from constraints: over dozens of expressions of the same columns, the optimizer would list every
    way to rewrite each constraint, which grows exponentially and gains nothing here.
    """

    def __init__(self, df: DataFrame, cfg: dict):
        df.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
        self.tables = Tables(df.sparkSession)
        self.cfg, self.report = cfg, {"stages": [], "scorecard": []}
        self.frames: list[tuple[dict, DataFrame]] = []  # features and their written rows, the latest last
        self.blacklist, self.unsteady = Blacklist(), {}  # features rejected for good; first proposals that the drift screen left out
        self.spec = DatasetSpec(cfg["label"], cfg["time_col"], tuple(cfg["entity_cols"]), tuple(cfg["drop"]))
        keep = [c for c in df.columns if c == cfg["label"] or not self.spec.dropped(c)]
        df = require_valid(df.select(*keep), self.spec)
        if RID not in df.columns:
            order = F.xxhash64(*[F.col(c) for c in df.columns])
            df = df.withColumn(RID, order)
            twins = df.groupBy(RID).count().where("count > 1").limit(1).count()
            if twins:
                raise ValueError(f"rows repeat; give them an id column named {RID}")
        self.time = "_t" if self.spec.time_col else RID
        self.df = df.withColumn("_t", epoch_seconds(df, self.spec.time_col)) if self.spec.time_col else df

    def together(self, calls: list) -> list:
        return together(self.df.sparkSession, calls)

    def note(self, stage: str, **what) -> None:
        self.report["stages"].append({"stage": stage, **json_safe(what)})

    def partition(self) -> None:
        c, y = self.cfg, self.spec.label
        parted = split.chronological(self.df, "_t", RID) if self.spec.time_col else split.stratified(self.df, y, RID, c["split_seed"])
        if "_pos" not in parted.columns:
            from quarry.plans.schema import with_position

            parted = with_position(parted, [RID])
        self.rows = self.tables.write(parted)
        sizes = {r["_part"]: (r["n"], r["p"]) for r in self.rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).collect()}
        self.n_fit, self.n_valid, self.positives = sizes["I"][0], sizes["V"][0], sizes["I"][1]
        self.vault = gate.TestVault(self.rows.where("_part = 'T'"), RID, y)
        self.note("partition", sizes=sizes)

    def encode(self) -> None:
        """The base representation, fitted on I. Part T goes on without its label."""
        c, y = self.cfg, self.spec.label
        fit = self.rows.where("_part = 'I'")
        hidden = {"_pos", "_part", "_t", self.spec.time_col}
        self.plan: ColumnPlan = classify(fit.drop(*[h for h in hidden if h]), self.spec, c["category_min_unique"], c["category_max_unique"], c["log_skew"])
        df = self.rows.withColumn(y, F.when(F.col("_part") != "T", F.col(y)))
        df = df.withColumns({f"{k}_log": encode.log_form(F.col(k).cast("double")) for k in self.plan.logged} | {k: F.col(k).cast("int") for k in self.plan.binary}) if self.plan.logged or self.plan.binary else df
        folds = self.tables.write(split.stratified_folds(fit.select(RID, y, *self.plan.categorical), y, RID, c["encoding_folds"], c["seed"], "_efold")) if self.plan.categorical else None
        tables = self.together([lambda k=k: self.tables.write(self.said_of(fit, k)) for k in self.plan.categorical])
        mean = fit.agg(F.avg(y)).first()[0]
        for k, table in zip(self.plan.categorical, tables, strict=True):
            inside = encode.out_of_fold(folds.select(RID, k, y, "_efold"), k, y, "_efold", c["te_alpha"]).select(RID, F.col("te_oof").alias("_a"), F.col("freq_oof").alias("_b"))
            df = encode.lookup(df, table, k, "said", None, "_said")
            df = df.withColumns({f"{k}_code": F.coalesce("_said.code", F.lit(-1)), "_te": F.coalesce("_said.te", F.lit(mean)), "_fr": F.coalesce("_said.freq", F.lit(0.0))}).drop("_said")
            df = df.join(inside, RID, "left").withColumns({f"{k}_te": F.coalesce("_a", "_te"), f"{k}_freq": F.coalesce("_b", "_fr")}).drop("_a", "_b", "_te", "_fr")
        self.base = [*self.plan.base, *[f"{k}_{s}" for k in self.plan.categorical for s in ("te", "freq")]]
        self.surface = self.tables.write(df)
        self.raw = [*self.plan.numeric, *self.plan.binary]
        names = [k for k in self.plan.categorical if not is_number(self.df, k)]
        self.entities = list(self.spec.entity_cols) or (detect_entities(fit, names) if names else [])
        self.note("encode", base=self.base, entities=self.entities)

    def said_of(self, fit: DataFrame, k: str) -> DataFrame:
        """(k, said): of each value of a category its code, smoothed mean label and frequency, so that one lookup serves all three."""
        out = encode.target_map(fit, k, self.spec.label, self.cfg["te_alpha"]).select(k, "te")
        out = encode.lookup(out, encode.frequency_map(fit, k), k, "freq", None, "freq")
        out = encode.lookup(out, encode.sorted_codes(fit, k), k, "code", None, "code")
        return out.select(k, F.struct("code", "te", "freq").alias("said"))

    def with_features(self, features: dict) -> DataFrame:
        specs = {n: s for n, s in features.items() if isinstance(s, history.HistorySpec)}
        texts = {n: s for n, s in features.items() if isinstance(s, str)}
        df = self.surface
        if specs:
            df = history.with_history(df, specs.values(), self.time, RID, {self.spec.label}, {s: n for n, s in specs.items()})
        return with_expressions(df, texts, label=self.spec.label) if texts else df

    def frame(self, features: dict) -> DataFrame:
        """Rows that have these features, perhaps others too, as with_features() makes them, but written, so that what asks for the same
        features or fewer of them reads them back. The latest frames are kept."""
        if not features:
            return self.surface
        for held, df in reversed(self.frames):
            if all(held.get(n) == s for n, s in features.items()):
                return df
        df = self.tables.write(self.with_features(features))
        self.frames = [*self.frames, (dict(features), df)][-FRAMES:]
        return df

    def fit_state(self, name: str, features: dict) -> State:
        df = self.frame(features)
        columns = [*self.base, *features]
        oof, valid = models.out_of_fold(df.where("_part = 'I'"), columns, self.spec.label, RID, self.cfg["learner"], self.cfg["oof_folds"], self.cfg["seed"], df.where("_part = 'V'"), self.tables.write, **self.cfg["learner_settings"])
        return State(name, dict(features), *self.together([lambda df=df: self.tables.write(df) for df in (oof, valid)]))

    def drifted(self) -> list:
        """A row a column."""
        c = self.cfg
        df = self.surface.where("_part in ('I', 'V')").withColumn("_late", F.col("_part") == "V")
        table = drift.drift_table(df, list(self.plan.numeric), [k for k in self.plan.categorical if k not in self.plan.numeric], "_late", c["route_unseen_rate"], psi_max=c["psi_max"], band=c["auc_band"], keep=self.tables.write)
        return table.collect() if table is not None else []

    def library(self) -> dict:
        lib = history.history_library(self.entities, list(self.plan.numeric), bool(self.spec.time_col)) if self.entities else []
        return {s.name: s for s in lib}

    def route(self, rows: list | None = None) -> dict:
        c, lib = self.cfg, self.library()
        rows = self.drifted() if rows is None else rows
        share = sum(r["shifted"] for r in rows) / max(len(rows), 1)
        ratio = 0.0
        if lib:
            ratio = max((abs(s) for s in self.scores(lib, self.states[0]).values()), default=0.0) / score.entry_threshold(self.positives, c["entry_alpha"])
        out = {"round0": share <= c["route_shift_share"], "rounds": not (share == 0 and not self.spec.time_col and ratio < 1), "drifted_share": share, "library_ratio": ratio}
        self.note("route", **out)
        return out

    def scores(self, candidates: dict, state: State) -> dict[str, float]:
        g, names = self.gram(candidates, state)
        return score.scores_of(g, [*self.base, *state.features], names, "_r", self.cfg["ridge_alpha"])

    def gram(self, candidates: dict, state: State):
        c = self.cfg
        df = self.frame({**state.features, **candidates}).where("_part = 'I'")
        columns = list(dict.fromkeys([*self.base, *state.features, *candidates]))
        if "residual" in c["skip"]:
            df = score.residual(df, self.spec.label, None, "_r")
        if self.n_fit > c["discovery_rows"]:
            df = split.sample_rows(df, RID, c["discovery_rows"], c["seed"])
        if "residual" not in c["skip"]:
            df = score.residual(df.join(state.oof.withColumnRenamed("p", "_p"), RID), self.spec.label, "_p", "_r")
        df = self.tables.write(df.select(RID, "_r", *columns))
        rows = score.shuffled_folds(drift.impute_median(df, columns), RID, c["residual_folds"], c["seed"])
        return score.gram(rows, [*columns, "_r"], "_fold"), list(candidates)

    def stable(self, candidates: dict, state: State) -> dict:
        if "screen" in self.cfg["skip"] or not candidates:
            return candidates
        df = self.frame({**state.features, **candidates}).where("_part in ('I', 'V')").withColumn("_late", F.col("_part") == "V")
        good = {r["column"] for r in drift.stability(df, list(candidates), "_late", self.cfg["psi_max"], self.cfg["auc_band"], keep=self.tables.write).where("stable").collect()}
        return {n: s for n, s in candidates.items() if n in good}

    def enter(self, candidates: dict, state: State, cycle: int = 1) -> dict:
        """Greedy entry with the trailing check; what enters is added to the state's features."""
        c = self.cfg
        if not candidates:
            return {}
        df = self.frame({**state.features, **candidates}).where("_part = 'I'")
        names = drift.deduplicate(self.tables.write(drift.impute_median(df.select(RID, *candidates), list(candidates))), list(candidates), RID, c["dedup"])
        pool = {n: candidates[n] for n in names}
        g, listed = self.gram(pool, state)
        tau = score.entry_threshold(self.positives, c["entry_alpha"])
        entered, first = score.greedy_entry(g, [*self.base, *state.features], listed, "_r", tau, c["entry_cap"], c["ridge_alpha"])
        if entered and "trailing" not in c["skip"]:
            rows = df.join(state.oof.withColumnRenamed("p", "_p"), RID)
            rows = score.residual(rows, self.spec.label, "_p", "_r")
            holds = score.trailing_check(rows, [*self.base, *state.features], entered, "_r", RID, "_pos", first, cycle, tau, c["trailing_fraction"], folds=c["residual_folds"])
            entered = [n for n in entered if holds[n]]
        self.note("enter", cycle=cycle, candidates=len(candidates), entered=entered)
        return {n: pool[n] for n in entered}

    def importance(self, features: dict, probes: list[str], copies: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
        """(by..., feature, importance) of the probes, and of a shadow of each of ``copies``, measured on rows of I that the model did not see;
        the model is fitted with all of them. V isn't looked at."""
        c, y = self.cfg, self.spec.label
        rows = self.frame(features).where("_part = 'I'")
        order = F.col("_pos") if self.spec.time_col else F.pmod(F.xxhash64(RID), F.lit(self.n_fit))
        rows = rows.select(RID, y, split.block_of(order, self.n_fit, 2).alias("_half"), *dict.fromkeys([*self.base, *features]))
        rows, shadows = admit.with_shadows(rows, copies, RID, c["seed"]) if copies else (rows, [])
        rows = self.tables.write(split.stratified_folds(rows, y, RID, c["oof_folds"], c["seed"]))
        columns = [*self.base, *features, *shadows]
        fitted, wide = self.together([
            lambda: models.fit_folds(rows, columns, y, c["learner"], c["oof_folds"], c["seed"], **c["learner_settings"]),
            lambda: admit.with_permuted(rows, [*probes, *shadows], RID, c["seed"], None, self.tables.write),
        ])

        def unseen(stacked: DataFrame) -> DataFrame:
            parts = [m.predict(stacked.where(F.col("_fold") == k)) for k, m in enumerate(fitted)]
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more)
            return out

        return cut_lineage(admit.permutation_importance(rows, y, [*probes, *shadows], RID, unseen, c["seed"], by, wide=wide))

    def shadow(self, candidates: dict, state: State) -> dict:
        """Candidates whose permutation importance beats, on both halves of I, that of every candidate's shadow: a copy with its
        values dealt to other rows."""
        if "shadow" in self.cfg["skip"] or not candidates:
            return candidates
        pi = self.importance({**state.features, **candidates}, list(candidates), list(candidates), ["_half"])
        kept = {r["feature"] for r in admit.shadow_admit(pi, [f"{n}__shadow" for n in candidates], "_half").collect()}
        self.note("shadow", candidates=len(candidates), kept=sorted(kept))
        return {n: s for n, s in candidates.items() if n in kept}

    def leave(self, features: dict) -> list[str]:
        """Features of earlier rounds that are of no use any more: of no or negative importance on I, the worst first. They are
        not taken in again."""
        c = self.cfg
        if "exit" in c["skip"] or not features:
            return []
        needed = {x for s in features.values() if isinstance(s, str) for x in features if f"df['{x}']" in s}
        pi = self.importance(features, [n for n in features if n not in needed]) if set(features) - needed else None
        gone = [r["feature"] for r in admit.exits(pi, c["exit_max_drops"]).collect()] if pi is not None else []
        self.blacklist.add(c["learner"], gone)
        self.note("exit", removed=gone)
        return gone

    def passes(self, old: State, new: State, blocks: list[str]) -> bool:
        if "gate" in self.cfg["skip"]:
            return True
        v = self.rows.where("_part = 'V'").select(RID, F.col(self.spec.label).alias("y"), (F.col("_pos") - self.n_fit if self.spec.time_col else F.pmod(F.xxhash64(RID), F.lit(self.n_valid))).alias("_vpos"))
        block = split.weighted_blocks(F.col("_vpos"), self.n_valid, tuple(self.cfg["block_weights"]))
        half = F.when(split.block_of(F.col("_vpos"), self.n_valid * self.cfg["block_weights"][0] // sum(self.cfg["block_weights"]) or 1, 2) < 1, "a").otherwise("b")
        region = F.when(block == 1, F.concat(F.lit("1"), half)).otherwise(block.cast("string"))
        rows = v.withColumn("region", region).where(F.col("region").isin(blocks)).join(old.valid.withColumnRenamed("p", "old"), RID).join(new.valid.withColumnRenamed("p", "new"), RID)
        gains = gate.bootstrap_gain(rows, "y", "old", "new", RID, ["region"], self.cfg["bootstrap_repeats"], self.cfg["seed"])
        self.note("gate", state=new.name, gains=[r.asDict() for r in gains.collect()])
        return gate.harmless(gains, self.cfg["harm_k"])

    def proposals(self) -> list[dict]:
        c = self.cfg
        if c["proposals"]:
            return list(c["proposals"])
        if c["proposer"] is not None and not isinstance(c["proposer"], str):
            return propose.propose(c["proposer"], propose.column_card(self.surface.where("_part = 'I'"), self.raw))
        return [{"name": n, "expression": e, "family": "sweep"} for n, e in templates.sweep(self.raw[:4], c["max_initial_candidates"]).items()]

    def default_templates(self) -> list[templates.Template]:
        out = [templates.Template("ratio", "pointwise", "{A} / (np.abs({B}) + 1.0)", {"A": ("*",), "B": ("*",)})]
        if self.entities:
            out.append(templates.Template("past", "aggregate", entities=tuple(self.entities[:2]), values=tuple(self.plan.numeric[:2]), aggregations=("mean", "deviation", "count"), windows=(0, 5)))
        return out

    def search(self) -> None:
        c = self.cfg
        first, drifted, _ = self.together([lambda: self.fit_state("baseline", {}), self.drifted, lambda: self.frame(self.library())])
        self.states = [first]
        routes, budget, empty = self.route(drifted), gate.BlockBudget(), 0
        if routes["round0"]:
            valid, reasons = propose.audit(self.surface, self.proposals(), self.spec.label, cap=c["max_initial_candidates"])
            steady = self.stable(valid, self.states[-1])
            self.unsteady = {n: f for n, f in valid.items() if n not in steady}
            good = self.shadow(steady, self.states[-1])
            self.note("round0", proposed=len(reasons), valid=len(valid), kept=list(good))
            if good:
                new = self.fit_state("round0", good)
                if self.passes(self.states[-1], new, budget.use()):
                    self.states.append(new)
        for k in range(1, c["max_rounds"] + 1):
            if not routes["rounds"] or not budget.left or empty >= c["max_empty_rounds"]:
                break
            base, admitted, pool = self.states[-1], {}, {}
            if gone := self.leave(base.features):
                base = self.fit_state(base.name, {n: f for n, f in base.features.items() if n not in gone})
            for cycle in range(1, (1 if "recursion" in c["skip"] else c["cycles"]) + 1):
                rule = templates.contract(cycle, self.raw, admitted)
                grown_by = [templates.expand(t, rule, self.raw, self.entities, bool(self.spec.time_col), frozenset({self.spec.label})) for t in c["templates"] or self.default_templates()]
                template_of = {n: e.template for e in grown_by for n in e.candidates}
                grown = templates.interleave(grown_by, c["candidate_caps"][cycle - 1])
                grown = {n: grown[n] for n in self.blacklist.allowed(c["learner"], grown) if n not in pool and n not in base.features}
                state = State(base.name, {**base.features, **pool}, base.oof, base.valid)
                entered = self.enter(self.stable(grown, state), state, cycle)
                admitted[cycle] = list(entered)
                self.report["scorecard"] += [{"round": k, "cycle": cycle, **row} for row in templates.scorecard(template_of, list(grown), list(entered), list(entered))]
                pool |= entered
                if not entered:
                    break
            if not pool:
                empty += 1
                continue
            empty = 0
            new = self.fit_state(f"round{k}", {**base.features, **pool})
            if self.passes(base, new, budget.use()):
                self.states.append(new)

    def choose(self) -> State:
        y = self.rows.where("_part = 'V'").select(RID, F.col(self.spec.label).alias("y"))
        for i, s in enumerate(self.states):
            y = y.join(s.valid.withColumnRenamed("p", f"p{i}"), RID)
        best = gate.choose_core(y, "y", [f"p{i}" for i in range(len(self.states))]).where("chosen").first()["candidate"]
        core = self.states[int(best[1:])]
        self.note("core", state=core.name)
        return core

    def finish(self) -> Result:
        core, y = self.choose(), self.spec.label

        def tested(state: State) -> DataFrame:
            df = self.frame(state.features)
            model = models.fit(df.where("_part in ('I', 'V')"), [*self.base, *state.features], y, self.cfg["learner"], self.cfg["seed"], **self.cfg["learner_settings"])
            return cut_lineage(model.predict(df.where("_part = 'T'")).select(RID, "p"))

        baseline, other, offers = self.together([lambda: tested(self.states[0]), lambda: None if core is self.states[0] else tested(core), lambda: None if "experts" in self.cfg["skip"] else self.expert_offers(core)])
        out = {"baseline": baseline, "core": baseline if other is None else other}
        out |= self.experts(out["core"], core, offers)
        scores = self.vault.evaluate(out)
        self.report["sha256"] = canonical_hash({k: str(v) for k, v in core.features.items()})
        return Result(scores, core.features, self.report, out)

    def expert_offers(self, core: State) -> list[tuple]:
        """(name, slice rule or None, rows of I to fit on, columns, features): for the slices where the core errs most, and for recent windows in which
        first proposals that the drift screen left out are steady (one expert a window)."""
        c, y = self.cfg, self.spec.label
        df = self.frame(core.features)
        columns = [*self.base, *core.features]
        fit = df.where("_part = 'I'").join(core.oof.withColumnRenamed("p", "_p"), RID)
        fit = self.tables.write(score.residual(fit, y, "_p", "_r"))
        rules = experts.slice_rules(fit, columns[: c["slice_max_columns"]], RID)
        out = [(rule.name, rule, fit.where(rule.mask()), columns, core.features) for rule in experts.choose_slices(experts.slice_lift(fit, rules, y, "_r"), rules)]
        loose = {n: f for n, f in self.unsteady.items() if n not in core.features}
        if self.spec.time_col and loose:
            rows = self.frame({**core.features, **loose}).where("_part in ('I', 'V')")
            levels, n = experts.steady_window(rows, list(loose), y, "_pos", self.n_fit + self.n_valid, c["psi_max"]), self.n_fit + self.n_valid
            for k in sorted({v for v in levels.values() if v}):  # level 0 is the whole: no window
                extras = [m for m in loose if levels[m] == k]
                out.append((f"recency_w{2**k}", None, rows.where((F.col("_part") == "I") & (F.col("_pos") >= n - n // 2**k)), [*columns, *extras], {**core.features, **{m: loose[m] for m in extras}}))
        return out

    def experts(self, test: DataFrame, core: State, offers: list[tuple] | None) -> dict[str, DataFrame]:
        """The core blended with the first expert that both halves of V gain from."""
        c, y = self.cfg, self.spec.label
        if offers is None:
            return {}
        for name, rule, inside, columns, features in offers:
            rows, positives = inside.agg(F.count(F.lit(1)), F.sum(y)).first()
            if rows < c["expert_min_rows"] or (positives or 0) < c["expert_min_positives"]:
                self.note("expert", rule=name, rows=rows, positives=positives, taken=False)
                continue
            df, mask = self.frame(features), rule.mask() if rule else None
            model = models.fit(inside, columns, y, c["learner"], c["seed"], **c["learner_settings"])
            v = model.predict(df.where("_part = 'V'"), "_e").join(core.valid, RID).withColumn("_b", split.block_of(F.pmod(F.col("_pos"), F.lit(self.n_valid)), self.n_valid, 5))
            v = self.tables.write(v)
            w = experts.best_weight(experts.blend_grid(v, y, "p", "_e", "_b", mask))
            mixed = v.withColumn("_new", experts.blend(F.col("p"), F.col("_e"), w, mask)).withColumn("_half", F.col("_b") >= 3)
            gains = gate.bootstrap_gain(mixed.select(RID, y, "p", "_new", "_half"), y, "p", "_new", RID, ["_half"], c["expert_bootstrap_repeats"])
            taken = w > 0 and gate.beneficial(gains, c["expert_benefit_k"])
            self.note("expert", rule=name, weight=w, taken=taken)
            if taken:
                t = model.predict(df.where("_part = 'T'"), "_e").join(test, RID)
                return {"experts": t.select(RID, experts.blend(F.col("p"), F.col("_e"), w, mask).alias("p"))}
        return {"experts": test}


def run(df: DataFrame, cfg: dict) -> Result:
    """The whole run; the session's optimizer setting is as before when it ends. Predictions of the result are checkpoints."""
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before, r = conf.get(key), None
    try:
        r = Run(df, cfg)
        r.partition()
        r.encode()
        r.search()
        return r.finish()
    finally:
        conf.set(key, before)
        if r is not None:
            r.tables.discard()


def score_feature_list(df: DataFrame, cfg: dict, features: dict, learners: tuple[str, ...] = ("logistic", "forest", "boosted"), seeds: tuple[int, ...] = (11, 12, 13)) -> list[dict]:
    """Average precision on the test part of a frozen feature list under each learner and seed."""
    r = Run(df, cfg)
    r.partition()
    r.encode()
    rows = r.frame(features)
    predictions = {}
    for learner in learners:
        for seed in seeds:
            model = models.fit(rows.where("_part in ('I', 'V')"), [*r.base, *features], r.spec.label, learner, seed)
            predictions[learner, seed] = cut_lineage(model.predict(rows.where("_part = 'T'")).select(RID, "p"))
    return [{"learner": learner, "seed": seed, **got} for (learner, seed), got in r.vault.evaluate(predictions).items()]
