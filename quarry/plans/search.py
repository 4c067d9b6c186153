"""Search loops over candidate features, and the further moves of a multi-learner run. Loops are on the driver and take what they need as
functions, so that any learner, proposer or score serves; each evaluation is a DataFrame plan."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.expr import ExpressionError, compile_expression, order_by_dependency, with_expressions
from quarry.operators import formula, models, score
from quarry.operators.metrics import average_precision
from quarry.operators.split import lottery
from quarry.plans import templates

Evaluate = Callable[[dict[str, str]], float]
Propose = Callable[[int, list[dict]], list[dict]]


def evaluator(fit: DataFrame, valid: DataFrame, base: Sequence[str], y: str, learner: str = "logistic", seed: int = 11) -> Evaluate:
    """Average precision on the valid rows of a model on the base columns and the given expressions, remembered by feature set."""
    known: dict[frozenset, float] = {}

    def run(features: dict[str, str]) -> float:
        key = frozenset(features.items())
        if key not in known:
            model = models.fit(with_expressions(fit, features, label=y), [*base, *features], y, learner, seed)
            known[key] = average_precision(model.predict(with_expressions(valid, features, label=y)), y, "p").first()["ap"] or 0.0
        return known[key]

    return run


def accept_blocks(evaluate: Evaluate, propose: Propose, rounds: int = 10, least_gain: float = 0.0) -> tuple[dict[str, str], list[dict]]:
    """Blocks of proposals, each kept as a whole if the score rises. The proposer sees earlier blocks and their outcomes."""
    kept: dict[str, str] = {}
    best, log = evaluate(kept), []
    for k in range(rounds):
        block = {p["name"]: p["expression"] for p in propose(k, log) if p["name"] not in kept}
        if not block:
            break
        try:
            value = evaluate({**kept, **block})
        except (ExpressionError, ValueError) as e:
            log.append({"round": k, "block": block, "accepted": False, "why": str(e)})
            continue
        accepted = value > best + least_gain
        log.append({"round": k, "block": block, "accepted": accepted, "score": value})
        if accepted:
            kept, best = {**kept, **block}, value
    return kept, log


def islands(evaluate: Evaluate, propose: Propose, n_islands: int = 3, rounds: int = 12, reset_every: int = 6, seed: int = 0) -> tuple[dict[str, str], float]:
    """Populations of feature sets on islands: each round grows one island from its best sets; every reset_every rounds the
    worse half starts anew from the best set of the better half."""
    rng = random.Random(seed)
    empty = evaluate({})
    worlds: list[list[tuple[float, dict[str, str]]]] = [[(empty, {})] for _ in range(n_islands)]
    for k in range(rounds):
        here = worlds[rng.randrange(n_islands)]
        parents = sorted(here, key=lambda m: -m[0])[:2]
        log = [{"score": s, "features": f} for s, f in parents]
        child = {**parents[0][1], **{p["name"]: p["expression"] for p in propose(k, log)}}
        try:
            here.append((evaluate(child), child))
        except (ExpressionError, ValueError):
            continue
        if (k + 1) % reset_every == 0:
            worlds.sort(key=lambda w: -max(m[0] for m in w))
            half = (n_islands + 1) // 2
            for i in range(half, n_islands):
                worlds[i] = [max(worlds[i - half], key=lambda m: m[0])]
    value, features = max((m for w in worlds for m in w), key=lambda m: m[0])
    return features, value


def class_rules(fit: DataFrame, valid: DataFrame, rules: Sequence[str], y: str, learner: str = "rules") -> tuple[DataFrame, list[str]]:
    """Rules (conditions) as 0/1 columns under a model whose weights cannot be negative; rules constant on the fit rows are left out."""
    columns = set(fit.columns)
    pool = {f"rule{i}": text for i, text in enumerate(rules) if compile_expression(text, columns, y).tree.boolean}
    rows = with_expressions(fit, pool, label=y)
    got = rows.agg(*[F.count_distinct(n).alias(n) for n in pool]).first() if pool else None
    used = [n for n in pool if got[n] > 1]
    if not used:
        raise ValueError("no rule tells rows apart")
    model = models.fit(rows, used, y, learner)
    return model.predict(with_expressions(valid, pool, label=y)), [pool[n] for n in used]


def refine_columns(evaluate: Evaluate, propose: Propose, describe: Callable[[dict[str, str]], str], rounds: int = 5) -> tuple[dict[str, str], list[dict]]:
    """One new column a round, replaced by its refinements: the proposer sees a small tree's text and each try's score."""
    kept: dict[str, str] = {}
    best, log = evaluate(kept), []
    for k in range(rounds):
        tries = propose(k, [*log, {"tree": describe(kept)}])
        for p in tries:
            try:
                value = evaluate({**kept, p["name"]: p["expression"]})
            except (ExpressionError, ValueError) as e:
                log.append({"round": k, "name": p["name"], "why": str(e)})
                continue
            log.append({"round": k, "name": p["name"], "score": value})
            if value > best:
                kept, best = {**kept, p["name"]: p["expression"]}, value
    return kept, log


def rank_formulas(fit: DataFrame, r: str, rid: str, trees: Iterable[formula.Formula], keep: int = 10) -> list[tuple[str, float]]:
    """Formula trees by |correlation| of their values, fitted and applied on the fit rows, with the residual; all in one table."""
    rows, names = fit, []
    for i, tree in enumerate(trees):
        rows = formula.evaluate(tree, fit, rows, rid, f"_f{i}")
        names.append(tree.name)
    got = {s["column"]: s["score"] for s in score.correlation_scores(rows, [f"_f{i}" for i in range(len(names))], r).collect()}
    ranked = sorted(((names[i], got[f"_f{i}"]) for i in range(len(names))), key=lambda x: (-abs(x[1]), x[0]))
    return ranked[:keep]


def formula_grid(numbers: Sequence[str], categories: Sequence[str]) -> list[formula.Formula]:
    """All formulas of one operator: unary ones of numbers, binary ones of pairs, grouped ones of a number by a category."""
    c = formula.column
    out = [formula.Formula(op, (c(a),)) for op in formula.UNARY for a in numbers]
    out += [formula.Formula(op, (c(a), c(b))) for op in formula.BINARY for a in numbers for b in numbers if a != b and (op in "-/" or a < b)]
    out += [formula.Formula(op, (c(a), c(k))) for op in [*formula.GROUPED, "GroupByThenRank"] for a in numbers for k in categories]
    return out + [formula.Formula("freq", (c(k),)) for k in categories]


# ------------------------------------------------------------------ moves of a multi-learner run


def evaluation_folds(df: DataFrame, rid: str, k: int = 3, pos: str | None = None, n: int | None = None, tail: float = 0.6, seed: int = 0, name: str = "_eval") -> DataFrame:
    """Marks evaluation folds 0 .. k-1: at random, or, with positions, k runs of the chronological tail (others null)."""
    if pos is None:
        return score.shuffled_folds(df, rid, k, seed, name)
    start = n - int(n * tail)
    return df.withColumn(name, F.when(F.col(pos) >= start, F.least(F.floor((F.col(pos) - start) * k / (n - start)), F.lit(k - 1))).cast("int"))


def select_pairs(tests: DataFrame, seat: str, factor: str, p: str, q: float = 0.1, per_factor: int = 1) -> DataFrame:
    """(seat, factor) pairs by step-up over all pairs, of each factor at most ``per_factor``, those of smallest p."""
    keyed = tests.withColumn("_key", F.concat_ws("|", F.col(seat).cast("string"), F.col(factor).cast("string")))
    chosen = score.step_up(keyed, p, "_key", q).where("selected")
    return chosen.withColumn("_k", F.row_number().over(Window.partitionBy(factor).orderBy(p, "_key"))).where(F.col("_k") <= per_factor).drop("_k", "_key")


@dataclass
class Blacklist:
    """Features a seat's model has rejected for good."""

    of: dict[str, set[str]] = field(default_factory=dict)

    def add(self, seat: str, names: Iterable[str]) -> None:
        self.of.setdefault(seat, set()).update(names)

    def allowed(self, seat: str, names: Iterable[str]) -> list[str]:
        return [n for n in names if n not in self.of.get(seat, ())]


def inject_plan(saved: Mapping[str, str], columns: Iterable[str], label: str, mode: str = "surface", admit: Callable[[list[str]], list[str]] | None = None) -> dict[str, str]:
    """A saved feature plan in dependency order. Mode "surface" takes all, "bank" those that stand on raw columns only,
    "gated" those that ``admit`` lets in together with what they need."""
    columns = set(columns)
    order = order_by_dependency(saved, dict(saved), columns)
    for name in order:
        compile_expression(saved[name], columns | set(saved), label)
    if mode == "bank":
        order = [n for n in order if not set(compile_expression(saved[n], columns | set(saved)).columns) & set(saved)]
    elif mode == "gated":
        order = order_by_dependency(admit(order), dict(saved), columns)
    return {n: saved[n] for n in order}


def seed_sweep(scores: Mapping[str, float], top: int = 6, most: int = 240) -> dict[str, str]:
    """Compositions of the bank's strongest features."""
    best = sorted(scores, key=lambda n: (-abs(scores[n]), n))[:top]
    return templates.sweep(best, most)


def beam(raw: Sequence[str], score_pool: Callable[[dict[str, str]], Mapping[str, float]], depths: int = 3, width: int = 6, least: float = 0.0) -> dict[str, str]:
    """Depth by depth, the ``width`` strongest candidates over ``least`` survive and are composed further; an empty depth ends it."""
    survivors: dict[int, list[str]] = {}
    pool: dict[str, str] = {}
    for depth in range(1, depths + 1):
        grown = {n: e for n, (e, _, _) in templates.depth_grid(raw, survivors, depth).items() if n not in pool}
        scores = score_pool({**pool, **grown})
        alive = sorted((n for n in grown if abs(scores.get(n, 0.0)) > least), key=lambda n: (-abs(scores[n]), n))[:width]
        if not alive:
            break
        survivors[depth] = alive
        pool |= {n: grown[n] for n in alive}
    return pool


def depth_funnel(candidates: Mapping[str, tuple[str, int, tuple[str, ...]]], depth: int, arity: int) -> dict[str, str]:
    """Candidates of one depth whose expression reads at most ``arity`` parents."""
    return {n: e for n, (e, d, parents) in candidates.items() if d == depth and len(set(parents)) <= arity}


def changed_seats(before: Mapping[str, Sequence[str]], after: Mapping[str, Sequence[str]]) -> list[str]:
    """Seats whose feature list changed: only these are fitted again."""
    return [s for s in after if list(before.get(s, ())) != list(after[s])]


def prune_seats(weights: Mapping[str, float], least: float = 0.02, keep: int = 2) -> dict[str, float]:
    """Seats of at least that ensemble weight, at any rate the ``keep`` heaviest, weights summing to 1 again."""
    order = sorted(weights, key=lambda s: (-weights[s], s))
    chosen = [s for i, s in enumerate(order) if i < keep or weights[s] >= least]
    total = sum(weights[s] for s in chosen) or 1.0
    return {s: weights[s] / total for s in chosen}


def greedy_weights(df: DataFrame, y: str, columns: Sequence[str], steps: int = 8) -> dict[str, float]:
    """Ensemble weights by repeated choice of the column whose addition to the mean gives the highest average precision; each step
    measures all columns in one plan."""
    from quarry.operators.metrics import stack_scores

    counts = dict.fromkeys(columns, 0)
    for _ in range(steps):
        n = sum(counts.values()) + 1
        total: Column = sum((F.col(c) * k for c, k in counts.items() if k), F.lit(0.0))
        aps = average_precision(stack_scores(df, y, {c: (total + F.col(c)) / n for c in columns}), y="y", p="p", by=["candidate"]).collect()  # a row a column
        best = {r["candidate"]: r["ap"] or 0.0 for r in aps}
        counts[max(columns, key=lambda c: best.get(c, 0.0))] += 1
    return {c: k / steps for c, k in counts.items() if k}


def holdout_mark(df: DataFrame, rid: str, share: float = 1 / 9, seed: int = 0, name: str = "_holdout") -> DataFrame:
    """A random holdout by row id, for the stacking decision of data without time."""
    ticket = F.conv(F.substring(lottery(f"holdout{seed}", rid), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn(name, ticket < share)


_NAMELESS = re.compile(r"(?:v|x|f|c|col|var|feat|feature|attr|field|column|pc|dim)?_?\d+", re.I)


def anonymous_columns(columns: Sequence[str], cap: int = 40) -> tuple[list[str], list[str]]:
    """(kept, left out): columns with a meaning in their name come first; of nameless ones (v12, col_3) as many as the cap leaves room for,
    in order. An ending of our own (_log, _code, _te, _freq) does not count as a meaning."""
    bare = {c: re.sub(r"_(log|code|te|freq)$", "", c) for c in columns}
    named = [c for c in columns if not _NAMELESS.fullmatch(bare[c])]
    nameless = [c for c in columns if _NAMELESS.fullmatch(bare[c])]
    kept = set(named) | set(nameless[: max(cap - len(named), 0)])
    return [c for c in columns if c in kept], [c for c in columns if c not in kept]


def prefer_plain(oof: DataFrame, y: str, plain: str, core: str, least_gain: float = 0.0) -> bool:
    """Whether to fall back to the model without features: its out-of-fold average precision is not below the core's by more than
    least_gain. Only out-of-fold predictions decide; no test label is read."""
    from quarry.operators.metrics import stack_scores

    aps = {r["candidate"]: r["ap"] or 0.0 for r in average_precision(stack_scores(oof, y, {"plain": F.col(plain), "core": F.col(core)}), "y", "p", ["candidate"]).collect()}  # two rows
    return aps.get("core", 0.0) <= aps.get("plain", 0.0) + least_gain
