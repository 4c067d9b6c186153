"""Learners behind one interface: fit on columns of numbers, predict a probability. Built on MLlib; a "module:function" name brings
another estimator in. Missing numbers take the fit rows' median and set an indicator."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.metrics import average_precision
from quarry.operators.split import stratified_folds
from quarry.plans.schema import cut_lineage, finite, together

LABEL, FEATURES = "_label", "_features"


def make_learner(name: str = "logistic", seed: int = 11, **settings):
    """logistic, forest, boosted, tree, or "module:function"; the function takes (seed, **settings) and gives an estimator."""
    from pyspark.ml import classification as C

    common = {"labelCol": LABEL, "featuresCol": FEATURES}
    if ":" in name:
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)(seed=seed, **settings)
    if name == "logistic":
        return C.LogisticRegression(**common, standardization=True, **({"regParam": 0.01, "maxIter": 30} | settings))
    if name == "rules":  # rules with weights that cannot be negative
        from pyspark.ml.linalg import DenseMatrix

        k = settings.pop("n_features")
        return C.LogisticRegression(**common, lowerBoundsOnCoefficients=DenseMatrix(1, k, [0.0] * k), **({"maxIter": 50} | settings))
    if name == "forest":
        return C.RandomForestClassifier(**common, seed=seed, **({"numTrees": 20, "maxDepth": 6} | settings))
    if name == "boosted":
        return C.GBTClassifier(**common, seed=seed, **({"maxIter": 20, "maxDepth": 4} | settings))
    if name == "tree":
        return C.DecisionTreeClassifier(**common, seed=seed, **({"maxDepth": 4} | settings))
    raise ValueError(f"learner not known: {name}")


def matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the features as doubles (null where there is no finite number) and 0/1 indicators of what is missing."""
    values = {f"_x{i}": finite(F.col(f"`{c}`")) for i, c in enumerate(features)}
    return df.withColumns(values).withColumns({f"_z{i}": F.col(f"_x{i}").isNull().cast("double") for i in range(len(features))})


class Model:
    def __init__(self, fitted, features: list[str]):
        self.fitted, self.features = fitted, features

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        if isinstance(self.stage, LogisticRegressionModel) and self.stage.numClasses == 2 and self.stage.coefficientMatrix.numRows == 1:
            return self._logistic(df, name)
        out = self.fitted.transform(matrix(df, self.features))
        extra = [c for c in out.columns if c not in df.columns]
        return out.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in extra if c != name])

    def _logistic(self, df: DataFrame, name: str) -> DataFrame:
        """The model's probability as one expression: no row becomes a vector."""
        k, weights = len(self.features), self.stage.coefficients.toArray().tolist()
        medians = self.fitted.stages[0].surrogateDF.first()
        terms = [F.lit(self.stage.intercept)]
        for i, c in enumerate(self.features):
            x = finite(F.col(f"`{c}`"))
            terms += [F.lit(weights[i]) * F.coalesce(x, F.lit(medians[f"_x{i}"])), F.when(x.isNull(), weights[k + i]).otherwise(0.0)]
        while len(terms) > 1:  # in pairs, so that the expression stays shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
        return df.withColumn(name, 1.0 / (1.0 + F.exp(-terms[0])))

    @property
    def stage(self):
        return self.fitted.stages[-1]

    def importances(self) -> dict[str, float]:
        """Of trees, the importance of each feature, its indicator's included; of linear models, the size of the coefficient."""
        k = len(self.features)
        raw = self.stage.featureImportances.toArray() if hasattr(self.stage, "featureImportances") else abs(self.stage.coefficients.toArray())
        return {c: float(raw[i] + raw[k + i]) for i, c in enumerate(self.features)}


def fit(df: DataFrame, features: list[str], y: str, learner: str = "logistic", seed: int = 11, **settings) -> Model:
    k = len(features)
    names = [f"_x{i}" for i in range(k)]
    if learner == "rules":
        settings = {"n_features": 2 * k} | settings
    stages = [
        Imputer(inputCols=names, outputCols=[f"_m{i}" for i in range(k)], strategy="median", relativeError=0.001),
        VectorAssembler(inputCols=[f"_m{i}" for i in range(k)] + [f"_z{i}" for i in range(k)], outputCol=FEATURES),
        make_learner(learner, seed, **settings),
    ]
    rows = matrix(df.withColumn(LABEL, F.col(y).cast("double")), features)
    lacking = rows.agg(*[F.count(n).alias(n) for n in names]).first()
    if empty := [c for c, n in zip(features, names, strict=True) if not lacking[n]]:
        raise ValueError(f"columns without any number: {empty}")
    return Model(Pipeline(stages=stages).fit(rows), list(features))


def fit_folds(dealt: DataFrame, features: list[str], y: str, learner: str = "logistic", folds: int = 4, seed: int = 11, **settings) -> list[Model]:
    """Of each _fold, the model of the other folds' rows."""
    return together(dealt.sparkSession, [lambda k=k: fit(dealt.where(F.col("_fold") != k), features, y, learner, seed + k, **settings) for k in range(folds)])


def out_of_fold(df: DataFrame, features: list[str], y: str, rid: str, learner: str = "logistic", folds: int = 4, seed: int = 11, apply: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = cut_lineage, **settings) -> tuple[DataFrame, DataFrame | None]:
    """(rid, p) of df, each row by the model that did not see it; and (rid, p) of apply, the mean of the folds' models. keep writes the
    rows with their folds."""
    dealt = keep(stratified_folds(df, y, rid, folds, seed))
    oof, applied = None, None
    for k, model in enumerate(fit_folds(dealt, features, y, learner, folds, seed, **settings)):
        part = model.predict(dealt.where(F.col("_fold") == k)).select(rid, "p")
        oof = part if oof is None else oof.unionByName(part)
        if apply is not None:
            more = model.predict(apply).select(rid, "p")
            applied = more if applied is None else applied.unionByName(more)
    return oof, applied.groupBy(rid).agg(F.avg("p").alias("p")) if applied is not None else None


def probe_card(df: DataFrame, features: list[str], y: str, rid: str, rows: int = 60_000, columns: int = 10, pairs: int = 12, trees: int = 20, seed: int = 11) -> dict:
    """The most important columns of a tree model on at most ``rows`` rows, and the pairs that trees use together most often."""
    import re
    from collections import Counter

    from quarry.operators.split import sample_rows

    model = fit(sample_rows(df, rid, rows, seed), features, y, "forest", seed, numTrees=trees)
    top = sorted(model.importances().items(), key=lambda kv: (-kv[1], kv[0]))[:columns]
    together: Counter = Counter()
    for tree in model.stage.toDebugString.split("Tree ")[1:]:
        used = sorted({int(i) % len(features) for i in re.findall(r"feature (\d+)", tree)})
        together.update((features[a], features[b]) for n, a in enumerate(used) for b in used[n + 1 :])
    return {"columns": [c for c, _ in top], "pairs": [p for p, _ in sorted(together.items(), key=lambda kv: (-kv[1], kv[0]))[:pairs]]}


def tree_text(df: DataFrame, features: list[str], y: str, depth: int = 4) -> str:
    """A small balanced tree as text, with the columns' names."""
    n = df.agg(F.avg(y).alias("m")).first()["m"] or 0.5
    weighted = df.withColumn("_weight", F.when(F.col(y) == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9)))
    text = fit(weighted, features, y, "tree", maxDepth=depth, weightCol="_weight").stage.toDebugString
    for i in reversed(range(2 * len(features))):
        text = text.replace(f"feature {i} ", (features[i] if i < len(features) else f"missing({features[i - len(features)]})") + " ")
    return text


def grid_search(fit_rows: DataFrame, valid_rows: DataFrame, features: list[str], y: str, grid: list[tuple[str, dict]], seed: int = 11) -> tuple[int, list[float]]:
    """The place of the best (learner, settings) by average precision on the held-out rows, the first on ties; and all values."""
    aps = []
    for learner, settings in grid:
        model = fit(fit_rows, features, y, learner, seed, **settings)
        aps.append(average_precision(model.predict(valid_rows), y, "p").first()["ap"] or 0.0)
    return max(range(len(aps)), key=lambda i: (aps[i], -i)), aps


def choose_representation(fit_rows: DataFrame, valid_rows: DataFrame, options: dict[str, list[str]], y: str, tolerance: float = 0.0005, learner: str = "logistic") -> str:
    """The option of highest average precision; options come simplest first, and a simpler one wins within the tolerance."""
    aps = {k: average_precision(fit(fit_rows, cols, y, learner).predict(valid_rows), y, "p").first()["ap"] or 0.0 for k, cols in options.items()}
    best = max(aps.values())
    return next(k for k in options if aps[k] >= best - tolerance)


def stacked(fit_rows: DataFrame, apply_rows: DataFrame, features: list[str], y: str, rid: str, learners: list[str], meta: str = "logistic", folds: int = 4, seed: int = 11) -> DataFrame:
    """(rid, p) of apply_rows from two layers: out-of-fold predictions of the learners are the meta learner's features."""
    low, high = fit_rows.select(rid, y), apply_rows.select(rid)
    for i, name in enumerate(learners):
        oof, applied = out_of_fold(fit_rows, features, y, rid, name, folds, seed, apply_rows)
        low, high = low.join(oof.withColumnRenamed("p", f"l{i}"), rid), high.join(applied.withColumnRenamed("p", f"l{i}"), rid)
    return fit(low, [f"l{i}" for i in range(len(learners))], y, meta, seed).predict(high).select(rid, "p")


Predictor = Callable[[DataFrame], DataFrame]
