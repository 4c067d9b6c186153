"""Quantiles from ranges of the values equal those that one task finds."""

import random

import numpy as np
import pytest

from quarry.plans.schema import quantiles_by

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = [(k, x) for k, draw in (("even", lambda: rng.random()), ("few", lambda: float(rng.randrange(3))), ("one", lambda: 7.0), (None, lambda: rng.gauss(0, 1e6))) for x in (draw() for _ in range(301))]
    return spark.createDataFrame([*made, ("lone", 2.5), ("even", None)], "k string, x double").cache()


def test_ranges_equal_one_task(rows):
    want, got = ({r["k"]: r["edges"] for r in quantiles_by(rows, "x", SHARES, ["k"], most_values=m).collect()} for m in (10**6, 0))
    assert set(want) == set(got) == {"even", "few", "one", "lone", None}
    for k, edges in want.items():
        assert got[k] == pytest.approx(edges, rel=1e-12)
        assert edges == pytest.approx(np.quantile([r["x"] for r in rows.where(rows.k.eqNullSafe(k)).collect() if r["x"] is not None], SHARES).tolist(), rel=1e-12)


def test_empty(rows):
    assert quantiles_by(rows.where("k = 'none'"), "x", SHARES, ["k"], most_values=0).count() == 0
    assert quantiles_by(rows.where("k = 'none'"), "x", SHARES, ["k"], most_values=-1).count() == 0


def test_normal_quantile(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from quarry.operators.drift import normal_quantile

    shares = [1e-9, 0.001, 0.02425, 0.1, 0.5, 0.77, 0.97575, 0.9999]
    got = spark.createDataFrame([(p,) for p in [*shares, None]], "p double").select(normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got[:-1]] == pytest.approx([NormalDist().inv_cdf(p) for p in shares], rel=2e-9, abs=1e-12)
    assert got[-1][0] is None
