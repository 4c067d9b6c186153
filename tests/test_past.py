"""Aggregates of earlier rows: a key cut into stretches gives what one window partition gives."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import history
from quarry.operators.history import AGGREGATES, VALUELESS, HistorySpec
from quarry.operators.past import Past, large_keys, with_past

SCHEMA = "rid long, t double, e string, k long, v double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for rid in range(600):
        hot = rng.random()
        e = "hot" if hot < 0.5 else None if hot < 0.8 else rng.choice("abcd")
        made.append((rid, float(rng.randrange(150)), e, rng.randrange(3), None if rng.random() < 0.1 else 1e6 + rng.randrange(50)))
    return spark.createDataFrame(made, SCHEMA).cache()


def same(a, b):
    one, two = ({r["rid"]: r.asDict() for r in x.collect()} for x in (a, b))
    assert set(one) == set(two) and len(one) == a.count() == b.count()
    for rid, r in one.items():
        for c, x in r.items():
            y = two[rid][c]
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-4), (rid, c, x, y)


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("keys", [["e"], ["e", "k"]])
def test_stretches_equal_one_partition(rows, keys, ties):
    wanted = {f"{a}_{w}_{s}": Past(a, None if a == "count" else "v", w, s) for a in ("count", "sum", "mean", "std", "std_samp", "last", "min", "max") for w, s in ((0, 1), (0, 4), (5, 1), (40, 3))}
    assert large_keys(rows, keys, "t", 20).where(F.size("_cuts") > 1).count() > 0
    same(with_past(rows, keys, wanted, "t", "rid", ties), with_past(rows, keys, wanted, "t", "rid", ties, most_rows=20))


def test_history_of_a_hot_entity(rows):
    specs = [HistorySpec(("e",), a, None if a in VALUELESS else "v", w, s) for a in AGGREGATES for w, s in ((0, 1), (3, 2))]
    same(history.with_history(rows, specs, "t", "rid"), history.with_history(rows, specs, "t", "rid", most_rows=25))


def test_bank_of_a_hot_entity(rows):
    for build in (
        lambda **kw: history.prior_count(rows, ["e"], "t", "rid", "z", **kw), lambda **kw: history.gap(rows, ["e"], "t", "rid", "z", **kw),
        lambda **kw: history.mean_ratio(rows, ["e"], "v", "t", "rid", "z", **kw), lambda **kw: history.prior_distinct(rows, "e", "k", "t", "rid", "z", **kw),
    ):
        same(build(), build(most_rows=30))


def test_one_time_and_empty(spark):
    one = spark.createDataFrame([(i, 1.0, "a", 0, float(i)) for i in range(40)], SCHEMA)
    want = {"n": Past("count"), "m": Past("mean", "v")}
    same(with_past(one, ["e"], want, "t", "rid"), with_past(one, ["e"], want, "t", "rid", most_rows=10))
    assert with_past(one.where("rid < 0"), ["e"], want, "t", "rid").count() == 0
    with pytest.raises(ValueError):
        Past("count", "v")
