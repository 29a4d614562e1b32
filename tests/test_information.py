"""Nearest-neighbour information against all pairs, and bootstrap weights."""

import math
import random

import numpy as np
import pytest

from callgauge.operators import information as inf, matching as mt


def psi(n):
    return -inf.EULER + sum(1 / j for j in range(1, n))


def by_pairs(rows, k):
    """Information of (label, value) rows by looking at all pairs."""
    rows = [(y, x) for y, x in rows if y is not None and x is not None and math.isfinite(x)]
    sizes = {y: sum(1 for a, _ in rows if a == y) for y, _ in rows}
    rows = [(y, x) for y, x in rows if sizes[y] > 1]
    if not rows:
        return 0.0
    total = 0.0
    for i, (y, x) in enumerate(rows):
        near = min(k, sizes[y] - 1)
        reach = sorted(abs(b - x) for j, (a, b) in enumerate(rows) if a == y and j != i)[near - 1]
        inside = sum(abs(b - x) < reach or b == x for _, b in rows)
        total += psi(near) - psi(sizes[y]) - psi(inside)
    return max(psi(len(rows)) + total / len(rows), 0.0)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_information_agrees_with_all_pairs(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(300):
        y = rng.choice(["a", "a", "a", "b", "rare" if i % 90 == 0 else "b", None])
        ties = rng.choice([0.0, -0.0, 1.0, 2.5, 2.5, None, float("nan"), float("inf")])
        rows.append((y, ties, rng.gauss(2.0 if y == "a" else 0.0, 1), float(rng.randint(0, 40)), 7.0 if rng.random() < 0.9 else None))
    rows += [("once", 1.0, 50.0, 3.0, 7.0), ("two", None, 1e9, 60.0, 7.0), ("two", None, -1e9, 61.0, 7.0)]
    df = spark.createDataFrame(rows, "y string, ties double, normal double, whole double, same double").selectExpr("*", "1 AS n", "2 AS x", "3 AS r", "CAST(NULL AS DOUBLE) AS empty")
    got = {r.feature: r.score for r in inf.neighbour_information(df, ["ties", "normal", "whole", "same", "empty"], "y", k).collect()}
    want = {c: by_pairs([(row[0], row[j]) for row in rows], k) for j, c in enumerate(("ties", "normal", "whole", "same"), 1)}
    assert got.keys() == {*want, "empty"} and got["empty"] == 0.0
    assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)
    assert got["normal"] > got["same"]


def test_one_class_value_in_many_ranges(spark):
    # the rare class has its neighbours many ranges away
    rows = [("often", float(i)) for i in range(400)] + [("rare", float(v)) for v in (0.5, 199.5, 399.5)]
    df = spark.createDataFrame(rows, "y string, v double")
    got = inf.neighbour_information(df, ["v"], "y", 2).first().score
    assert got == pytest.approx(by_pairs(rows, 2), abs=1e-9)
    assert inf.neighbour_information(df.filter("false"), ["v"], "y").first().score == 0.0


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 60).select(inf.digamma(inf.F.col("id")).alias("p"), "id").orderBy("id").collect()]
    assert got == pytest.approx([psi(n) for n in range(1, 60)], abs=1e-11)


def test_weights_are_poisson():
    w = mt.poisson_weights(np.arange(-2000, 3000, dtype=np.int64), 200, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.06
    assert (mt.poisson_weights(np.array([7]), 200, 42) == w[2007]).all()


def test_interval_of_few_and_no_pairs(spark):
    rows = [("p", 1.0, 0.0), ("q", 3.0, 1.0), (None, None, 1.0), (None, 2.0, 2.0)]
    pairs = spark.createDataFrame(rows, "k string, v double, control_value double")
    got = mt.bootstrap_interval(pairs, "v", "k").first()
    assert 0 <= got.ci_lower <= got.ci_upper <= 2 and 0 < got.replicates <= 200
    none = mt.bootstrap_interval(pairs.filter("false"), "v", "k").first()
    assert none.ci_lower is None and none.replicates == 0
