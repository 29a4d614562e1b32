"""Contributions to tree outputs against sums over all sets of features."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from callgauge.operators import attribution as at

N = 5


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        x = [rng.random(), float(rng.randint(0, 3)), rng.gauss(0, 1), rng.random(), 1.0]
        rows.append((i, float(x[0] + 0.3 * x[1] + 0.2 * x[2] > 0.9), x[0] * x[1] + x[2], Vectors.dense(x)))
    return spark.createDataFrame(rows, ["i", "label", "y", "features"]).persist()


def expected(tree, node, x, known):
    """Output of one tree with only ``known`` features known."""
    n = tree[node]
    if n.left < 0:
        return n.value
    if n.feature in known:
        return expected(tree, n.left if x[n.feature] <= n.threshold else n.right, x, known)
    return sum(tree[c].cover / n.cover * expected(tree, c, x, known) for c in (n.left, n.right))


def by_subsets(trees, x):
    value = {s: sum(expected(t, 0, x, s) for t in trees) for k in range(N + 1) for s in combinations(range(N), k)}
    out = []
    for j in range(N):
        rest = [i for i in range(N) if i != j]
        out.append(sum(math.factorial(k) * math.factorial(N - k - 1) / math.factorial(N) * (value[tuple(sorted((*s, j)))] - value[s])
                       for k in range(N) for s in combinations(rest, k)))
    return out, value[()]


MODELS = {
    "forest": lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), "boosted": lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1),
    "forest of numbers": lambda: RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=5, seed=1), "boosted numbers": lambda: GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3, seed=1),
    "one leaf": lambda: RandomForestClassifier(numTrees=2, maxDepth=0, seed=1),
}


@pytest.mark.parametrize("name", MODELS)
def test_contributions(data, name):
    model = MODELS[name]().fit(data)
    trees = {}
    for n in at.node_table(model).collect():
        trees.setdefault(n.tree, {})[n.id] = n
    out = model.transform(data)
    raw = vector_to_array("probability")[1] if name in ("forest", "one leaf") else vector_to_array("rawPrediction")[1] if name == "boosted" else F.col("prediction")
    whole = {r.i: (r.x, r.raw) for r in out.select("i", vector_to_array("features").alias("x"), raw.alias("raw")).collect()}
    got = at.contributions(model, data.select("i", "features", "label")).collect()
    assert len(got) == 240 and set(got[0].asDict()) == {"i", "label", "contributions", "base"}
    for r in got:
        assert sum(r.contributions) + r.base == pytest.approx(whole[r.i][1], abs=1e-9)
    for r in got[:25]:
        parts, base = by_subsets(list(trees.values()), whole[r.i][0])
        assert r.contributions == pytest.approx(parts, abs=1e-9) and r.base == pytest.approx(base, abs=1e-9)


def test_ranking_and_no_rows(data):
    model = MODELS["forest"]().fit(data)
    ranked = at.mean_contributions(model, data, ["a", "b", "c", "d", "same"]).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5] and ranked[0].feature in "abc" and {r.feature: r.score for r in ranked}["same"] == 0.0
    phi = np.array([r.contributions for r in at.contributions(model, data).collect()])
    assert {r.feature: r.score for r in ranked}["a"] == pytest.approx(np.abs(phi[:, 0]).mean())
    assert at.contributions(model, data.filter("false")).count() == 0
