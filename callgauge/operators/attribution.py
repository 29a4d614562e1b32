"""What each feature adds to a tree model's output for a row: Shapley values along tree paths, exactly.

With some features unknown, a tree's expected output follows both branches where an unknown feature is
asked for, weighted by the shares of training rows that went there. A leaf then counts with the product,
over the features on its path, of either 1 or 0 (known: does the row pass all their questions?) or the
product of those shares (unknown). Averaged over all orders in which features can become known, a
feature's part of a leaf is a sum over the sizes of the set known before, whose terms are coefficients of
one polynomial per path. Contributions and the base add up to the model's output on every row.

The node tables are the model's own, as Spark saves them. They are small and go to every task; rows stay
where they are and are worked on in Arrow batches, without a copy of the table per feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.session import discard, new_path


class Leaf(NamedTuple):
    """One leaf: its value, and for each feature on its path the interval (low, high] and the share of rows inside it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def node_table(model) -> DataFrame:
    """(tree, id, left, right, feature, threshold, cover, value) of a fitted Spark tree ensemble, values with the trees' weights.

    A forest's value is the mean probability of the positive class (or the mean prediction), that of boosted
    trees the sum of the trees' predictions, which a classifier turns into a probability by a logistic function.
    """
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "trees")
    model.write().save(path)
    try:
        saved = spark.read.parquet(f"{path}/data").collect()
    finally:
        discard(spark, path)
    weights = list(model.treeWeights)
    forest = "RandomForest" in type(model).__name__
    scale = sum(weights) if forest else 1.0
    rows = []
    for tree, n in saved:
        asked = n.split.leftCategoriesOrThreshold
        if n.split.numCategories >= 0:
            raise ValueError("categorical splits are not supported")
        stats = n.impurityStats
        out = stats[1] / sum(stats[:2]) if forest and "Classification" in type(model).__name__ else n.prediction
        rows.append((tree, n.id, n.leftChild, n.rightChild, n.split.featureIndex, float(asked[0]) if asked else None, float(n.rawCount), float(out) * weights[tree] / scale))
    return spark.createDataFrame(rows, "tree int, id int, left int, right int, feature int, threshold double, cover double, value double")


def leaves_of(nodes: DataFrame) -> list[Leaf]:
    """All leaves of a node table with their paths folded to one interval and share per feature."""
    trees: dict[int, dict] = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.id] = n
    out = []
    for tree in trees.values():
        todo = [(tree[0], {})]
        while todo:
            n, path = todo.pop()
            if n.left < 0:
                f = sorted(path)
                out.append(Leaf(n.value, tuple(f), *(tuple(path[i][k] for i in f) for k in range(3))))
                continue
            low, high, share = path.get(n.feature, (-math.inf, math.inf, 1.0))
            for child, a, b in ((tree[n.left], low, min(high, n.threshold)), (tree[n.right], max(low, n.threshold), high)):
                todo.append((child, {**path, n.feature: (a, b, share * child.cover / n.cover)}))
    return out


def base_of(leaves: Sequence[Leaf]) -> float:
    """Expected output without any feature known."""
    return sum(leaf.value * math.prod(leaf.share) for leaf in leaves)


def pattern_parts(known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Parts of a leaf of value 1 that each feature of its path gets, for rows that pass (1) or fail (0) its questions."""
    n, m = known.shape
    out = np.zeros((n, m))
    for j in range(m):
        # coefficient s: sums over the sets of s known others of what they and the unknown rest count
        sums = np.zeros((n, m))
        sums[:, 0] = 1.0
        for i in range(m):
            if i != j:
                sums[:, 1:] = sums[:, 1:] * share[i] + sums[:, :-1] * known[:, i, None]
                sums[:, 0] *= share[i]
        orders = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
        out[:, j] = (known[:, j] - share[j]) * (sums @ orders)
    return out


def row_contributions(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Contributions (rows by features) of rows ``x``; rows that answer a path alike are worked out once."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not leaf.features:
            continue
        f = list(leaf.features)
        known = (x[:, f] > np.array(leaf.low)) & (x[:, f] <= np.array(leaf.high))
        patterns, which = np.unique(known, axis=0, return_inverse=True)
        out[:, f] += leaf.value * pattern_parts(patterns.astype(float), np.array(leaf.share))[which.reshape(-1)]
    return out


def contributions(model, df: DataFrame, features: str = "features", name: str = "contributions") -> DataFrame:
    """``df`` with the array ``name``, a number for each feature, and ``base``; the sum of all is the model's output."""
    leaves = leaves_of(node_table(model))
    base = base_of(leaves)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(leaves)
    kept = [c for c in df.columns if c not in (features, name, "base")]
    rows = df.select(*kept, vector_to_array(features).alias(name))

    def work(batches):
        for batch in batches:
            x = batch.column(name)
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
            found = row_contributions(flat, shared.value) if len(x) else flat
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1], pa.int32())
            columns = [batch.column(c) for c in kept] + [pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, name])

    return rows.mapInArrow(work, rows.schema).withColumn("base", F.lit(base))


def mean_contributions(model, df: DataFrame, cols: Sequence[str], features: str = "features", top: int | None = 20) -> DataFrame:
    """(feature, score, rank): features by the mean size of their contributions, in one aggregate over the rows."""
    from callgauge.operators.features import rank_features

    found = contributions(model, df.select(features), features)
    sums = found.agg(F.array(*[F.coalesce(F.avg(F.abs(F.get("contributions", i))), F.lit(0.0)) for i in range(len(cols))]).alias("s"))
    named = sums.select(F.explode(F.arrays_zip(F.array(*map(F.lit, cols)).alias("feature"), F.col("s").alias("score"))).alias("r")).select("r.feature", "r.score")
    return rank_features(named, top)
