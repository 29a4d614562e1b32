"""Boosted trees by second-order steps on binned values.

Every column is cut at quantiles, once. A tree grows level by level: tasks sum the gradient and the Hessian of
the loss for each (node, column, bin) of the rows they hold, one aggregate adds up those histograms, and the
driver, which sees nodes x columns x bins numbers however many rows there are, takes for each node the cut with
the largest gain

    T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda),    T(G) = sign(G) max(|G| - alpha, 0)

if it is larger than gamma. Leaves are Newton steps, -T(G) / (H + lambda), times the rate. Rows with a missing
value go to the side that gains more. Gains that agree to nine digits are equal; then the first column, the
lowest cut, and the left side for missing values are taken. Columns and rows of a round are drawn from a seed and
from a hash of the row's key, so a task that is run again draws the same.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from callgauge.operators.ordering import range_index
from callgauge.session import discard, new_path

#: Rounds after which the rows' outputs so far are written, so that later rounds do not walk all earlier trees.
HELD_ROUNDS = 10
#: Ranks of the edges of bins are right to one part in so many.
ACCURACY = 10_000
#: Rows that one task works on.
TASK_ROWS = 200_000
DIGITS = 9


class Settings(NamedTuple):
    """What a fit asks for; the names follow their meaning."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    bins: int = 64
    l2: float = 1.0
    l1: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    columns: float = 1.0
    subsample: float = 1.0
    seed: int = 42


class Tree(NamedTuple):
    """Nodes as arrays: column and last bin to the left, side of missing values, children (-1: a leaf) and the leaf's output."""

    column: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray) -> np.ndarray:
        """Leaf that each row of ``bins`` ends in."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            x = bins[rows, self.column[at]]
            to_left = np.where(x < 0, self.missing_left[at], x <= self.cut[at])
            at = np.where(inner, np.where(to_left, self.left[at], self.right[at]), at)


def number(c: str) -> Column:
    """The column as a number; NaN is missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Values at the inner quantiles of every column, equal ones once: one pass over all columns, ranks right to 1 in ``ACCURACY``."""
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.agg(*[F.percentile_approx(number(c), cuts, F.lit(ACCURACY)).alias(f"c{k}") for k, c in enumerate(cols)]).first()
    return {c: sorted(set(found[k] or [])) for k, c in enumerate(cols)}


def binned(edges: dict[str, list[float]]) -> Column:
    """Bin of each column: how many of its edges lie below the value; -1 if missing."""

    def one(c: str) -> Column:
        x = number(c)
        return F.coalesce(range_index(x, edges[c]) if edges[c] else F.when(x.isNotNull(), 0), F.lit(-1)).cast("short")

    return F.array(*[one(c) for c in edges])


def slopes(logistic: bool, y: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss at the outputs so far."""
    if not logistic:
        return weight * (margin - y), weight
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - y), weight * p * (1 - p)


def drawn(u: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Which rows take part in a round: a hash of each row's number ``u`` and the round."""
    if share >= 1:
        return np.ones(len(u), bool)
    with np.errstate(over="ignore"):
        x = u.view(np.uint64) + np.uint64(round_ + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * 2**64))


def bins_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def outputs(trees: Sequence[Tree], bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.node(bins)]
    return margin


def histograms(rows: DataFrame, trees: Sequence[Tree], growing: Tree, nodes: Sequence[int], width: int, bins: int, logistic: bool, round_: int, share: float) -> np.ndarray:
    """Sums of gradient and Hessian by (node, column, bin + 1), bin 0 being missing: an array of nodes x columns x bins x 2."""
    place = np.full(len(growing.left), -1, np.int64)
    place[list(nodes)] = np.arange(len(nodes))
    cells = len(nodes) * width * (bins + 1)

    def work(batches):
        sums = np.zeros((2, cells))
        for batch in batches:
            x = bins_matrix(batch.column("x"), width)
            y, weight, margin, u = (batch.column(c).to_numpy() for c in ("y", "weight", "margin", "u"))
            node = place[growing.node(x)]
            keep = (node >= 0) & drawn(u, round_, share)
            if not keep.any():
                continue
            x, node = x[keep], node[keep]
            at = ((node[:, None] * width + np.arange(width)) * (bins + 1) + x + 1).reshape(-1)
            for k, slope in enumerate(slopes(logistic, y[keep], outputs(trees, x, margin[keep]), weight[keep])):
                sums[k] += np.bincount(at, np.repeat(slope, width), cells)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], ["cell", "g", "h"])

    found = rows.mapInArrow(work, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out = np.zeros((cells, 2))
    for cell, g, h in found:
        out[cell] = g, h
    return out.reshape(len(nodes), width, bins + 1, 2)


def strength(g, h, s: Settings):
    # sides without weight are ruled out by the caller
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.maximum(np.abs(g) - s.l1, 0) ** 2 / (h + s.l2)


def best_cut(hist: np.ndarray, columns: Sequence[int], s: Settings) -> tuple[float, int, int, bool] | None:
    """(gain, column, cut, missing to the left) of one node's histogram, or nothing that gains enough."""
    g, h = hist[..., 0], hist[..., 1]
    total_g, total_h = g[0].sum(), h[0].sum()
    sides = []
    for missing in (1, 0):
        left_g, left_h = (np.cumsum(a[:, 1:-1], axis=1) + missing * a[:, :1] for a in (g, h))
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = strength(left_g, left_h, s) + strength(right_g, right_h, s) - strength(total_g, total_h, s)
        sides.append(np.where((left_h >= s.min_weight) & (right_h >= s.min_weight), gain, -np.inf))
    gain = np.round(np.stack(sides, axis=-1), DIGITS)
    gain[[c for c in range(len(gain)) if c not in set(columns)]] = -np.inf
    if not gain.size or not gain.max() > max(s.min_gain, 10.0**-DIGITS):
        return None
    column, cut, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain.max()), int(column), int(cut), side == 0


def grow(rows: DataFrame, trees: Sequence[Tree], s: Settings, width: int, bins: int, logistic: bool, round_: int, columns: Sequence[int]) -> Tree:
    """One more tree, a Spark job for each level."""
    column, cut, side, left, right, value = [0], [0], [True], [-1], [-1], [0.0]
    tree = lambda: Tree(*map(np.array, (column, cut, side, left, right, value)))
    level = [0]
    for depth in range(s.depth + 1):
        hist = histograms(rows, trees, tree(), level, width, bins, logistic, round_, s.subsample)
        below = []
        for node, h in zip(level, hist):
            g_all, h_all = h[0, :, 0].sum(), h[0, :, 1].sum()
            value[node] = float(-np.sign(g_all) * max(abs(g_all) - s.l1, 0) / (h_all + s.l2) * s.rate) if h_all + s.l2 > 0 else 0.0
            found = best_cut(h, columns, s) if depth < s.depth else None
            if found:
                _, column[node], cut[node], side[node] = found
                left[node], right[node] = len(left), len(left) + 1
                below += [left[node], right[node]]
                for a, empty in ((column, 0), (cut, 0), (side, True), (left, -1), (right, -1), (value, 0.0)):
                    a += [empty, empty]
        level = below
        if not level:
            break
    return tree()


class BoostedTrees:
    """A fitted model: edges of the bins, trees, and what the outputs start from."""

    def __init__(self, edges: dict[str, list[float]], trees: list[Tree], start: float, logistic: bool):
        self.edges, self.trees, self.start, self.logistic = edges, trees, start, logistic

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with the probability of the positive class, or the predicted number."""
        shared = df.sparkSession.sparkContext.broadcast((self.trees, self.start))
        logistic = self.logistic

        @F.pandas_udf("double")
        def out(bins: pd.Series) -> pd.Series:
            trees, start = shared.value
            if not len(bins):
                return pd.Series([], dtype="float64")
            margin = outputs(trees, np.stack(bins.to_numpy()), np.full(len(bins), start))
            return pd.Series(1 / (1 + np.exp(-margin)) if logistic else margin)

        return df.withColumn(name, out(binned(self.edges)))


def fit_second_order(df: DataFrame, cols: Sequence[str], label: str, key: str, settings: Settings = Settings(), logistic: bool = True, weight: str | None = None) -> BoostedTrees:
    """Boosted trees over ``cols`` for a label of 0 and 1, or for a number with ``logistic=False``.

    Rows without a label take no part; without any row the model is a constant. A number's outputs start from
    its mean, a label's from even odds.
    """
    spark = df.sparkSession
    known = df.filter(F.col(label).isNotNull())
    edges = bin_edges(known, cols, settings.bins)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    start = 0.0 if logistic else known.agg(F.try_divide(F.sum(w * F.col(label)), F.sum(w))).first()[0] or 0.0
    base = known.select(F.col(label).cast("double").alias("y"), w.alias("weight"), F.xxhash64(key).alias("u"), F.lit(float(start)).alias("margin"), binned(edges).alias("x"))
    bins = max(len(e) for e in edges.values()) + 1
    rng = random.Random(settings.seed)
    trees: list[Tree] = []
    path = new_path(spark, "binned")
    # as few files as the rows ask for: a level is one short job over them
    base.coalesce(max(1, math.ceil(known.count() / TASK_ROWS))).write.parquet(path)
    held = 0
    for round_ in range(settings.rounds):
        rows = spark.read.schema(base.schema).parquet(path)
        columns = sorted(rng.sample(range(len(cols)), max(1, int(settings.columns * len(cols)))))
        trees.append(grow(rows, trees[held:], settings, len(cols), bins, logistic, round_, columns))
        if len(trees) - held == HELD_ROUNDS and round_ + 1 < settings.rounds:
            path, held = moved(rows, trees[held:], len(cols), path), len(trees)
    discard(spark, path)
    return BoostedTrees(edges, trees, float(start), logistic)


def moved(rows: DataFrame, trees: Sequence[Tree], width: int, path: str) -> str:
    """Write ``rows`` anew with the outputs of ``trees`` added; the old table goes."""

    def work(batches):
        for batch in batches:
            margin = outputs(trees, bins_matrix(batch.column("x"), width), batch.column("margin").to_numpy())
            columns = [pa.array(margin) if c == "margin" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fresh = new_path(rows.sparkSession, "binned")
    rows.mapInArrow(work, rows.schema).write.parquet(fresh)
    discard(rows.sparkSession, path)
    return fresh
