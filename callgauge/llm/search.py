"""Exact top-k search by inner product: queries and data are indexed together by cover trees.

Data are dealt to blocks of bounded size, by the nearest of a fixed number of pivots drawn from the
data and, within a pivot's cell, by hash, so that a cell with very many or equal vectors is several
blocks. Queries are dealt likewise. In each block a cover tree is built: balls within balls, radii
halving from level to level. A pair of nodes, one of queries and one of data, cannot beat

    <q, r> + radius_q |r| + radius_r |q| + radius_q radius_r

for the node centres q and r; if every query below already has k scores above that, the pair and
all below it are dropped. Pairs that stay are opened, the larger ball first, down to leaves, where
scores are formed exactly.

Two passes of the same join: each query block first meets the data block that promises the highest
score, which gives every query a k-th score to beat. Then it meets every other block whose bound is
not below the worst of them. Block pairs are decided from summaries (a row per block), and only a
bounded block of queries and of data are together at any time.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of
different length are not compared; ties go to the smaller id; a query never finds its own id;
repeated ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.registry import query, table
from callgauge.session import materialize

K = 5
PIVOTS = 32
BLOCK_ROWS = 4096
LEAF = 256
CHILDREN = 32


def usable(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x of a finite vector as floor(scale * x)."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.filter(x.isNotNull() & fine).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


# ---- inside a task ---------------------------------------------------------------------------------------------------


class Node:
    """A ball of a cover tree: the rows below it, their centre (one of them) and the radius that holds them."""

    __slots__ = ("centre", "radius", "rows", "children", "length")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int):
        self.centre, self.rows = centre, rows
        gap = points[rows] - points[centre]
        self.radius = float(np.sqrt((gap * gap).sum(1).max())) * (1 + 1e-12)
        self.length = float(np.sqrt((points[centre] ** 2).sum()))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray, leaf: int = LEAF, most: int = CHILDREN) -> Node:
    """Cover tree of all rows: below a ball, balls of half its radius around rows not covered yet.

    A ball that would need more than ``most`` such balls has no structure to prune by and stays a
    leaf, like one whose rows are all equal.
    """
    root = Node(points, np.arange(len(points)), 0)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        left, centre, reach, children = node.rows, node.centre, node.radius / 2, []
        while len(left) and len(children) < most:
            gap = points[left] - points[centre]
            inside = (gap * gap).sum(1) <= reach * reach
            children.append(Node(points, left[inside], centre))
            left = left[~inside]
            if len(left):
                centre = int(left[0])
        if not len(left):
            node.children = children
            todo += children
    return root


def merge_best(best: np.ndarray, best_ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Put the scores of ``rows`` against ``ids`` into the k best of each, ties to the smaller id."""
    k = best.shape[1]
    reach = best[rows, k - 1]
    if scores.shape[1] > k:
        reach = np.maximum(reach, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    at, column = np.nonzero((scores >= reach[:, None]) & (scores > -np.inf))
    if not len(at):
        return
    some = np.unique(at)
    owner = np.concatenate([at, np.repeat(some, k)])
    score = np.concatenate([scores[at, column], best[rows[some]].ravel()])
    name = np.concatenate([ids[column], best_ids[rows[some]].ravel()])
    order = np.lexsort((name, -score, owner))
    first = np.searchsorted(owner[order], some)
    take = order[first[:, None] + np.arange(k)]
    best[rows[some]], best_ids[rows[some]] = score[take], name[take]


def dual_search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int = K, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows of ``r`` for each row of ``q`` that reach ``floor``; also the scores formed.

    Unfilled places hold the score -inf. ``floor`` is a score known to be reached k times elsewhere.
    """
    best = np.full((len(q), k), -np.inf)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
    formed = 0
    todo = [(cover_tree(q, leaf), cover_tree(r, leaf))]
    while todo:
        a, b = todo.pop()
        bound = float(q[a.centre] @ r[b.centre]) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
        worst = float(np.maximum(best[a.rows, k - 1], floor[a.rows]).min())
        if bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 < worst:
            continue
        if not a.children and not b.children:
            for low in range(0, len(b.rows), 1024):
                rows = b.rows[low:low + 1024]
                scores = q[a.rows] @ r[rows].T
                formed += scores.size
                scores[q_ids[a.rows][:, None] == r_ids[rows][None, :]] = -np.inf
                merge_best(best, best_ids, a.rows, scores, r_ids[rows])
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            pairs = [(a, child) for child in b.children]
        else:
            pairs = [(child, b) for child in a.children]
        # the most promising pair last, so that it is taken next
        pairs.sort(key=lambda p: float(q[p[0].centre] @ r[p[1].centre]))
        todo += pairs
    return best, best_ids, formed


def exact(*blocks: np.ndarray) -> bool:
    """Whether all inner products of these whole numbers are exact in double precision."""
    most = [float(np.abs(b).max(initial=0)) for b in blocks]
    return most[0] * most[1] * blocks[0].shape[1] < 2.0**53


# ---- over the cluster ------------------------------------------------------------------------------------------------


def in_blocks(vectors: DataFrame, pivots: np.ndarray, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``dim``, ``cell`` (nearest pivot) and ``block``, no block holding many more than ``rows`` rows."""
    dims = {len(p): np.array([x for x in pivots if len(x) == len(p)], float) for p in pivots}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dim = batch["v"].map(len).to_numpy()
            cell = np.full(len(batch), -1)
            for d, known in dims.items():
                rows = np.flatnonzero(dim == d)
                if d and len(rows):
                    v = np.stack(batch["v"].iloc[rows].to_list()).astype(float)
                    cell[rows] = ((known * known).sum(1) - 2 * (v @ known.T)).argmin(1)
            yield batch.assign(dim=dim, cell=cell)

    celled = materialize(vectors.mapInPandas(nearest, "vec_id bigint, v array<bigint>, dim int, cell int"), "cells")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return celled.join(sizes, ["dim", "cell"]).withColumn("block", F.xxhash64("dim", "cell", part)).drop("parts")


def summaries(blocks: DataFrame) -> DataFrame:
    """A row per block: its mean, the radius around it, and the number of rows."""
    at = blocks.select("dim", "block", "v", F.posexplode("v").alias("i", "x"))
    means = at.groupBy("dim", "block", "i").agg(F.avg("x").alias("x")).groupBy("dim", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    gap = F.aggregate(F.zip_with("v", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return blocks.join(means, ["dim", "block"]).groupBy("dim", "block").agg(
        F.first("mean").alias("mean"), F.sqrt(F.max(gap)).alias("radius"), F.count("*").alias("n"))


def dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> F.Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def meet(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, vec_id, score) of the given pairs of blocks. ``queries`` may hold a floor."""
    left = queries.join(pairs.select("q_block", "pair"), "q_block").select("pair", "q_block", "query_id", "q", "floor")
    right = data.join(pairs.select("block", F.col("pair").alias("r_pair")), "block").select("r_pair", "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, r = np.array(left["q"].tolist(), float), np.array(right["v"].tolist(), float)
        q_ids, r_ids, floor = left["query_id"].to_numpy(), right["vec_id"].to_numpy(), left["floor"].to_numpy(float)
        if exact(q, r):
            scores, ids, _ = dual_search(q_ids, q, floor, r_ids, r, k)
        else:
            whole = np.array([[sum(int(x) * int(y) for x, y in zip(a, b)) for b in right["v"]] for a in left["q"]], object)
            rows = [sorted((-s, i) for s, i in zip(row, r_ids) if i != own)[:k] for row, own in zip(whole, q_ids)]
            return pd.DataFrame([(own, i, -s) for own, row in zip(q_ids, rows) for s, i in row], columns=["query_id", "vec_id", "score"])
        filled = np.isfinite(scores)
        owner = np.broadcast_to(q_ids[:, None], scores.shape)
        return pd.DataFrame({"query_id": owner[filled], "vec_id": ids[filled], "score": scores[filled].astype(np.int64)})

    return left.groupBy("pair").cogroup(right.groupBy("r_pair")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")


def top_k(data: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``data`` (vec_id, v) for each of ``queries`` (vec_id, v)."""
    drawn = [r["v"] for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    # no more cells than full blocks, so that few rows do not become many small pairs of blocks
    few = [max(1, min(pivots, df.count() // size)) for df, size in ((data, rows), (queries, rows // 4))]
    blocks = materialize(in_blocks(data, drawn[: few[0]], rows), "data-blocks")
    asked = materialize(in_blocks(queries, drawn[: few[1]], rows // 4), "query-blocks").select(
        "dim", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("block").alias("q_block"))
    theirs = summaries(asked.select("dim", F.col("q_block").alias("block"), F.col("q").alias("v")))
    ours = summaries(blocks)
    sides = ours.select("dim", "block", "mean", "radius").join(
        theirs.select("dim", F.col("block").alias("q_block"), F.col("mean").alias("q_mean"), F.col("radius").alias("q_radius")), "dim")
    middle = dot("mean", "q_mean")
    reach = middle + F.col("radius") * norm("q_mean") + F.col("q_radius") * norm("mean") + F.col("radius") * F.col("q_radius")
    bounds = materialize(sides.select("q_block", "block", middle.alias("middle"), (reach * 1.000001 + 1).alias("reach"),
                                      F.xxhash64("q_block", "block").alias("pair")), "block-pairs")
    first = bounds.groupBy("q_block").agg(F.max_by("block", F.struct("middle", "block")).alias("block"))
    first = materialize(first.withColumn("pair", F.xxhash64("q_block", "block")), "first-pairs")
    found = materialize(meet(first, asked.withColumn("floor", F.lit(float("-inf"))), blocks, k), "first-candidates")
    floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(
        "query_id", F.when(F.col("n") >= k, F.col("low").cast("double")).alias("floor"))
    again = materialize(asked.join(floors, "query_id", "left").fillna(float("-inf"), ["floor"]), "floored-queries")
    worst = again.groupBy("q_block").agg(F.min("floor").alias("worst"))
    rest = bounds.join(worst, "q_block").filter("reach >= worst").join(
        first.select(F.col("pair").alias("done")), F.col("pair") == F.col("done"), "left_anti").select("q_block", "block", "pair")
    both = found.unionByName(meet(rest, again, blocks, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM usable q JOIN usable r ON len(q.v) = len(r.v) AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query("op9_exact_top_k", ORACLE)
def op9_exact_top_k(spark, sf_dir):
    """The 5 best rows for every row whose id is divisible by 50."""
    data = materialize(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(data, data.filter("vec_id % 50 = 0"))
