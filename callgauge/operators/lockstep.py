"""Many boosted fits, and forests of many rows, at a time, in few Spark jobs.

A boosted fit is a chain, each level of each tree needs the one before, and a level is little work. Spark's own learner
starts jobs for each level of each fit; a search over folds and settings asks for tens of thousands. Here all fits that
are not done go on together, one job a step. A fit of more than ``TASK_ROWS`` rows lies in several tasks and grows by a
level: tasks add up counts and residuals by (node, column, bin), reducers, one for each stretch of nodes, add those tables
and take the cuts, and the next step moves the rows. A fit of fewer rows lies in one task, where the tables of its nodes are
whole: it grows by ``STEP_ROWS`` rows times trees, ``STEP_ROUNDS`` trees at least, without any exchange, and counts only the
smaller child of each node. Only cuts and trees reach the driver.
A forest (``Bagged``) grows in the same way, but in one task only; Spark's own learner has smaller and larger ones.

The trees are those of Spark's boosted classifier: labels of -1 and 1, regression trees on the residuals of the log
loss, cut where the variance falls most, first tree at full weight. Columns are cut at 31 places at most. Rows of a round are drawn by a
hash of their key, columns of a node by a hash of its place, so neither depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from callgauge.operators.boosting import ACCURACY, BoostedTrees, Tree, bins_matrix, drawn, outputs
from callgauge.session import discard, shared_folder

BINS = 32
#: Nodes of a fit whose tables one reducer call holds; rows, and rows times columns, that one task works on.
STRETCH = 64
TASK_ROWS = 2_000_000
TASK_CELLS = 64_000_000
#: Trees that a fit within one task grows in a step at least, rows times trees that it may pass over in one, and steps
#: after which the lineage is cut.
STEP_ROUNDS = 10
STEP_ROWS = 200 * TASK_ROWS
HELD_STEPS = 20
#: Gains that agree to so many digits are equal; then the first column and the lowest cut are taken.
DIGITS = 12
BLOCK_ROWS = 10_000
#: Rows of a fit in one task that are passed over at a time.
PART_ROWS = 131_072
#: Rows whose values are counted one by one to find the edges of bins.
COUNTED_ROWS = 10_000
POINTS = 1_000


class Boosted(NamedTuple):
    """Settings of a boosted fit; called, it is the fit itself."""

    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    min_rows: int = 1
    min_gain: float = 0.0

    def __call__(self, df: DataFrame, label: str, features: str) -> VectorTrees:
        return fit_lockstep([(self, df, label, features, None)])[0]


class Bagged(NamedTuple):
    """Settings of a forest: how often a row counts in a tree is a Poisson draw, a node may use ``columns`` of all, cuts lower
    the Gini impurity most. With ``balanced`` both classes weigh the same."""

    rounds: int = 100
    depth: int = 4
    balanced: bool = True
    columns: float = 1.0
    min_rows: int = 1
    min_gain: float = 0.0
    subsample: float = 1.0
    #: Weights of the two classes, found with the rows.
    weights: tuple[float, float] = (1.0, 1.0)


class VectorTrees:
    """Trees over the entries of a vector column: boosted ones, or a forest (``mean``), whose output is the mean of its leaves."""

    def __init__(self, trees: BoostedTrees, features: str, mean: bool = False):
        self.trees, self.features, self.mean = trees, features, mean

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        # bins are found beside the trees, of the whole vector: expressions for each edge of each column, and these for
        # each of many models, would take longer to compile than to run
        shared = df.sparkSession.sparkContext.broadcast((edge_arrays(self.trees.edges), self.trees.trees, self.trees.start))
        mean = self.mean

        @F.pandas_udf("double")
        def out(x: pd.Series) -> pd.Series:
            edges, trees, start = shared.value
            if not len(x):
                return pd.Series([], dtype="float64")
            missing = np.full(len(edges), np.nan)
            bins = bins_of(np.stack([missing if v is None else v for v in x]), edges)
            out = outputs(trees, bins, np.full(len(x), start))
            return pd.Series(out / len(trees) if mean else 1 / (1 + np.exp(-out)))

        return df.withColumn(name, out(vector_to_array(self.features)))


# ---------------------------------------------------------------- rows


def middles(counts: Sequence[tuple[float, int]], bins: int) -> list[float]:
    """Middles between neighbours of the sorted values, all of them or, if there are too many, those nearest to even shares of the rows."""
    values, sizes = [v for v, _ in counts], [n for _, n in counts]
    between = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(between) < bins:
        return between
    share = sum(sizes) / bins
    out, target, seen = [], share, sizes[0]
    for k, n in enumerate(sizes[1:]):
        if abs(seen - target) < abs(seen + n - target):
            out.append(between[k])
            target += share
        seen += n
    return out


def vector_edges(df: DataFrame, features: str, bins: int = BINS) -> tuple[int, dict[str, list[float]]]:
    """Number of rows, and for every entry of a vector column the edges of its bins."""
    return edges_of_sets([(df, features)], bins)[0]


def edges_of_sets(sets: Sequence[tuple[DataFrame, str]], bins: int = BINS, middle: frozenset[int] = frozenset()) -> list[tuple[int, dict[str, list[float]]]]:
    """The same for each of many (rows, vector column), in as many jobs as for one.

    Few rows are counted by value and cut in the middle between values, as Spark's trees do; of more rows, which these would
    sample, the values at the inner quantiles of all rows are taken, or, for the sets in ``middle``, middles between values
    at ``POINTS`` quantiles, so that many equal values do not take the place of other cuts.
    """
    vectors = [df.select(F.lit(i).alias("i"), vector_to_array(features).alias("x")) for i, (df, features) in enumerate(sets)]
    together = lambda which: reduce(DataFrame.unionByName, [vectors[i] for i in which])
    size = {i: (n, width) for i, n, width in together(range(len(sets))).groupBy("i").agg(F.count(F.lit(1)), F.max(F.size("x"))).collect()}
    if len(size) < len(sets):
        raise ValueError("no rows to fit")
    few = [i for i, (n, _) in size.items() if n <= COUNTED_ROWS]
    many = [i for i, (n, _) in size.items() if n > COUNTED_ROWS]
    out = {}
    if few:
        counts = together(few).select("i", F.posexplode("x").alias("k", "v")).groupBy("i", "k", "v").agg(F.count(F.lit(1)).alias("n"))
        found = {(i, k): c for i, k, c in counts.groupBy("i", "k").agg(F.sort_array(F.collect_list(F.struct("v", "n")))).collect()}
        out |= {i: [middles(found[i, k], min(bins, size[i][0])) for k in range(size[i][1])] for i in few}
    for some, points, cut in ((set(many) - middle, bins, lambda e: sorted(set(e))), (set(many) & middle, POINTS, lambda e: middles(sorted(Counter(e).items()), bins))):
        if some:
            cuts = F.array(*[F.lit(i / points) for i in range(1, points)])
            widest = max(size[i][1] for i in some)
            entries = [F.percentile_approx(F.get("x", F.lit(k)), cuts, F.lit(ACCURACY)) for k in range(widest)]
            out |= {i: [cut(e) for e in found[:size[i][1]]] for i, *found in together(sorted(some)).groupBy("i").agg(*entries).collect()}
    return [(size[i][0], {f"__x{k}": e for k, e in enumerate(out[i])}) for i in range(len(sets))]


def edge_arrays(edges: dict[str, list[float]]) -> list[np.ndarray]:
    return [np.array(e, float) for e in edges.values()]


def bins_of(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each entry of the rows ``x``: how many edges of its column lie below it; -1 if missing."""
    out = np.empty(x.shape, np.int16)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), -1, np.searchsorted(e, x[:, k]))
    return out


def blocks(df: DataFrame, label: str, features: str, key: str | None, edges: dict[str, list[float]]) -> DataFrame:
    """Rows as blocks of bytes: bins, labels and a number that draws are made from."""
    x, y = vector_to_array(features), F.col(label).cast("int")
    y = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit("labels must be 0 or 1")))
    u = F.xxhash64(x, y) if key is None else F.xxhash64(key)
    cuts = edge_arrays(edges)

    def work(batches):
        for batch in batches:
            for part in (batch.slice(i, BLOCK_ROWS) for i in range(0, batch.num_rows, BLOCK_ROWS)):
                yield pa.RecordBatch.from_pydict({
                    "x": [bins_of(bins_matrix(part.column("x"), len(cuts)), cuts).astype(np.uint8).tobytes()],
                    "y": [part.column("y").to_numpy().astype(np.int8).tobytes()], "u": [part.column("u").to_numpy().tobytes()],
                })

    return df.select(y.alias("y"), u.alias("u"), x.alias("x")).mapInArrow(work, "x binary, y binary, u binary")


class Block(NamedTuple):
    """Rows of one fit: where they stand (place in the level, -1: settled), twice their output, trees grown in the last step."""

    fit: int
    x: np.ndarray
    y: np.ndarray
    u: np.ndarray
    node: np.ndarray
    margin: np.ndarray
    trees: Sequence[Tree] = ()


def task_rows(width: int) -> int:
    """Rows of so many columns that one task works on."""
    return max(1, min(TASK_ROWS, TASK_CELLS // max(1, width)))


def deal(sets: Sequence[DataFrame], users: dict[int, list[int]], parts: Sequence[int], order: Sequence[int]) -> RDD:
    """Every block of a set once for each fit that uses it, those of a fit evenly over its ``parts`` tasks and joined there.

    Tasks come in the ``order`` of their fits.
    """
    *begins, total = np.cumsum([0, *[parts[fit] for fit in order]]).tolist()
    first = dict(zip(order, begins))

    def copies(part, rows):
        for k, (i, x, y, u) in enumerate(rows):
            u, y = np.frombuffer(u, np.int64), np.frombuffer(y, np.int8)
            x = np.frombuffer(x, np.uint8).reshape(len(u), -1)
            for fit in users[i]:
                yield first[fit] + (part + k) % parts[fit], (fit, x, y, u)

    def joined(rows):
        found = list(rows)
        if found:
            x, y, u = (np.concatenate([b[k] for _, b in found]) for k in (1, 2, 3))
            yield Block(found[0][1][0], x, y * 2.0 - 1.0, u, np.zeros(len(u), np.int32), np.zeros(len(u)))

    named = [d.select(F.lit(i).alias("i"), "x", "y", "u").rdd for i, d in enumerate(sets)]
    return named[0].context.union(named).mapPartitionsWithIndex(copies).partitionBy(total, lambda place: place).mapPartitions(joined)


# ---------------------------------------------------------------- one step


class Cuts(NamedTuple):
    """What became of the nodes of a level: bins up to ``cut`` go left; children's places (-1: settled) and what they add."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    left_value: np.ndarray
    right_value: np.ndarray
    next_round: bool


class Level(NamedTuple):
    """What a fit asks of the next job."""

    settings: Boosted | Bagged
    round_: int
    depth: int
    nodes: int
    width: int


def move(block: Block, cuts: Cuts) -> Block:
    """The rows after the cuts of their level."""
    at = np.flatnonzero(block.node >= 0)
    place = block.node[at]
    to_left = block.x[at, cuts.column[place]] <= cuts.cut[place]
    child = np.where(to_left, cuts.left[place], cuts.right[place])
    margin, node = block.margin.copy(), np.zeros(len(block.node), np.int32)
    # rows that go further down still have the output their residual is made of
    margin[at] += np.where(child < 0, np.where(to_left, cuts.left_value[place], cuts.right_value[place]), 0.0)
    if not cuts.next_round:
        node[:] = -1
        node[at] = child
    return block._replace(node=node, margin=margin)


def residuals(y: np.ndarray, margin: np.ndarray, round_: int) -> np.ndarray:
    if round_ == 0:
        return y
    with np.errstate(over="ignore"):
        return 4 * y / (1 + np.exp(y * margin))


def sums(block: Block, level: Level) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Counts and sums of residuals by (node, column, bin), a table for each stretch of nodes."""
    keep = np.flatnonzero((block.node >= 0) & drawn(block.u, level.round_, level.settings.subsample))
    if not len(keep):
        return
    r = residuals(block.y, block.margin, level.round_)[keep]
    first = block.node[keep].astype(np.int64) * BINS
    x = block.x[keep]
    out = np.empty((level.nodes, level.width, BINS, 2))
    for k in range(level.width):
        at = first + x[:, k]
        for i, weight in enumerate((None, r)):
            out[:, k, :, i] = np.bincount(at, weight, level.nodes * BINS).reshape(level.nodes, BINS)
    for k in range(0, level.nodes, STRETCH):
        yield (block.fit, k), out[k:k + STRETCH]


def open_columns(level: Level, first: int, n: int) -> np.ndarray:
    """Which columns each of ``n`` nodes may use: those with the smallest hashes."""
    take = max(1, min(level.width, math.ceil(level.settings.columns * level.width - 1e-9)))
    if take == level.width:
        return np.ones((n, level.width), bool)
    with np.errstate(over="ignore"):
        place = (np.uint64(level.round_ * 64 + level.depth + 1) << np.uint64(32)) + np.arange(first, first + n, dtype=np.uint64)
        x = (place[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, level.width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.argsort(np.argsort(x, axis=1, kind="stable"), axis=1) < take


def purer(s: Bagged, n: np.ndarray, r: np.ndarray, all_n: np.ndarray, all_r: np.ndarray) -> np.ndarray:
    """By how much a cut lowers the Gini impurity: rows and positives of the left side and of all."""
    def squares(n, r):
        a, b = s.weights[0] * (n - r), s.weights[1] * r
        return (a**2 + b**2) / (a + b), a + b

    (whole, weight), (left, _), (right, _) = squares(all_n, all_r), squares(n, r), squares(all_n - n, all_r - r)
    return (left + right - whole) / weight


def best_cuts(table: np.ndarray, level: Level, first: int) -> np.ndarray:
    """Of each node: column (-1: none gains enough), cut, rows and sum of all, rows and sum of the left side."""
    s = level.settings
    n, r = (np.cumsum(table[..., i], axis=2) for i in (0, 1))
    all_n, all_r = n[:, :1, -1:], r[:, :1, -1:]
    n, r = n[..., :-1], r[..., :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = purer(s, n, r, all_n, all_r) if isinstance(s, Bagged) else (r**2 / n + (all_r - r) ** 2 / (all_n - n) - all_r**2 / all_n) / all_n
    low = max(s.min_rows, 1)
    ok = (n >= low) & (all_n - n >= low) & open_columns(level, first, len(table))[:, :, None]
    gain = np.where(ok, np.round(gain, DIGITS), -np.inf).reshape(len(table), -1)
    at = np.argmax(gain, axis=1)
    rows = np.arange(len(table))
    found = (gain[rows, at] > 0) & (gain[rows, at] >= s.min_gain)
    column, cut = np.divmod(at, BINS - 1)
    return np.stack([np.where(found, column, -1), cut, all_n[:, 0, 0], all_r[:, 0, 0], n[rows, column, cut], r[rows, column, cut]], axis=1)


def no_cuts(level: Level) -> np.ndarray:
    """What nodes without any row come to."""
    out = np.zeros((level.nodes, 6))
    out[:, 0] = -1
    return out


class Growing:
    """A fit that grows: its trees after the ``earlier`` ones, and the level that the last has come to."""

    def __init__(self, settings: Boosted | Bagged, width: int, earlier: int = 0):
        self.settings, self.width, self.earlier = settings, width, earlier
        self.trees: list[Tree] = []
        self.start()

    @property
    def round_(self) -> int:
        return self.earlier + len(self.trees)

    def start(self) -> None:
        self.depth, self.ids = 0, np.zeros(1, np.int64)
        self.column, self.cut, self.value, self.left, self.right = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.full(1, -1), np.full(1, -1)

    @property
    def weight(self) -> float:
        """What the mean of a leaf counts for."""
        return 1.0 if isinstance(self.settings, Bagged) else 2.0 * (self.settings.rate if self.round_ else 1.0)

    @property
    def done(self) -> bool:
        return self.round_ >= self.settings.rounds

    def level(self) -> Level:
        return Level(self.settings, self.round_, self.depth, len(self.ids), self.width)

    def take(self, found: np.ndarray) -> Cuts:
        """Write the cuts of a level down and say where its rows go."""
        column, cut = found[:, 0].astype(np.int64), found[:, 1].astype(np.int64)
        n, r = np.stack([found[:, 4], found[:, 2] - found[:, 4]], 1), np.stack([found[:, 5], found[:, 3] - found[:, 5]], 1)
        weight = self.weight
        own = weight * np.divide(found[:, 3], found[:, 2], out=np.zeros(len(found)), where=found[:, 2] > 0)
        split = column >= 0
        value = np.repeat(own[:, None], 2, 1)
        value[split] = weight * r[split] / n[split]
        children = np.full((len(found), 2), -1)
        children[split] = len(self.column) + np.arange(2 * split.sum()).reshape(-1, 2)
        self.value[self.ids] = own
        self.column[self.ids], self.cut[self.ids] = np.where(split, column, 0), np.where(split, cut, 0)
        self.left[self.ids], self.right[self.ids] = children.T
        fresh = 2 * split.sum()
        for name, empty in (("column", 0), ("cut", 0), ("left", -1), ("right", -1)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(fresh, empty)]))
        self.value = np.concatenate([self.value, value[split].reshape(-1)])
        self.depth += 1
        # a node with fewer rows than two sides need is a leaf
        further = split[:, None] & (n >= 2 * max(self.settings.min_rows, 1)) & (self.depth < self.settings.depth)
        place = np.where(further, np.cumsum(further.reshape(-1)).reshape(-1, 2) - 1, -1).astype(np.int32)
        self.ids = children[further]
        ended = not len(self.ids)
        cuts = Cuts(np.where(split, column, 0).astype(np.int16), np.where(split, cut, 0).astype(np.int16), *place.T.copy(), *value.T.copy(), ended)
        if ended:
            column, cut, left, right = (a.astype(kind) for a, kind in ((self.column, np.int32), (self.cut, np.int16), (self.left, np.int32), (self.right, np.int32)))
            self.trees.append(Tree(column, cut, np.ones(len(column), bool), left, right, self.value))
            self.start()
        return cuts


class Route(NamedTuple):
    """Where the rows of a level go: the column of each node, by (node, bin) what becomes of a row, and for each such fate
    (children that are cut further by their places, then those that are settled) what it adds and its place among the
    children that are counted (-1: not counted)."""

    column: np.ndarray
    fate: np.ndarray
    further: int
    value: np.ndarray
    counted: np.ndarray


def route(cuts: Cuts, found: np.ndarray) -> tuple[Route, np.ndarray, np.ndarray]:
    """The way of a level's rows; the nodes of which a child is cut further, and the side of each that is counted.

    Only the side with fewer rows is; the other is what is left of the node.
    """
    fate = np.stack([cuts.left, cuts.right], 1).astype(np.int64)
    ends = fate < 0
    further = int((~ends).sum())
    fate[ends] = further + np.arange(ends.sum())
    value, counted = np.zeros(fate.size), np.full(fate.size, -1)
    value[fate.ravel()] = np.stack([cuts.left_value, cuts.right_value], 1).ravel()
    node = np.flatnonzero(~ends.all(axis=1))
    side = (found[node, 4] > found[node, 2] - found[node, 4]).astype(np.int64)
    counted[fate[node, side]] = np.arange(len(node))
    by_bin = np.where(np.arange(BINS) <= cuts.cut[:, None], fate[:, :1], fate[:, 1:])
    return Route(cuts.column.astype(np.int64), by_bin.ravel(), further, value, counted), node, side


class Part:
    """Some rows of a fit that lies in one task, few enough for a processor's cache."""

    def __init__(self, x: np.ndarray, y: np.ndarray, u: np.ndarray, margin: np.ndarray):
        self.x, self.columns, self.y, self.u, self.margin = x.ravel(), np.ascontiguousarray(x.T), y, u, margin
        self.pairs = self.columns[0:-1:2].astype(np.int16) * BINS + self.columns[1::2]
        self.first = np.arange(len(y)) * x.shape[1]

    def start(self, round_: int, share: float) -> None:
        """All rows stand at the root; those that are not drawn wait until the tree is grown."""
        self.r = residuals(self.y, self.margin, round_)
        taken = drawn(self.u, round_, share)
        self.at, self.left_out = np.flatnonzero(taken), np.flatnonzero(~taken)
        self.place = np.zeros(len(self.at), np.int64)

    def fates(self, way: Route, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return way.fate[place * BINS + self.x[self.first[at] + way.column[place]]]

    def settle(self, way: Route, at: np.ndarray, fate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of what goes further, once the output of the others is added."""
        if way.further == len(way.value):
            return at, fate
        ends = fate >= way.further
        self.margin[at[ends]] += way.value[fate[ends]]
        return at[~ends], fate[~ends]

    def count(self, at: np.ndarray, place: np.ndarray | None, out: np.ndarray) -> None:
        """Add counts and sums of residuals of the rows, by column and (place, bin), to ``out``."""
        r, nodes = self.r[at], out.shape[2] // BINS
        # two columns are counted at a time where their cells are fewer than the rows
        two = len(self.pairs) if nodes * BINS**2 <= len(at) else 0
        for k in range(two):
            cell = self.pairs[k][at] if place is None else place * BINS**2 + self.pairs[k][at]
            for total, weight in zip(out, (None, r)):
                both = np.bincount(cell, weight, nodes * BINS**2).reshape(nodes, BINS, BINS)
                total[2 * k] += both.sum(axis=2).ravel()
                total[2 * k + 1] += both.sum(axis=1).ravel()
        for k, column in enumerate(self.columns[2 * two:], 2 * two):
            cell = column[at] if place is None else place * BINS + column[at]
            for total, weight in zip(out, (None, r)):
                total[k] += np.bincount(cell, weight, nodes * BINS)

    def go(self, way: Route, out: np.ndarray) -> None:
        """One level down; rows of children that are counted are added to ``out``."""
        fate = self.fates(way, self.at, self.place)
        if out.size:
            place = way.counted[fate]
            some = np.flatnonzero(place >= 0)
            self.count(self.at[some], place[some], out)
        self.at, self.place = self.settle(way, self.at, fate)

    def finish(self, ways: Sequence[Route]) -> None:
        """The rows that were not drawn go down the whole tree."""
        at, place = self.left_out, np.zeros(len(self.left_out), np.int64)
        for way in ways if len(at) else ():
            at, place = self.settle(way, at, self.fates(way, at, place))


class BaggedPart(Part):
    """The same for a forest, whose trees do not need the outputs of those before."""

    def __init__(self, x: np.ndarray, y: np.ndarray, u: np.ndarray, margin: np.ndarray):
        super().__init__(x, y, u, margin)
        # a bin and its row's label in one number
        self.columns, self.pairs = ((a * 2 + (y > 0)).astype(kind) for a, kind in ((self.columns, np.uint8), (self.pairs, np.int16)))

    def start(self, round_: int, share: float) -> None:
        times = poisson(self.u, round_)
        self.at = np.flatnonzero(times)
        self.r, self.place = times.astype(float), np.zeros(len(self.at), np.int64)

    def settle(self, way: Route, at: np.ndarray, fate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if way.further == len(way.value):
            return at, fate
        goes = fate < way.further
        return at[goes], fate[goes]

    def count(self, at: np.ndarray, place: np.ndarray | None, out: np.ndarray) -> None:
        r, nodes = self.r[at], out.shape[2] // BINS
        two = len(self.pairs) if nodes * BINS**2 <= len(at) else 0

        def tables(codes: np.ndarray, cells: int) -> np.ndarray:
            code = codes[at] if place is None else place * (cells * 2) + codes[at]
            n = np.bincount(code, r, nodes * cells * 2).reshape(-1, 2)
            return np.stack([n[:, 0] + n[:, 1], n[:, 1]])

        for k in range(two):
            both = tables(self.pairs[k], BINS**2).reshape(2, nodes, BINS, BINS)
            out[:, 2 * k] += both.sum(axis=3).reshape(2, -1)
            out[:, 2 * k + 1] += both.sum(axis=2).reshape(2, -1)
        for k in range(2 * two, len(self.columns)):
            out[:, k] += tables(self.columns[k], BINS)

    def finish(self, ways: Sequence[Route]) -> None:
        pass


#: Shares of draws of mean 1 that are 0, at most 1, and so on.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson(u: np.ndarray, round_: int) -> np.ndarray:
    """How often each row counts in a round: a draw of mean 1 from a hash of its number ``u`` and the round."""
    with np.errstate(over="ignore"):
        x = u.view(np.uint64) + np.uint64(round_ + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    out = np.zeros(len(u), np.int8)
    for share in POISSON:
        more = x >= np.uint64(int(share * 2**53))
        if not more.any():
            break
        out += more
    return out


def leaf_shares(tree: Tree, weights: tuple[float, float]) -> Tree:
    """Leaves hold the weighted share of positives; as in Spark's forests, leaves side by side that say the same class become one."""
    share = weights[1] * tree.value / (weights[1] * tree.value + weights[0] * (1 - tree.value))
    left, right = tree.left.copy(), tree.right.copy()
    while True:
        inner = np.flatnonzero(left >= 0)
        a, b = left[inner], right[inner]
        same = inner[(left[a] < 0) & (left[b] < 0) & ((share[a] > 0.5) == (share[b] > 0.5))]
        if not len(same):
            break
        left[same] = right[same] = -1
    # nodes that nothing leads to any more are left out
    kept, at = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
    while len(at := at[left[at] >= 0]):
        kept.append(at := np.concatenate([left[at], right[at]]).astype(np.int64))
    keep = np.sort(np.concatenate(kept))
    place = np.full(len(left), -1, np.int32)
    place[keep] = np.arange(len(keep))
    left, right = (np.where(c[keep] >= 0, place[c[keep]], -1).astype(np.int32) for c in (left, right))
    return Tree(tree.column[keep], tree.cut[keep], tree.missing_left[keep], left, right, share[keep])


def node_tables(sums_: np.ndarray) -> np.ndarray:
    """Tables (place, column, bin, count and sum) of what ``Part.count`` has added up."""
    return sums_.reshape(2, sums_.shape[1], -1, BINS).transpose(2, 1, 3, 0)


def grow_tree(fit: Growing, parts: Sequence[Part]) -> None:
    level, ways = fit.level(), []
    for p in parts:
        p.start(level.round_, level.settings.subsample)
    out = np.zeros((2, level.width, BINS))
    for p in parts:
        p.count(p.at, None, out)
    tables = node_tables(out)
    while True:
        found = np.concatenate([best_cuts(tables[k:k + STRETCH], level, k) for k in range(0, level.nodes, STRETCH)])
        found = np.where(found[:, 2:3] > 0, found, no_cuts(level))
        cuts = fit.take(found)
        way, node, side = route(cuts, found)
        ways.append(way)
        out = np.zeros((2, level.width, len(node) * BINS))
        for p in parts:
            p.go(way, out)
        if cuts.next_round:
            break
        some, above, level = node_tables(out), tables, fit.level()
        places = np.stack([cuts.left, cuts.right], 1)[node]
        one, other = places[np.arange(len(node)), side], places[np.arange(len(node)), 1 - side]
        tables = np.empty((level.nodes, level.width, BINS, 2))
        tables[one[one >= 0]] = some[one >= 0]
        tables[other[other >= 0]] = (above[node] - some)[other >= 0]
        # sums of no rows are nothing, not what rounding leaves
        tables[..., 1][tables[..., 0] == 0] = 0.0
    for p in parts:
        p.finish(ways)


def grown(block: Block, level: Level) -> Block:
    """A fit whose rows are all here, some trees further."""
    settings, kind = level.settings, Part
    if isinstance(settings, Bagged):
        positive = int((block.y > 0).sum())
        counts = (len(block.y) - positive, positive)
        if settings.balanced:
            settings = settings._replace(weights=tuple(len(block.y) / (sum(c > 0 for c in counts) * c) if c else 1.0 for c in counts))
        kind = BaggedPart
    fit = Growing(settings, level.width, level.round_)
    rounds = max(STEP_ROUNDS, STEP_ROWS // len(block.y))
    margin = block.margin.copy()
    cuts = [slice(k, k + PART_ROWS) for k in range(0, len(margin), PART_ROWS)]
    parts = [kind(block.x[c], block.y[c], block.u[c], margin[c]) for c in cuts]
    while not fit.done and len(fit.trees) < rounds:
        grow_tree(fit, parts)
        if kind is BaggedPart:
            fit.trees[-1] = leaf_shares(fit.trees[-1], settings.weights)
    if fit.done:  # its rows are not needed again
        return Block(block.fit, block.x[:0].copy(), *(a[:0].copy() for a in (block.y, block.u, block.node, margin)), fit.trees)
    return block._replace(margin=margin, trees=fit.trees)


def step(state: RDD, moves: dict[int, Cuts], levels: dict[int, Level], whole: set[int]) -> tuple[RDD, Callable[[], tuple[dict[int, np.ndarray], dict[int, Sequence[Tree]]]]]:
    """The rows after ``moves``, those of ``whole`` fits some trees further, and the jobs that find cuts of ``levels`` and these trees."""
    def moved(rows):
        for b in rows:
            if b.fit in levels:
                yield grown(b, levels[b.fit]) if b.fit in whole else move(b, moves[b.fit]) if b.fit in moves else b

    def cuts(item):
        (fit, first), table = item
        return fit, first, best_cuts(table, levels[fit], first)

    fresh = state.mapPartitions(moved).persist()

    def run() -> tuple[dict[int, np.ndarray], dict[int, Sequence[Tree]]]:
        trees = dict(fresh.filter(lambda b: b.fit in whole).map(lambda b: (b.fit, b.trees)).collect()) if whole & levels.keys() else {}
        found = {fit: no_cuts(level) for fit, level in levels.items() if fit not in whole}
        if found:
            tables = fresh.filter(lambda b: b.fit not in whole).flatMap(lambda b: sums(b, levels[b.fit]))
            for fit, first, some in tables.reduceByKey(np.add, fresh.getNumPartitions()).map(cuts).collect():
                found[fit][first:first + len(some)] = some
        return found, trees

    return fresh, run


def fit_lockstep(asked: Sequence[tuple[Boosted | Bagged, DataFrame, str, str, str | None]]) -> list[VectorTrees]:
    """Models of all (settings, rows, label, features, key or nothing), grown together."""
    spark = asked[0][1].sparkSession
    shared_folder(spark)
    # settings that are fitted to the same rows share their blocks
    sets: dict[tuple, tuple] = {}
    users: dict[int, list[int]] = {}
    for fit, (settings, df, label, features, key) in enumerate(asked):
        place, *_ = sets.setdefault((id(df), label, features, key, isinstance(settings, Bagged)), (len(sets), df, label, features, key))
        users.setdefault(place, []).append(fit)
    found = edges_of_sets([(df, features) for _, df, _, features, _ in sets.values()], middle=frozenset(i for i, (*_, bagged) in enumerate(sets) if bagged))
    prepared = [(n, edges, blocks(df, label, features, key, edges)) for (n, edges), (_, df, label, features, key) in zip(found, sets.values())]
    edges_of = {fit: prepared[place][1] for place, fits in users.items() for fit in fits}
    rows = {fit: prepared[place][0] for place, fits in users.items() for fit in fits}
    parts = [math.ceil(rows[fit] / task_rows(len(edges_of[fit]))) for fit in range(len(asked))]
    whole = {fit for fit, n in enumerate(parts) if n == 1}
    if any(isinstance(asked[fit][0], Bagged) for fit in set(range(len(asked))) - whole):
        raise ValueError(f"forests of over {TASK_ROWS} rows are not grown here")
    # tasks begin in their order: the longest first
    order = sorted(range(len(asked)), key=lambda fit: -rows[fit] / parts[fit] * asked[fit][0].rounds * asked[fit][0].depth * len(edges_of[fit]))
    state = deal([b for *_, b in prepared], users, parts, order)
    growing = [Growing(settings, len(edges_of[fit])) for fit, (settings, *_) in enumerate(asked)]
    moves: dict[int, Cuts] = {}
    held, old, steps = [], None, 0
    while levels := {fit: g.level() for fit, g in enumerate(growing) if not g.done}:
        state, run = step(state, moves, levels, whole)
        held.append(state)
        steps += 1
        cut = steps % HELD_STEPS == 0
        if cut:
            state.checkpoint()
        found, trees = run()
        moves = {fit: growing[fit].take(f) for fit, f in found.items()}
        for fit, some in trees.items():
            growing[fit].trees += some
        for before in held[:-1]:
            before.unpersist()
        held = held[-1:]
        if cut:
            if old:
                discard(spark, old)
            old = state.getCheckpointFile()
    for before in held:
        before.unpersist()
    if old:
        discard(spark, old)
    return [VectorTrees(BoostedTrees(edges_of[fit], g.trees, 0.0, True), asked[fit][3], isinstance(asked[fit][0], Bagged)) for fit, g in enumerate(growing)]
