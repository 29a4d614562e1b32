"""Order statistics of many columns by mergeable sketches: exact, without shuffling or collecting values.

A KLL sketch of each column brackets every wanted rank. A scan then counts exactly what lies below, at and between the
ends of each bracket. A rank at an end is settled by the counts; for one between them the next scan sketches what lies
strictly between, until so few values are left that their sketch holds all of them. Each round leaves a share of
``2 * SLACK`` of a bracket: one settles a million rows, three settle 10**12. A rank that its bracket missed, which the
counts show, is looked for on that side of it: chance decides on the number of scans, not on results. Only sketches
and counts leave a task.

Sketches also merge over batches: ``quantile_sketches`` makes a small table, ``merge_sketches`` adds up several, and
``sketch_quantiles`` reads them or ``exact_quantiles`` starts from them instead of its first scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.numeric import finite

#: Values a sketch holds at its last level; up to as many it holds exactly.
K = 4096
#: Share of ranks a sketch errs by, in 99 of 100 cases (the published fit for KLL sketches).
RANK_ERROR = 2.296 / K**0.9723
#: What brackets allow for.
SLACK = 2 * RANK_ERROR
#: Tasks that merge sketches before the last one does.
MERGERS = 32


def _sketch(value: Column) -> Column:
    return F.kll_sketch_agg_double(value, K)


def _quantile(sketch: str, rank: Column) -> Column:
    """A rank (or an array of them), of a sketch that may be empty."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, rank))


def quantile_sketches(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, sketch) of the finite values of each column, all in one pass; a batch's part of a table that grows."""
    cols = list(cols)
    here = F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("__part")
    parts = df.groupBy(here).agg(*[_sketch(finite(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(cols)])
    row = parts.agg(*[F.kll_merge_agg_double(f"s{i}", K).alias(f"s{i}") for i in range(len(cols))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])))


def merge_sketches(tables: Iterable[DataFrame]) -> DataFrame:
    """(column, sketch) over all batches."""
    return reduce(DataFrame.unionByName, tables).groupBy("column").agg(F.kll_merge_agg_double("sketch", K).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, ps: Sequence[float]) -> DataFrame:
    """(column, count, quantiles): values whose ranks are off by ``RANK_ERROR`` of the rows or so; null without values."""
    at = F.array(*[F.lit(float(p)) for p in ps])
    return sketches.select("column", F.kll_sketch_get_n_double("sketch").alias("count"), _quantile("sketch", at).alias("quantiles"))


@dataclass
class _Wanted:
    """Ranks of one column (from 0) and what is known of them: all open ones lie between ``low`` and ``high`` or outside."""

    column: int
    ranks: set[int]
    low: float = -math.inf
    high: float = math.inf
    found: dict[int, float] = field(default_factory=dict)

    @property
    def open(self) -> list[int]:
        return sorted(self.ranks - self.found.keys())


def _around(ranks: Sequence[int], n: int) -> tuple[float, float]:
    """Shares of ``n`` values between which a sketch has all of ``ranks``; no slack where it is exact."""
    slack = SLACK if n > K else 0.0
    return (ranks[0] + 0.5) / n - slack, (ranks[-1] + 0.5) / n + slack


def order_statistics(
    df: DataFrame, cols: Sequence[str], ps: Sequence[float], sketches: DataFrame | None = None,
) -> dict[str, list[tuple[float, float, float] | None]]:
    """For each column and share: the values on both sides of that rank and how far between them it is."""
    cols, ps = list(cols), list(ps)
    if not cols:
        return {}
    number = [finite(F.col(f"`{c}`")) for c in cols]
    first = quantile_sketches(df, cols) if sketches is None else sketches.filter(F.col("column").isin(cols))
    sizes = first.select("column", "sketch", F.kll_sketch_get_n_double("sketch").alias("n")).persist()
    try:
        counts = {r["column"]: r["n"] for r in sizes.select("column", "n").collect()}
        wanted, shares = [], {c: [] for c in cols}
        for i, c in enumerate(cols):
            for p in ps if counts.get(c) else []:
                at = p * (counts[c] - 1)
                w = _Wanted(i, {math.floor(at), math.ceil(at)})
                wanted.append(w)
                shares[c].append((w, *_around(w.open, counts[c])))
        at = {c: F.array(*[F.lit(min(max(s, 0.0), 1.0)) for _, a, b in shares[c] for s in (a, b)]) for c in cols if shares[c]}
        values = F.coalesce(F.lit(None).cast("array<double>"), *[F.when(F.col("column") == c, _quantile("sketch", ranks)) for c, ranks in at.items()])
        read = sizes.select("column", values.alias("v")).collect()
    finally:
        sizes.unpersist()
    ends = {r["column"]: r["v"] for r in read}
    for c in cols:
        for k, (w, a, b) in enumerate(shares[c]):
            w.low, w.high = (-math.inf if a <= 0 else ends[c][2 * k]), (math.inf if b >= 1 else ends[c][2 * k + 1])
    while todo := [w for w in wanted if w.open]:
        _narrow(df, number, todo)
    out: dict[str, list[tuple[float, float, float] | None]] = {}
    for i, c in enumerate(cols):
        mine = iter([w for w in wanted if w.column == i])
        out[c] = []
        for p in ps:
            w = next(mine, None)
            at = p * (counts[c] - 1) if w else 0.0
            out[c].append((w.found[math.floor(at)], w.found[math.ceil(at)], at - math.floor(at)) if w else None)
    return out


def _place(ends: Sequence[float], v: Column) -> Column:
    """2 j between end j - 1 and end j, 2 j + 1 at end j."""
    return reduce(lambda x, y: x + y, [(v > e).cast("int") + (v >= e).cast("int") for e in ends], F.lit(0))


def _class_counts(values: DataFrame, ends: dict[int, list[float]]) -> dict[int, list[int]]:
    """For each column how many values lie below its first end, at it, between it and the second, and so on."""
    classes = []
    for i, cuts in ends.items():
        classes.append(F.struct(F.lit(i).alias("i"), _place(cuts, F.col(f"v{i}")).alias("place")))
    counted = values.select(F.inline(F.array(*classes))).filter("place IS NOT NULL").groupBy("i", "place").agg(F.count(F.lit(1)).alias("n"))
    out = {i: [0] * (2 * len(cuts) + 1) for i, cuts in ends.items()}
    for r in counted.collect():  # at most two rows an end, and one a column
        out[r["i"]][r["place"]] = r["n"]
    return out


def _narrow(df: DataFrame, number: Sequence[Column], todo: Sequence[_Wanted]) -> None:
    """One scan counts and settles the ranks at the ends of their bracket, one sketches what lies between the others' ends."""
    columns = sorted({w.column for w in todo})
    values = df.select(*[number[i].alias(f"v{i}") for i in columns])
    ends = {i: sorted({x for w in todo if w.column == i for x in (w.low, w.high) if math.isfinite(x)}) for i in columns}
    seen = _class_counts(values, ends)
    asked: dict[int, tuple[list[int], int, int]] = {}
    for k, w in enumerate(todo):
        here, n = seen[w.column], sum(seen[w.column])
        i = 2 * ends[w.column].index(w.low) + 1 if math.isfinite(w.low) else -1
        j = 2 * ends[w.column].index(w.high) + 1 if math.isfinite(w.high) else len(here)
        below, at_low, between = sum(here[:max(i, 0)]), (here[i] if i >= 0 else 0), sum(here[i + 1:j])
        at_high = here[j] if i < j < len(here) else 0
        if w.open[-1] >= n:
            raise RuntimeError("the values changed between two passes over them")
        within = []
        for r in w.open:
            local = r - below - at_low
            if -at_low <= local < 0:
                w.found[r] = w.low
            elif between <= local < between + at_high:
                w.found[r] = w.high
            elif 0 <= local < between:
                within.append(local)
        if within:
            asked[k] = (within, between, below + at_low)
        elif w.open:  # the bracket lies beside its rank
            w.low, w.high = (-math.inf, w.low) if w.open[0] < below else (w.high, math.inf)
    if not asked:
        return
    inside = F.array_compact(F.array(*[
        F.when((v > todo[k].low) & (v < todo[k].high), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k in asked for v in [F.col(f"v{todo[k].column}")]
    ]))
    here = F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("__part")
    parts = values.select(F.inline(inside)).groupBy("k", here).agg(_sketch(F.col("v")).alias("s"))
    sketches = parts.groupBy("k").agg(F.kll_merge_agg_double("s", K).alias("s"))
    slacks = {k: _around(within, between) for k, (within, between, _) in asked.items()}
    read = []
    for k, (within, between, _) in asked.items():
        ranks = [(r + 0.5) / between for r in within] if between <= K else [min(max(x, 0.0), 1.0) for x in slacks[k]]
        read.append(F.when(F.col("k") == k, _quantile("s", F.array(*map(F.lit, ranks)))))
    got = {r["k"]: r["x"] for r in sketches.select("k", F.coalesce(*read).alias("x")).collect()}
    for k, (within, between, before) in asked.items():
        w, (a, b) = todo[k], slacks[k]
        if between <= K:
            w.found |= {r + before: v for r, v in zip(within, got[k])}
        else:
            w.low, w.high = (w.low if a <= 0 else got[k][0]), (w.high if b >= 1 else got[k][1])


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], ps: Sequence[float], exact: bool = True, keep: bool = False, sketches: DataFrame | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; nulls, NaN and infinities skipped, ``None`` for an empty column.

    ``exact=False`` returns the sketch's answer. ``keep`` holds the columns between the scans, for inputs
    that are costly to compute. ``sketches`` (column, sketch) of the same rows save the first scan.
    """
    cols, ps = list(cols), list(ps)
    if not cols:
        return {}
    if keep:
        held = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(cols)]).persist()
        try:
            return exact_quantiles(held, cols, ps, exact, sketches=sketches)
        finally:
            held.unpersist()
    if not exact:
        rough = sketch_quantiles(quantile_sketches(df, cols) if sketches is None else sketches, ps).collect()
        got = {r["column"]: r["quantiles"] for r in rough}
        return {c: got.get(c) or [None] * len(ps) for c in cols}
    found = order_statistics(df, cols, ps, sketches)
    return {c: [interpolated(x) for x in found[c]] for c in cols}


def interpolated(between: tuple[float, float, float] | None) -> float | None:
    return None if between is None else between[0] + (between[1] - between[0]) * between[2]


def medians(df: DataFrame, cols: Sequence[str], default: float | None = None) -> dict[str, float | None]:
    got = exact_quantiles(df, cols, [0.5])
    return {c: (v[0] if v[0] is not None else default) for c, v in got.items()}
