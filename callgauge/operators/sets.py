"""Unions, history extension, sorting, arg-max and small windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from callgauge.functions import fixed
from callgauge.functions.calendar import quarter_label
from callgauge.operators.joins import first_by
from callgauge.operators.ordering import running_max


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key, the first by ``order``."""
    return first_by(df, key, order)


def extend_history(primary: DataFrame, secondary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add the periods of ``secondary`` that ``primary`` lacks."""
    fresh = secondary.join(primary.select(*key).distinct(), list(key), "left_anti")
    return primary.unionByName(fresh, allowMissingColumns=True)


def append_new_bars(
    prices: DataFrame, fresh: DataFrame, key: Sequence[str] = ("Ticker", "Date"), date: str = "Date",
    columns: Sequence[str] = tuple(fixed.BAR_COLUMNS),
) -> DataFrame:
    """Append bars after the last stored date; absent columns become 0; stored rows win."""
    newest = prices.agg(F.max(date).alias("__last")).first()[0]
    fill = fresh.withColumns({c: F.lit(0) for c in columns if c not in fresh.columns}).select(*columns)
    if newest is not None:
        fill = fill.filter(F.col(date) > F.lit(newest))
    both = prices.withColumn("__p", F.lit(0)).unionByName(fill.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return dedupe(both, key, ["__p"]).drop("__p")


def sort_by_entity_date(df: DataFrame, entity: str = "Ticker", date: str = "Date", ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(entity, date, *ties)


def top_k(df: DataFrame, col: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(col), *ties).limit(k)


def first_rows(df: DataFrame, n: int = 200, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def best_by(df: DataFrame, metric: str, by: Sequence[str] = (), ties: Sequence[str] = (), smallest: bool = False) -> DataFrame:
    """The row with the best metric in each group; ties by the given columns, smallest first."""
    order = [F.col(metric) if smallest else -F.col(metric), *[F.col(t) for t in ties]]
    if by:
        return first_by(df, by, order)
    return first_by(df.withColumn("__g", F.lit(0)), ["__g"], order).drop("__g")


def signed_contribution_order(df: DataFrame, value: str = "value", name: str = "feature", top: tuple[int, int] | None = None) -> DataFrame:
    """Positives from large to small, then negatives from small up; optionally the top few of each sign.

    One row per feature of a model comes in, so one small task orders it.
    """
    v = F.col(value)
    w = W.partitionBy(v < 0).orderBy(F.abs(v).desc(), name)
    ranked = df.withColumn("rank_in_sign", F.row_number().over(w))
    if top:
        ranked = ranked.filter(F.when(v < 0, F.col("rank_in_sign") <= top[1]).otherwise((v > 0) & (F.col("rank_in_sign") <= top[0])))
    return ranked.orderBy(v < 0, "rank_in_sign")


def entity_timeline(df: DataFrame, entity: str, date: str, days: int = 21) -> DataFrame:
    """Per entity the ordered list of (quarter, expected call date).

    Periods are folded to distinct ones first: the list is as long as the calendar, not the data.
    """
    periods = df.select(entity, F.to_date(date).alias("__d")).distinct()
    item = F.struct(F.col("__d").alias("statement_date"), quarter_label(F.col("__d")).alias("quarter"), F.date_add("__d", days).alias("call_date"))
    return periods.groupBy(entity).agg(F.sort_array(F.collect_list(item)).alias("timeline"))


def running_best(trials: DataFrame, run: Sequence[str], order: str, score: str) -> DataFrame:
    """Best score so far, gain when beaten, and whether a trial was best."""
    seen = running_max(trials, run, order, score, "__before")
    before, value = F.col("__before"), F.col(score)
    so_far = F.greatest(before, value)
    return seen.select(
        *trials.columns, so_far.alias("best_so_far"),
        F.when(before.isNull() | (value > before), value - F.coalesce(before, F.lit(0.0))).otherwise(0.0).alias("improvement"),
        (value == so_far).alias("was_best"),
    )
