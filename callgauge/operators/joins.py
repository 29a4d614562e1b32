"""Equality joins between feature tables, and set-like lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions import fixed
from callgauge.functions.calendar import call_date_month_end
from callgauge.functions.numeric import numeric_columns


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``, then by the remaining columns.

    A grouped minimum, not a window, so a key with very many copies shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*key).agg(F.min(F.struct(*ranks, *rest)).alias("__best"))
    return best.select(*[F.col(c) if c in key else F.col(f"__best.`{c}`").alias(c) for c in df.columns])


def join_statements(income: DataFrame, balance: DataFrame, cash: DataFrame, key: Sequence[str] = ("Ticker", "Date")) -> DataFrame:
    """28 measures per (Ticker, Date): the income statement leads, the others join where they match."""
    key = list(key)

    def side(df: DataFrame, measures: dict[str, str]) -> DataFrame:
        return df.select(*key, *[
            (F.col(f"`{src}`") if src in df.columns else F.lit(None)).cast("double").alias(dst) for dst, src in measures.items()
        ])

    out = side(income, fixed.INCOME_MEASURES)
    for df, measures in ((balance, fixed.BALANCE_MEASURES), (cash, fixed.CASHFLOW_MEASURES)):
        out = out.join(first_by(side(df, measures), key, []), key, "left")
    return out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def fuse_features(
    aligned: DataFrame,
    sentiment: DataFrame,
    nlp: DataFrame,
    key: Sequence[str] = ("ticker", "quarter"),
    check_unique: bool = False,
) -> DataFrame:
    """Left joins of the numeric feature columns; clashing names get ``_finbert`` / ``_nlp``."""
    key = list(key)
    out = aligned
    for right, suffix in ((sentiment, "_finbert"), (nlp, "_nlp")):
        if check_unique and duplicate_keys(right, key).limit(1).count():
            raise ValueError(f"feature table for {suffix[1:]} repeats keys {key}")
        taken = set(out.columns)
        picked = [
            F.col(c).alias(c + suffix if c in taken else c) for c in numeric_columns(right) if c not in key
        ]
        out = out.join(right.select(*key, *picked), key, "left")
    return out


def only_aligned(df: DataFrame, aligned: DataFrame, key: Sequence[str] = ("ticker", "quarter")) -> DataFrame:
    return df.join(aligned.select(*key), list(key), "left_semi")


def first_source_wins(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union in priority order; a key seen in an earlier source is skipped in later ones."""
    ranked = [df.withColumn("__p", F.lit(i)) for i, df in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_by(both, key, ["__p"]).drop("__p")


def map_quarter_to_call_date(df: DataFrame, quarter: str = "quarter", name: str = "date") -> DataFrame:
    return df.withColumn(name, call_date_month_end(F.col(quarter)))


def ingest_gate(df: DataFrame, date: str, last_date: str) -> DataFrame:
    """Drop records without a date or dated after the price data ends."""
    return df.filter(F.col(date) <= F.lit(last_date).cast("date"))


def missing_entity_periods(entities: DataFrame, periods: Sequence[str], have: DataFrame, entity: str = "ticker", period: str = "quarter") -> DataFrame:
    """Entity x period pairs that ``have`` lacks; the short period list travels with each entity row."""
    grid = entities.select(entity).distinct().withColumn(period, F.explode(F.array(*map(F.lit, periods))))
    return grid.join(have.select(entity, period), [entity, period], "left_anti")


def pairwise_models(scores: DataFrame, row: Sequence[str], model: str = "model", value: str = "score") -> DataFrame:
    """Every unordered pair of models on the same row: equality on the row, order on the model."""
    row = list(row)
    a = scores.select(*row, F.col(model).alias("model_1"), F.col(value).alias("score_1"))
    b = scores.select(*row, F.col(model).alias("model_2"), F.col(value).alias("score_2"))
    return a.join(b, row).filter("model_1 < model_2")
