"""Shaping of raw tables as collectors deliver them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from callgauge.functions.fixed import TICKER_COLUMNS


def shape_tickers(df: DataFrame, collected: str | None = None) -> DataFrame:
    """Seven columns under their new names, dots in symbols to dashes, the collection date."""
    out = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in TICKER_COLUMNS.items()])
    day = F.lit(collected).cast("date") if collected else F.current_date()
    return out.withColumn("Ticker", F.replace("Ticker", F.lit("."), F.lit("-"))).withColumn("Collection_Date", day)


def statements_to_long(
    df: DataFrame, item: str, periods: Sequence[str], items: Sequence[str], key: Sequence[str] = ("Ticker",), date: str = "Date"
) -> DataFrame:
    """One column per period to one row per period.

    Line items are named, so the pivot is a single aggregate without a pass to find them.
    """
    long = df.unpivot([*key, item], [F.col(f"`{p}`") for p in periods], "__period", "__value")
    out = long.groupBy(*key, "__period").agg(*[F.max(F.when(F.col(item) == i, F.col("__value"))).alias(i) for i in items])
    return out.withColumn(date, F.to_date("__period")).select(*key, date, *[F.col(f"`{i}`") for i in items])


def collection_log(expected: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Every expected entity with whether it was loaded."""
    have = loaded.select(key).distinct().withColumn("loaded", F.lit(True))
    return expected.select(key).distinct().join(have, key, "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))


def collection_rate(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if("loaded").alias("succeeded"), F.count_if(~F.col("loaded")).alias("failed"),
        F.avg(F.col("loaded").cast("double")).alias("success_rate"),
    )
