"""Calls, statements and prices brought together without looking ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions import calendar as cal
from callgauge.functions.fixed import FALLBACK_DAYS, TIGHT_DAYS
from callgauge.functions.numeric import relative_change
from callgauge.operators.ordering import Look, RangeFn, daily_lookup, merged


def _as_date(df: DataFrame, col: str, by_date: bool) -> DataFrame:
    return df.withColumn(col, F.to_date(col)) if by_date else df


def _statements(right: DataFrame, by: list[str], on: str, cols: Sequence[str] | None, name: str) -> Look:
    """Newest statement at or before a moment, and whether the key has statements at all."""
    cols = list(cols if cols is not None else [c for c in right.columns if c not in (*by, on)])
    return Look(right, on, cols, before=name, known="__known")


def _tiered(found: DataFrame, left_on: str, right_on: str, tight: int, fallback: int, name: str) -> DataFrame:
    """Match type and gap from the newest statement of the past, and from whether the key has any."""
    out = found.withColumn("__d", cal.days_between(F.col(left_on), F.col(f"{name}.{right_on}")))
    kind = (
        F.when(F.col(left_on).isNull(), "no_date")
        .when(~F.coalesce("__known", F.lit(False)), "no_ticker")
        .when(F.col(name).isNull(), "all_future")
        .when(F.col("__d") <= tight, "tight")
        .when(F.col("__d") <= fallback, "fallback")
        .otherwise("too_stale")
    )
    out = out.withColumn("match_type", kind)
    kept = F.col("match_type").isin("tight", "fallback")
    return out.withColumns({name: F.when(kept, F.col(name)), "match_days": F.when(kept, F.col("__d"))}).drop("__known", "__d")


def asof_tiered(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    cols: Sequence[str] | None = None,
    tight: int = TIGHT_DAYS,
    fallback: int = FALLBACK_DAYS,
    name: str = "statement",
    by_date: bool = False,
) -> DataFrame:
    """Newest statement at or before the event, with ``match_type`` and ``match_days``.

    ``tight`` up to 120 days back, ``fallback`` up to 180; farther back ``too_stale``;
    ``all_future`` when the key has only later statements, ``no_ticker`` when it has none.
    Statement and reason come from one sorted pass over the distinct moments of each key, so the events
    themselves are joined once, on key and moment, and never shuffled by the key alone.
    """
    by = list(by)
    left, right = _as_date(left, left_on, by_date), _as_date(right, right_on, by_date)
    table = merged(left, by, left_on, [_statements(right, by, right_on, cols, name)])
    found = left.join(table, [*by, left_on], "left")
    return _tiered(found, left_on, right_on, tight, fallback, name).select(*left.columns, name, "match_days", "match_type")


def _bars(prices: DataFrame, on: str, close: str, days_after: int) -> Look:
    """Bar before and bar after a moment."""
    return Look(prices, on, [close], before="__before", after="__after", n=days_after)


def _window_columns(price_on: str, close: str) -> list[Column]:
    both = F.col("__before").isNotNull() & F.col("__after").isNotNull()
    pick = lambda c: F.when(both, F.col(c))
    return [
        pick(f"__before.{price_on}").alias("market_date_before"),
        pick(f"__after.{price_on}").alias("market_date_after"),
        pick(f"__before.{close}").alias("price_before_earnings"),
        pick(f"__after.{close}").alias("price_after_earnings"),
        relative_change(pick(f"__after.{close}"), pick(f"__before.{close}")).alias("stock_return_3day"),
    ]


def event_window_prices(
    events: DataFrame,
    prices: DataFrame,
    by: Sequence[str],
    event_on: str,
    price_on: str,
    close: str,
    days_after: int = 3,
    by_date: bool = False,
    range_of: RangeFn | None = None,
) -> DataFrame:
    """Last close at or before the event, and the third bar after it (the last one if fewer follow).

    An event without a bar on both sides keeps nulls.
    """
    by = list(by)
    events, prices = _as_date(events, event_on, by_date), _as_date(prices, price_on, by_date)
    table = merged(events, by, event_on, [_bars(prices, price_on, close, days_after)], range_of)
    return events.join(table, [*by, event_on], "left").select(*events.columns, *_window_columns(price_on, close))


def match_all(
    calls: DataFrame,
    statements: DataFrame,
    prices: DataFrame,
    *,
    ticker: str = "ticker",
    call_date: str = "date",
    statement_date: str = "date",
    price_date: str = "date",
    close: str = "close",
    tight: int = TIGHT_DAYS,
    fallback: int = FALLBACK_DAYS,
    by_date: bool = False,
) -> DataFrame:
    """Every call with its statement, its price window, and ``outcome``: aligned or the reason why not.

    Calls, statements and prices are merged by (ticker, date) and passed through once in that order; what that
    finds is joined to the calls by one equality, so the calls themselves, texts and all, are shuffled once.
    """
    by = [ticker]
    calls, statements, prices = (
        _as_date(d, c, by_date) for d, c in ((calls, call_date), (statements, statement_date), (prices, price_date))
    )
    looks = [_statements(statements, by, statement_date, None, "statement"), _bars(prices, price_date, close, 3)]
    table = merged(calls.select(ticker, call_date), by, call_date, looks)
    found = calls.join(table, [ticker, call_date], "left")
    tiered = _tiered(found, call_date, statement_date, tight, fallback, "statement")
    both = tiered.select(*calls.columns, "statement", "match_days", "match_type", *_window_columns(price_date, close))
    outcome = (
        F.when(F.col("match_type") == "no_date", "temporal_mismatch")
        .when(F.col("statement").isNull(), F.col("match_type"))
        .when(F.col("market_date_after").isNull(), "missing_market_data")
        .otherwise("aligned")
    )
    return both.withColumn("outcome", outcome)


def align(calls: DataFrame, statements: DataFrame, prices: DataFrame, **kw) -> DataFrame:
    """The aligned table: one row per call that found both, statement columns as ``financial_*``."""
    date = kw.get("statement_date", "date")
    call_date = kw.get("call_date", "date")
    matched = match_all(calls, statements, prices, **kw).filter("outcome = 'aligned'")
    fields = [f for f in matched.schema["statement"].dataType.fieldNames() if f != date]
    keep = [c for c in calls.columns if c != call_date]
    return matched.select(
        *keep,
        F.to_date(call_date).alias("transcript_date"),
        F.to_date(f"statement.{date}").alias("financial_date"),
        F.col("match_days").alias("financial_date_diff_days"),
        F.col("match_type").alias("financial_match_type"),
        F.to_date("market_date_before").alias("market_date_before"),
        F.to_date("market_date_after").alias("market_date_after"),
        "price_before_earnings", "price_after_earnings", "stock_return_3day",
        F.lit(True).alias("is_temporally_valid"),
        *[F.col(f"statement.{f}").alias(f"financial_{f}") for f in fields],
    )


def alignment_rejects(calls: DataFrame, statements: DataFrame, prices: DataFrame, **kw) -> DataFrame:
    """The calls left out, each with its reason."""
    matched = match_all(calls, statements, prices, **kw).filter("outcome <> 'aligned'")
    return matched.select(*calls.columns, F.col("outcome").alias("reason"))


def benchmark_window_return(
    df: DataFrame, index: DataFrame, start: str, end: str, index_on: str = "date", close: str = "close"
) -> DataFrame:
    """Index return over each window of days: close at or before its start to close at or after its end.

    The index becomes a table with one row per calendar day. Its length is bounded by the
    calendar whatever the number of windows, so it is broadcast and ``df`` is not shuffled.
    """
    days = daily_lookup(index, index_on, close)
    newest, last = index.agg(F.max_by(close, index_on), F.max(F.to_date(index_on))).first()
    opened = days.select(F.col("day").alias("__s"), F.col("at_or_before").alias("__open"))
    closed = days.select(F.col("day").alias("__e"), F.col("at_or_after").alias("__close"))
    out = (
        df.withColumns({"__s": F.to_date(start), "__e": F.to_date(end)})
        .join(F.broadcast(opened), "__s", "left").join(F.broadcast(closed), "__e", "left")
    )
    past_end = F.col("__s") > F.lit(last).cast("date")
    first = F.when(past_end, F.coalesce("__open", F.lit(newest).cast("double"))).otherwise(F.col("__open"))
    return out.select(*df.columns, relative_change(F.col("__close"), first).alias("sp500_return_3day"))


def abnormal_return(stock: Column, index: Column) -> Column:
    """Stock minus index; an unknown index counts as 0."""
    return stock - F.coalesce(index, F.lit(0.0))
