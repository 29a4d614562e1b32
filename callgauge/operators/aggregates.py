"""Summaries: every operator is one grouped pass, partial before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.fixed import SHARE_OF_INPUT
from callgauge.functions.numeric import finite, numeric_columns, present
from callgauge.operators.quantiles import exact_quantiles


def _long(row: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    return row.unpivot([], [F.col(f"`{c}`") for c in cols], "column", value)


def dataset_summary(df: DataFrame, ticker: str = "ticker", quarter: str = "quarter", date: str = "transcript_date") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.lit(len(df.columns)).cast("long").alias("total_features"),
        F.countDistinct(ticker).alias("unique_tickers"),
        F.countDistinct(quarter).alias("quarters_covered"),
        F.min(date).alias("date_start"),
        F.max(date).alias("date_end"),
    )


def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent of non-null values per column, two digits, halves to even."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.bround(F.count(present(df, c)) / F.count(F.lit(1)) * 100, 2).alias(c) for c in cols])
    return _long(row, cols, "completeness")


def overall_completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return completeness(df, cols).agg(F.bround(F.avg("completeness"), 2).alias("overall_completeness"))


def group_completeness(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean completeness of each column group, in one pass over the data."""
    cols = sorted({c for cs in groups.values() for c in cs})
    row = df.agg(*[(F.count(present(df, c)) / F.count(F.lit(1)) * 100).alias(c) for c in cols])
    have = {g: cs for g, cs in groups.items() if cs}
    means = row.select(*[(reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in cs]) / len(cs)).alias(g) for g, cs in have.items()])
    return means.unpivot([], list(have), "column_group", "completeness")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(present(df, c).isNull()).alias(c) for c in cols]
    )
    long = row.unpivot(["__n"], [F.col(f"`{c}`") for c in cols], "column", "missing")
    return long.select("column", "missing", F.coalesce(F.try_divide("missing", "__n") * 100, F.lit(0.0)).alias("missing_pct"))


def missing_totals(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return missing_report(df, cols).agg(
        F.sum("missing").alias("total_missing"), F.count_if(F.col("missing") > 0).alias("columns_affected")
    )


def zscore_outliers(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Rows farther than ``threshold`` sample deviations from the mean; columns without spread are skipped."""
    fit = df.agg(*[g(finite(F.col(c))).alias(f"{k}{i}") for i, c in enumerate(cols) for k, g in (("m", F.avg), ("s", F.stddev_samp))]).first()
    have = [(c, fit[f"m{i}"], fit[f"s{i}"]) for i, c in enumerate(cols) if fit[f"s{i}"] and fit[f"s{i}"] > 0]
    if not have:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")
    row = df.agg(*[F.count_if(F.abs((finite(F.col(c)) - F.lit(m)) / F.lit(s)) > threshold).alias(c) for c, m, s in have])
    return _long(row, [c for c, _, _ in have], "outliers")


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    have = [c for c in cols if q[c][0] is not None]
    if not have:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")
    outside = lambda c, a, b: (finite(F.col(c)) < a - k * (b - a)) | (finite(F.col(c)) > b + k * (b - a))
    return _long(df.agg(*[F.count_if(outside(c, *q[c])).alias(c) for c in have]), have, "outliers")


def gap_stats(df: DataFrame, gap: str = "financial_date_diff_days", kind: str = "financial_match_type") -> DataFrame:
    """Gap between statement and call; the gap is a bounded day count, so its median is cheap."""
    return df.agg(
        F.avg(gap).alias("avg_gap_days"),
        F.median(gap).alias("median_gap_days"),
        F.max(gap).cast("long").alias("max_gap_days"),
        F.count_if(F.col(kind) == "tight").alias("tight"),
        F.count_if(F.col(kind) == "fallback").alias("fallback"),
        F.avg(F.when(F.col(kind) == "fallback", F.col(gap))).alias("fallback_avg_gap_days"),
    )


def distribution_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    c = present(df, col)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.count_if(c > 0).alias("positive"), F.count_if(c <= 0).alias("non_positive"),
        (F.count_if(c > 0) / n * 100).alias("positive_pct"), (F.count_if(c <= 0) / n * 100).alias("non_positive_pct"),
    )


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)
    return out.limit(top) if top else out


def monthly_counts(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.trunc(F.to_date(date), "month").alias("month")).agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def group_agg(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(col).alias("mean"), F.max(col).alias("max"), F.count(col).alias("count"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Count, mean, sample std, minimum, quartiles and maximum, one row per numeric column."""
    cols = list(cols or numeric_columns(df))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    d = {c: finite(F.col(f"`{c}`")) for c in cols}
    stats = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(d[c]).alias("count"), F.avg(d[c]).alias("mean"), F.stddev_samp(d[c]).alias("std"),
        F.min(d[c]).alias("min"),
        *[F.lit(q[c][i]).cast("double").alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
        F.max(d[c]).alias("max"),
    )
    rows = df.agg(F.array(*[stats(c) for c in cols]).alias("r")).select(F.inline("r"))
    return rows.select("column", "count", *[F.round(n, digits).alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def clamped_bins(n: int) -> int:
    return max(5, min(30, n // 2)) if n > 0 else 10


def histogram(df: DataFrame, col: str, bins: int | None = 50) -> DataFrame:
    """Counts in equally wide bins between minimum and maximum; ``bins=None`` follows the row count."""
    c = finite(F.col(col))
    low, high, n = df.agg(F.min(c), F.max(c), F.count(c)).first()
    bins = bins or clamped_bins(n)
    if low is None or low == high:
        which = F.lit(1)
    else:
        which = F.least(F.floor((c - F.lit(low)) / F.lit((high - low) / bins)) + 1, F.lit(bins))
    width = 0.0 if low is None else (high - low) / bins
    return (
        df.filter(c.isNotNull()).groupBy(which.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (F.lit(low or 0.0) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"), "count").orderBy("bin")
    )


def correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    x, y = finite(F.col(a)), finite(F.col(b))
    return df.filter(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.corr(x, y).alias("correlation"))


def result_kpis(df: DataFrame, value: str = "abnormal_return", label: str = "label_binary") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("calls"), F.avg(value).alias("avg_abnormal_return"),
        F.avg(F.col(label).cast("double")).alias("share_beat_market"), F.stddev_samp(value).alias("typical_swing"),
    )


def stage_counts(df: DataFrame, stage: str, ok: Column) -> DataFrame:
    """Rows in and rows through of one stage."""
    return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"))


def stage_funnel(stages: Sequence[DataFrame]) -> DataFrame:
    both = reduce(lambda a, b: a.unionByName(b), stages)
    return both.withColumn("success_rate", F.col("passed") / F.greatest(F.col("total"), F.lit(1)) * 100)


def cleaning_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("full_text_cleaned").isNotNull()).alias("successfully_cleaned"),
        F.avg("full_text_original_length").alias("avg_original_length"),
        F.avg("full_text_cleaned_length").alias("avg_cleaned_length"),
        F.sum("total_chars_removed").alias("total_chars_removed"),
    )


def segmentation_stats(df: DataFrame) -> DataFrame:
    ratio = F.col("management_analyst_ratio")
    return df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.avg("management_word_count").alias("avg_management_words"),
        F.avg("analyst_word_count").alias("avg_analyst_words"),
        F.coalesce(F.avg(F.when(ratio > 0, ratio)), F.lit(0.0)).alias("avg_ratio"),
        F.count_if("fallback_used").alias("fallback_used"),
    )


def entity_period_counts(df: DataFrame, entity: str, period: str) -> DataFrame:
    return df.agg(
        (F.count(F.lit(1)) / F.countDistinct(entity)).alias("rows_per_entity"), F.countDistinct(period).alias("periods")
    )


def fold_summary(scores: DataFrame, by: Sequence[str], score: str = "auc") -> DataFrame:
    return scores.groupBy(*by).agg(
        F.avg(score).alias("mean_auc"), F.stddev_pop(score).alias("std_auc"), F.min(score).alias("min_auc"),
        F.max(score).alias("max_auc"), F.count(score).alias("folds"),
    )


def resolve_total(sources: Sequence[DataFrame], rows: DataFrame, share: float = SHARE_OF_INPUT) -> DataFrame:
    """Total input count: the first one-row source that has it, else rows / share of input."""
    parts = [d.agg(F.max("total").cast("long").alias("total")).withColumn("prio", F.lit(i)) for i, d in enumerate(sources)]
    guess = rows.agg(F.floor(F.count(F.lit(1)) / share).alias("total")).withColumn("prio", F.lit(len(sources)))
    both = reduce(lambda a, b: a.unionByName(b), [*parts, guess])
    return both.agg(F.min_by("total", F.when(F.col("total").isNotNull(), F.col("prio"))).alias("total"))


def token_length_stats(df: DataFrame, tokens: Column, order: str, sample: int = 10) -> DataFrame:
    """Token counts of the first few texts by ``order``."""
    head = df.orderBy(order).limit(sample).select(F.size(tokens).alias("n"))
    return head.agg(
        F.min("n").cast("long").alias("min_tokens"), F.max("n").cast("long").alias("max_tokens"),
        F.floor(F.avg("n")).cast("long").alias("avg_tokens"),
    )


def sentiment_trend(df: DataFrame, score: str, period: str = "quarter", margin: float = 0.0) -> DataFrame:
    """Shares of bullish, bearish and neutral calls per quarter."""
    c, n = F.col(score), F.count(F.lit(1))
    return df.groupBy(period).agg(
        n.alias("calls"), (F.count_if(c > margin) / n).alias("bullish"), (F.count_if(c < -margin) / n).alias("bearish"),
        (F.count_if((c >= -margin) & (c <= margin)) / n).alias("neutral"),
    )


def newest_signal(df: DataFrame, prob: str, entity: str, date: str, tie: str, signal: Column) -> DataFrame:
    """Newest score of each entity with its signal."""
    newest = df.groupBy(entity).agg(F.max_by(F.struct(date, prob), F.struct(date, tie)).alias("x"))
    return newest.select(entity, f"x.{date}", f"x.{prob}").withColumn("signal", signal)
