"""Null rules and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INF = float("inf")


def finite(c: Column) -> Column:
    """NaN and both infinities become null; in Spark NaN is larger than every number."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (d == F.lit(INF)) | (d == F.lit(-INF)), None).otherwise(d)


def ratio(num: Column, den: Column) -> Column:
    """num/den; 0 when the denominator is 0; null when a needed side is missing."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def relative_change(after: Column, before: Column) -> Column:
    return F.try_divide(after - before, before)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low))))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def softmax(logits: Column) -> Column:
    """Array of scores to array of shares, shifted by the maximum for stability."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(parts, lambda x: x / total)


def present(df: DataFrame, name: str) -> Column:
    """The column, with NaN and infinities of floating columns as null."""
    c = F.col(f"`{name}`")
    return finite(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c
