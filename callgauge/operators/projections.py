"""Column and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from callgauge.functions import fixed
from callgauge.functions.numeric import numeric_columns


def filter_real_only(df: DataFrame, source: str = "source") -> DataFrame:
    """Keep what is not marked synthetic; an unknown source is kept."""
    return df.filter(F.upper(F.coalesce(F.col(source), F.lit(""))) != "SYNTHETIC")


def filter_results(
    df: DataFrame, tickers: Sequence = (), quarters: Sequence = (), sign: str = "All", value: str = "abnormal_return"
) -> DataFrame:
    """Optional lists and the sign of the return; an empty list filters nothing."""
    if tickers:
        df = df.filter(F.col("ticker").isin(*tickers))
    if quarters:
        df = df.filter(F.col("quarter").isin(*quarters))
    if sign == "Positive":
        df = df.filter(F.col(value) > 0)
    elif sign == "Negative":
        df = df.filter(F.col(value) < 0)
    return df


def statement_groups(cols: Sequence[str], metadata: Sequence[str] = ("Ticker", "Date")) -> dict[str, list[str]]:
    """Statement columns by keyword; a column may be in several groups."""
    rest = [c for c in cols if c not in metadata]
    groups = {g: [c for c in rest if any(k in c for k in keys)] for g, keys in fixed.STATEMENT_GROUPS.items()}
    return groups | {"all_features": rest}


def feature_groups(cols: Sequence[str], target: str = "stock_return_3day") -> dict[str, list[str]]:
    """Columns of the fused table by origin."""
    rest = [c for c in cols if c not in fixed.METADATA_COLUMNS and c != target]
    return {
        "financial": [c for c in rest if c.startswith("financial_")],
        "sentiment": [c for c in rest if c.startswith("embedding_") or "sentiment" in c.lower()],
        "text": [c for c in rest if c.startswith("lm_") or c in fixed.TEXT_STATISTICS],
        "market": [c for c in rest if "price" in c.lower() or c in fixed.ROLE_COUNTS],
        "features": rest,
    }


def model_feature_sets(cols: Sequence[str], declared: Sequence[str] | None = None, validation: bool = False) -> dict[str, list[str]]:
    """Feature sets of the models: declared columns that are present, without leaks."""
    leaks = fixed.LEAK_COLUMNS_VALIDATION if validation else fixed.LEAK_COLUMNS
    usable = column_set(cols, declared, leaks)
    if validation:
        usable = [c for c in usable if not any(p in c.lower() for p in fixed.LEAK_PARTS_VALIDATION)]
    prefixes = tuple(fixed.SENTIMENT_PREFIXES_VALIDATION if validation else fixed.SENTIMENT_PREFIXES)
    return {
        "financial_only": [c for c in usable if c.startswith(("financial_", "fin_"))],
        "sentiment_only": [c for c in usable if c.startswith(prefixes)],
        "combined": [c for c in usable if not c.startswith("embedding_")],
        "full_with_finbert": usable,
    }


def column_set(present: Sequence[str], declared: Sequence[str] | None, excluded: Sequence[str]) -> list[str]:
    """Declared and present and not excluded, sorted."""
    chosen = set(present) if declared is None else set(present) & set(declared)
    return sorted(chosen - set(excluded))


def drop_leak_columns(df: DataFrame, leaks: Sequence[str] = tuple(fixed.LEAK_COLUMNS)) -> DataFrame:
    return df.drop(*leaks)


def drop_leak_patterns(df: DataFrame, parts: Sequence[str] = tuple(fixed.LEAK_PARTS_DISCOVERY)) -> DataFrame:
    return df.select(*[c for c in df.columns if not any(p in c for p in parts)])


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric columns (and ``keep``), and the names of what was dropped."""
    chosen = [c for c in df.columns if c in keep or c in set(numeric_columns(df))]
    return df.select(*chosen), sorted(set(df.columns) - set(chosen))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to number; what is no number becomes missing."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def results_view(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in fixed.RESULT_NAMES.items() if c in df.columns])
