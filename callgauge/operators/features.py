"""Numeric features: statement ratios, filling, scaling, labels, generated features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions import fixed
from callgauge.functions.numeric import clip, finite, numeric_columns, ratio
from callgauge.operators.aggregates import zscore_outliers
from callgauge.operators.ordering import fill_forward
from callgauge.operators.quantiles import exact_quantiles, interpolated, medians, order_statistics
from callgauge.session import materialize

# ---------------------------------------------------------------- statements


def financial_ratios(df: DataFrame) -> DataFrame:
    """Six ratios of raw values; each only when both of its columns exist."""
    return df.withColumns({
        name: ratio(F.col(num), F.col(den))
        for name, (num, den) in fixed.STATEMENT_RATIOS.items()
        if num in df.columns and den in df.columns
    })


def fill_missing(
    df: DataFrame, cols: Sequence[str], by: str = "Ticker", order: str = "Date"
) -> DataFrame:
    """Forward fill within the key, then the column's median over all rows, then 0."""
    filled = materialize(fill_forward(df.withColumns({c: finite(F.col(c)) for c in cols}), [by], order, cols), "forward-filled")
    middle = medians(filled, cols, 0.0)
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(float(middle[c]))) for c in cols})


def fill_counts(df: DataFrame, cols: Sequence[str], by: str = "Ticker", order: str = "Date") -> DataFrame:
    """Missing values before, after the forward fill, after the median and at the end; rows with any null."""
    clean = df.withColumns({c: finite(F.col(c)) for c in cols})
    forward = fill_forward(clean, [by], order, cols)
    missing = lambda: reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in cols])
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    before = clean.agg(missing().alias("missing_before"), F.count_if(any_null).alias("records_with_missing_values"))
    empty = reduce(lambda a, b: a + b, [F.when(F.count(c) == 0, F.count(F.lit(1))).otherwise(0) for c in cols])
    after = forward.agg(missing().alias("missing_after_ffill"), empty.alias("missing_after_median"), F.lit(0).cast("long").alias("missing_final"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    return one(before).join(one(after), "__one").drop("__one")


def winsorize(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    bounds = exact_quantiles(df, cols, [low, high])
    return df.withColumns({c: clip(F.col(c), *bounds[c]) for c in cols if bounds[c][0] is not None})


def clipped_counts(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values per column that winsorizing changes."""
    bounds = exact_quantiles(df, cols, [low, high])
    have = [c for c in cols if bounds[c][0] is not None]
    row = df.agg(*[F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1])).alias(c) for c in have])
    return row.unpivot([], have, "column", "clipped")


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])

    def scaled(c: str) -> Column:
        a, m, b = q[c]
        return (F.col(c) - F.lit(m)) / F.lit((b - a) or 1.0)

    return df.withColumns({c: scaled(c) for c in cols if q[c][1] is not None})


def scaler_parameters(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and scale of the robust scaler as a table, one row per column."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, v[1], ((v[2] - v[0]) or 1.0)) for c, v in q.items() if v[1] is not None]
    return df.sparkSession.createDataFrame(rows, "column string, center double, scale double")


def _filled_statements(df: DataFrame, by: str, order: str) -> tuple[DataFrame, list[str]]:
    with_ratios = financial_ratios(df)
    cols = [c for c in numeric_columns(with_ratios) if c not in (by, order)]
    return fill_missing(with_ratios, cols, by, order), cols


def normalizing_outliers(df: DataFrame, by: str = "Ticker", order: str = "Date", threshold: float = 3.0) -> DataFrame:
    """(column, outliers): values of the filled statements that normalising finds far from the mean, before it clips them."""
    filled, cols = _filled_statements(df, by, order)
    return zscore_outliers(filled, cols, threshold)


def normalize_financials(df: DataFrame, by: str = "Ticker", order: str = "Date") -> DataFrame:
    """Ratios, filling, winsorizing, robust scaling, in this order.

    Bounds and quartiles are found together: winsorizing keeps the order of the values, so the quartiles after it
    lie between the clipped neighbours of the ranks before it.
    """
    filled, cols = _filled_statements(df, by, order)
    found = order_statistics(filled, cols, [0.01, 0.25, 0.5, 0.75, 0.99])

    def scaled(c: str) -> Column:
        low, *quartiles, high = found[c]
        low, high = interpolated(low), interpolated(high)
        a, m, b = (interpolated((min(max(x, low), high), min(max(y, low), high), f)) for x, y, f in quartiles)
        return (clip(F.col(c), low, high) - F.lit(m)) / F.lit((b - a) or 1.0)

    return filled.withColumns({c: scaled(c) for c in cols if found[c][0] is not None})


# ---------------------------------------------------------------- train / test preparation


def impute_train_median(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Infinities to missing; the training medians fill both sides, 0 where train has none."""
    train, test = (d.withColumns({c: finite(F.col(c)) for c in cols}) for d in (train, test))
    middle = medians(train, cols, 0.0)
    fill = {c: F.coalesce(F.col(c), F.lit(float(middle[c]))) for c in cols}
    return train.withColumns(fill), test.withColumns(fill)


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    row = df.agg(*[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standard_scale(train: DataFrame, test: DataFrame, cols: Sequence[str], limit: float = 1e6) -> tuple[DataFrame, DataFrame]:
    """Clip to +-1e6, then (x - mean) / population std of train; leftovers become 0."""
    clipped = {c: clip(F.col(c).cast("double"), -limit, limit) for c in cols}
    train, test = train.withColumns(clipped), test.withColumns(clipped)
    fit = moments(train, cols)
    scale = {
        c: F.coalesce((F.col(c) - F.lit(m)) / F.lit(s or 1.0), F.lit(0.0)) if m is not None else F.lit(0.0)
        for c, (m, s) in fit.items()
    }
    return train.withColumns(scale), test.withColumns(scale)


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """All-null, single-valued or zero-spread columns (one pass)."""
    if not cols:
        return []
    row = df.agg(*[
        (F.coalesce(F.min(c) == F.max(c), F.lit(True)) | (F.coalesce(F.stddev_pop(c), F.lit(0.0)) == 0)).alias(f"k{i}")
        for i, c in enumerate(cols)
    ]).first()
    return [c for i, c in enumerate(cols) if row[f"k{i}"]]


def drop_constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, list(cols) if cols is not None else numeric_columns(df)))


# ---------------------------------------------------------------- labels


def labels(df: DataFrame, value: str = "abnormal_return", fit_on: DataFrame | None = None) -> DataFrame:
    """Above 0, above the median, and thirds; thresholds come from ``fit_on`` or the data itself."""
    mid, low, high = exact_quantiles(fit_on if fit_on is not None else df, [value], [0.5, 0.33, 0.67], keep=True)[value]
    v = F.col(value)
    above = lambda t: F.coalesce((v > F.lit(t)).cast("int"), F.lit(0))
    return df.withColumns({
        "label_binary": above(0.0),
        "label_median": above(mid),
        "label_tertile": F.when(v >= F.lit(high), 2).when(v <= F.lit(low), 0).otherwise(1),
    })


# ---------------------------------------------------------------- generated features


def _usable(df: DataFrame, names: Sequence[str]) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in names if c in numeric and not any(p in c for p in fixed.LEAK_PARTS_DISCOVERY)]


def discovery_groups(df: DataFrame) -> dict[str, list[str]]:
    """Column groups of the feature discovery, names sorted so that "the first ten" is stable."""
    cols = sorted(df.columns)
    return {
        "financial": [c for c in cols if c.startswith("financial_")],
        "sentiment": [c for c in cols if "sentiment" in c.lower() or c.startswith("lm_")],
        "text_stats": [c for c in cols if any(x in c for x in ("word_count", "lexical", "question"))],
        "market": [],
        "all_base": [c for c in cols if not c.startswith("embedding_")],
    }


def interaction_features(df: DataFrame, groups: Mapping[str, Sequence[str]], n_financial: int = 10, n_sentiment: int = 5) -> dict[str, Column]:
    pairs = [(f, s) for f in _usable(df, groups["financial"][:n_financial]) for s in _usable(df, groups["sentiment"][:n_sentiment])]
    pairs += [(m, t) for m in _usable(df, groups.get("market", [])) for t in _usable(df, groups.get("text_stats", []))]
    return {f"interact_{a}x{b}": F.col(a) * F.col(b) for a, b in pairs}


def polynomial_features(df: DataFrame, groups: Mapping[str, Sequence[str]], n_financial: int = 15) -> dict[str, Column]:
    """Square; root where no value is negative; log1p where every value is positive."""
    names = _usable(df, groups["financial"][:n_financial])
    if not names:
        return {}
    row = df.agg(*[F.min(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias(f"m{i}") for i, c in enumerate(names)]).first()
    out: dict[str, Column] = {}
    for i, c in enumerate(names):
        x, low = F.col(c).cast("double"), row[f"m{i}"]
        out[f"poly_{c}_sq"] = x * x
        if low is not None and low >= 0:
            out[f"poly_{c}_sqrt"] = F.sqrt(x)
        if low is not None and low > 0:
            out[f"poly_log_{c}"] = F.log1p(x)
    return out


def ratio_features(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Each financial column over its next three, each sentiment column over its next two."""
    out: dict[str, Column] = {}
    for names, span in ((_usable(df, groups["financial"][:10]), 3), (_usable(df, groups["sentiment"][:8]), 2)):
        for i, a in enumerate(names):
            for b in names[i + 1 : i + 1 + span]:
                out[f"ratio_{a}_div_{b}"] = F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out


def row_aggregates(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Mean, sample std, max and min over the financial columns of a row; mean, std, range over scores."""

    def stats(names: list[str]) -> dict[str, Column]:
        vals = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
        n = len(vals)
        mean = reduce(lambda a, b: a + b, vals) / n
        spread = reduce(lambda a, b: a + b, [(v - mean) * (v - mean) for v in vals])
        return {
            "mean": mean,
            "std": F.sqrt(spread / (n - 1)) if n > 1 else F.lit(None).cast("double"),
            "max": F.greatest(*vals) if n > 1 else vals[0],
            "min": F.least(*vals) if n > 1 else vals[0],
        }

    out: dict[str, Column] = {}
    financial = _usable(df, groups["financial"])
    if financial:
        out |= {f"agg_financial_{k}": c for k, c in stats(financial).items()}
    scores = _usable(df, [c for c in groups["sentiment"] if "score" in c])
    if scores:
        s = stats(scores)
        out |= {"agg_sentiment_mean": s["mean"], "agg_sentiment_std": s["std"], "agg_sentiment_range": s["max"] - s["min"]}
    return out


def sanitize_generated(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Infinities to missing, missing to the median (0 if there is none), constants out."""
    clean = df.withColumns({c: finite(F.col(c)) for c in cols})
    middle = medians(clean, cols, 0.0)
    clean = clean.withColumns({c: F.coalesce(F.col(c), F.lit(float(middle[c]))) for c in cols})
    dead = set(constant_columns(clean, cols))
    return clean.drop(*dead), [c for c in cols if c not in dead]


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column, cut into quantile bins, with the label.

    A binned estimate: the nearest-neighbour estimate is randomised and needs all pairs.
    """
    cuts = exact_quantiles(df, cols, [i / bins for i in range(1, bins)])

    def bin_of(c: str) -> Column:
        edges = sorted({e for e in cuts[c] if e is not None})
        return reduce(lambda acc, e: acc + (F.col(c) > F.lit(e)).cast("int"), edges, F.lit(0))

    cells = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("y"),
        F.explode(F.array(*[
            F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin"))) for c in cols
        ])).alias("f"),
    ).filter("f is not null").groupBy("f.feature", "f.bin", "y").agg(F.count(F.lit(1)).alias("n"))
    # at most features x bins x labels rows from here on
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    by_y = cells.groupBy("feature", "y").agg(F.sum("n").alias("n_y"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    joined = cells.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("n_all")
    gain = p * F.log(F.col("n") * F.col("n_all") / (F.col("n_bin") * F.col("n_y")))
    return joined.groupBy("feature").agg(F.greatest(F.sum(gain), F.lit(0.0)).alias("score"))


def select_features(scores: DataFrame, threshold: float = 0.02, top: int = 15) -> DataFrame:
    """The best features above the threshold without leaking names; if none, the best regardless."""
    leaky = reduce(lambda a, b: a | b, [F.col("feature").contains(p) for p in fixed.LEAK_PARTS_DISCOVERY])
    ranked = rank_features(scores, None)
    passing = ranked.filter((F.col("score") > threshold) & ~leaky)
    fallback = ranked.filter(F.col("rank") <= top).filter(~leaky)
    if passing.limit(1).count():
        return passing.orderBy("rank").limit(top)
    return fallback.orderBy("rank")


def rank_features(scores: DataFrame, top: int | None = 20) -> DataFrame:
    """Rank by score; the table has one row per feature, so one small task orders it."""
    from pyspark.sql import Window as W

    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature")))
    return ranked.filter(F.col("rank") <= top) if top else ranked
