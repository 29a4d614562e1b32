"""Evaluation of scores: exact rank statistics, metrics, significance, error tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.fixed import BASELINE_AUC
from callgauge.operators.ordering import running_totals


def rank_table(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at it and below it, with the class totals."""
    y = F.col(label)
    t = running_totals(df, score, {"n_pos": (y == 1).cast("long"), "n_neg": (y == 0).cast("long")}, by=by)
    return t.withColumnsRenamed({"n_pos_all": "total_pos", "n_neg_all": "total_neg"})


def placements(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: share of negatives below it (``v10``) and of positives above it (``v01``), ties half."""
    return rank_table(df, score, label, by).select(
        *by, score,
        F.try_divide(F.col("n_neg_before") + 0.5 * F.col("n_neg"), F.col("total_neg")).alias("v10"),
        F.try_divide(
            F.col("total_pos") - F.col("n_pos_before") - 0.5 * F.col("n_pos"), F.col("total_pos")
        ).alias("v01"),
    )


def midranks(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Every row with its placement among the other class."""
    ranked = df.join(placements(df, score, label, by), [*by, score])
    return ranked.withColumn("placement", F.when(F.col(label) == 1, F.col("v10")).otherwise(F.col("v01"))).drop("v10", "v01")


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; null when a class is missing."""
    t = rank_table(df, score, label, by)
    wins = F.col("n_pos") * (F.col("n_neg_before") + 0.5 * F.col("n_neg"))
    return t.groupBy(*by).agg(
        F.try_divide(F.sum(wins), (F.max("total_pos") * F.max("total_neg")).cast("double")).alias("roc_auc")
    )


def confusion(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the metrics that follow from them; a zero denominator gives 0."""
    p, y = F.col(pred) == 1, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": zero(tp + tn, tp + fp + fn + tn), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn),
        "f1": zero(2 * tp, 2 * tp + fp + fn),
    })


def classification_metrics(
    df: DataFrame, score: str, label: str, pred: str | None = None, by: Sequence[str] = (), cut: float = 0.5
) -> DataFrame:
    by = list(by)
    named = df if pred else df.withColumn("__pred", (F.col(score) > cut).cast("int"))
    group = by or ["__g"]
    if not by:
        named = named.withColumn("__g", F.lit(0))
    out = confusion(named, pred or "__pred", label, group).join(roc_auc(named, score, label, group), group, "left")
    return out if by else out.drop("__g")


def regression_metrics(df: DataFrame, pred: str, actual: str, train_mean: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2, share of equal signs; with a training mean also the naive RMSE and the gain on it."""
    p, y = F.col(pred), F.col(actual)
    err = y - p
    n = F.count(F.lit(1))
    out = df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * n)).alias("r2"),
        F.avg(((y > 0) == (p > 0)).cast("double")).alias("direction"),
        *([F.sqrt(F.avg((y - F.lit(train_mean)) * (y - F.lit(train_mean)))).alias("naive_rmse")] if train_mean is not None else []),
    )
    return out.withColumn("rmse_gain", F.col("naive_rmse") - F.col("rmse")) if train_mean is not None else out


def distribution_shift(df: DataFrame, label: str, is_train: Column, limit: float = 0.10) -> DataFrame:
    y = F.col(label).cast("double")
    out = df.agg(F.avg(F.when(is_train, y)).alias("train_positive_rate"), F.avg(F.when(~is_train, y)).alias("test_positive_rate"))
    return out.withColumn("shifted", F.abs(F.col("train_positive_rate") - F.col("test_positive_rate")) > limit)


def error_rows(df: DataFrame, pred: str, label: str, prob: str) -> DataFrame:
    p, y = F.col(pred), F.col(label)
    kind = F.when((p == 1) & (y == 0), "False Positive").when((p == 0) & (y == 1), "False Negative").otherwise("Correct")
    return df.withColumns({"error": p != y, "error_type": kind, "prediction_confidence": F.col(prob)})


def error_analysis(df: DataFrame, pred: str, label: str, prob: str, value: str) -> DataFrame:
    return error_rows(df, pred, label, prob).groupBy("error_type").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean_return"), F.stddev_samp(value).alias("std_return"),
        F.avg("prediction_confidence").alias("mean_confidence"), F.stddev_samp("prediction_confidence").alias("std_confidence"),
    )


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal (erfc by a rational fit, error below 1.2e-7)."""
    # Coefficients of the rational fit, constant term first.
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


#: Scored rows turned into one matrix product at a time.
MATRIX_ROWS = 8_192


def _pair_sums(wide: DataFrame, names: list[str]) -> DataFrame:
    """Per pair of models and class: rows scored by both, sums, squares and products of their placements less one half.

    A task adds up matrices of models by models, whatever its number of rows; only those are shuffled.
    """
    first, second = np.triu_indices(len(names), 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 6, len(names), len(names)))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]) - 0.5
            for low in range(0, len(y), MATRIX_ROWS):
                for side in (0, 1):
                    rows = x[low:low + MATRIX_ROWS][y[low:low + MATRIX_ROWS] == side]
                    have = ~np.isnan(rows)
                    v, h = np.where(have, rows, 0.0), have.astype(float)
                    s, q = v.T @ h, (v * v).T @ h
                    sums[side] += [h.T @ h, s, s.T, q, q.T, v.T @ v]
        for side in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in first], pa.string()), pa.array([names[i] for i in second], pa.string()),
                 pa.array(np.full(len(first), side, np.int32)), *[pa.array(m[first, second]) for m in sums[side]]],
                ["model_1", "model_2", "y", "n", "s1", "s2", "q1", "q2", "c"],
            )

    parts = wide.mapInArrow(add, "model_1 string, model_2 string, y int, n double, s1 double, s2 double, q1 double, q2 double, c double")
    return parts.groupBy("model_1", "model_2", "y").agg(*[F.sum(k).alias(k) for k in ("n", "s1", "s2", "q1", "q2", "c")])


def pairwise_significance(scores: DataFrame, row: Sequence[str], label: str = "label", model: str = "model", value: str = "score") -> DataFrame:
    """DeLong test for every pair of models over the rows that both have scored.

    The placements of a row become one vector with a place for each model (their names are few and are
    collected), and one pass over the vectors sums the covariance matrix: no row is paired with itself.
    If a model scored a row twice, the larger placement counts; rows without a label take no part. No spread in
    the difference, or fewer than two common rows of a class, gives z 0 and p 1; pairs without a common positive row
    are left out.
    """
    row = list(row)
    scores = scores.filter(F.col(label).isin(0, 1) & F.col(value).isNotNull() & F.col(model).isNotNull())
    names = sorted(r[0] for r in scores.select(F.col(model).cast("string")).distinct().collect())
    placed = midranks(scores, value, label, [model])
    one = lambda m: F.max(F.when(F.col(model).cast("string") == m, F.col("placement")))
    wide = placed.groupBy(*row, F.col(label).cast("int").alias("__y")).agg(*[one(m).alias(f"__m{i}") for i, m in enumerate(names)])
    sums = _pair_sums(wide.select("__y", *[f"__m{i}" for i in range(len(names))]), names)
    n, s1, s2 = (F.col(c) for c in ("n", "s1", "s2"))
    some = lambda top, low: F.when(low > 0, top / low)
    spread = lambda q, s, t: some(some(F.col(q) - s * t / n, n - 1), n)
    per_class = sums.filter("n > 0").withColumns({
        "own": spread("q1", s1, s1) + spread("q2", s2, s2), "shared": 2 * spread("c", s1, s2),
    })
    mean = lambda s: F.max(F.when(F.col("y") == 1, s / n + 0.5))
    both = lambda c: F.when(F.count(c) == 2, F.sum(c))
    stats = per_class.groupBy("model_1", "model_2").agg(
        mean(s1).alias("auc_1"), mean(s2).alias("auc_2"), both("own").alias("own"), both("shared").alias("shared"),
    ).filter("auc_1 IS NOT NULL")
    # what is left of equal spreads after rounding counts as none
    gap = F.col("own") - F.col("shared")
    moves = F.coalesce(gap > 1e-12 * F.col("own"), F.lit(False))
    z = F.when(moves, (F.col("auc_1") - F.col("auc_2")) / F.sqrt(F.when(moves, gap))).otherwise(0.0)
    out = stats.withColumns({"z_statistic": z, "moves": moves})
    p = F.when(F.col("moves"), _normal_tail(F.col("z_statistic"))).otherwise(1.0)
    return out.withColumn("p_value", p).select(
        "model_1", "model_2", "auc_1", "auc_2", F.abs(F.col("auc_1") - F.col("auc_2")).alias("auc_diff"),
        "z_statistic", "p_value",
        F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("ns").alias("significance"),
        F.when(F.col("auc_1") > F.col("auc_2"), F.col("model_1")).otherwise(F.col("model_2")).alias("better_model"),
    )


def delong_test(df: DataFrame, label: str, score1: str, score2: str, row: Sequence[str]) -> DataFrame:
    """DeLong test of two score columns on the same rows."""
    long = df.select(*row, F.col(label).alias("label"), F.col(score1).alias("a"), F.col(score2).alias("b")).unpivot(
        [*row, "label"], ["a", "b"], "model", "score"
    )
    return pairwise_significance(long, row).select("auc_1", "auc_2", "auc_diff", "z_statistic", "p_value")


def leaderboard(metrics: Sequence[DataFrame], threshold: float = BASELINE_AUC) -> DataFrame:
    """All (phase, model, roc_auc, accuracy, f1) rows, best first, with the threshold flag."""
    from callgauge.operators.sets import union_tables

    both = union_tables([m.select("phase", "model", "roc_auc", "accuracy", "f1") for m in metrics])
    return both.withColumn("useful", F.col("roc_auc") >= threshold).orderBy(F.desc("roc_auc"), "phase", "model")
