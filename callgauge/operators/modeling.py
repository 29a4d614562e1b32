"""Splits, fits and searches on Spark ML.

Fits run on the executors; only coefficients, fold scores and fitted one-row statistics
come back. Loops here go over models, feature sets and folds, never over data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.operators.evaluation import roc_auc
from callgauge.operators.features import constant_columns, impute_train_median, standard_scale
from callgauge.operators import lockstep
from callgauge.operators.lockstep import Bagged, Boosted, VectorTrees, fit_lockstep
from callgauge.operators.ordering import chronological_index
from callgauge.session import materialize

SEED = 42
#: Fits that run at a time, and training rows a task of a fit works on.
FITS_AT_ONCE = 8
TASK_ROWS = 50_000

# ---------------------------------------------------------------- splits


def chronological_split(df: DataFrame, order: str, ties: Sequence[str], test_size: float = 0.3, name: str = "is_train") -> DataFrame:
    """First int(n * (1 - test_size)) rows by date are train."""
    n = df.count()
    indexed = chronological_index(df, order, ties)
    return indexed.withColumn(name, F.col("idx") < F.lit(int(n * (1 - test_size)))).drop("idx")


def fold_bounds(n: int, k: int) -> list[tuple[int, int, int]]:
    """(fold, train end, test end) of expanding-window folds; the first rows are always train."""
    size = n // (k + 1)
    return [(f + 1, n - (k - f) * size, n - (k - f - 1) * size) for f in range(k)]


def time_series_folds(df: DataFrame, order: str, ties: Sequence[str], k: int = 5) -> DataFrame:
    """One row per row and fold it takes part in, with ``fold`` and ``role`` (train or test)."""
    n = df.count()
    indexed = chronological_index(df, order, ties)
    i = F.col("idx")
    parts = [
        F.when(i < end, F.struct(F.lit(f).alias("fold"), F.lit("train").alias("role"))).when(
            i < stop, F.struct(F.lit(f).alias("fold"), F.lit("test").alias("role")))
        for f, end, stop in fold_bounds(n, k)
    ]
    return indexed.withColumn("__f", F.explode(F.array_compact(F.array(*parts)))).select(*df.columns, "idx", "__f.fold", "__f.role")


# ---------------------------------------------------------------- preparation


def prepare(train: DataFrame, test: DataFrame, cols: Sequence[str], drop_constant: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Impute by training medians, drop constant columns, clip and standardise; fitted on train."""
    cols = list(cols)
    train, test = impute_train_median(train, test, cols)
    if drop_constant:
        dead = set(constant_columns(train, cols))
        cols = [c for c in cols if c not in dead]
    train, test = standard_scale(train, test, cols)
    return train, test, cols


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="error").transform(df)


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {int(r[label]): r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (classes * n_class) per row."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    return df.withColumn(name, reduce(lambda acc, c: acc.when(F.col(label) == c[0], n / (k * c[1])), counts.items(), F.when(F.lit(False), 1.0)))


def positive_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """neg / pos for positives, 1 for negatives."""
    return _positive(df, label, name, class_counts(df, label))


def _positive(df: DataFrame, label: str, name: str, counts: Mapping[int, int]) -> DataFrame:
    ratio = counts.get(0, 0) / counts[1] if counts.get(1) else 1.0
    return df.withColumn(name, F.when(F.col(label) == 1, ratio).otherwise(1.0))


def positive_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Both weights as a table."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"),
                  F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("neg"), F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("pos"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    return one(n).join(one(total), "__one").select(
        label, "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("balanced_weight"),
        F.when(F.col(label) == 1, F.try_divide("neg", "pos")).otherwise(1.0).alias("positive_weight"),
    )


# ---------------------------------------------------------------- fits


def few_tasks(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in as few tasks as their number asks for, never in more than before.

    A boosted fit passes over its rows hundreds of times in short jobs; each costs more for every task than a small
    task works. Spark draws rows by partition, so the draws follow the number of tasks.
    """
    return df.coalesce(max(1, math.ceil(n / TASK_ROWS)))


@contextmanager
def fit_rows(
    df: DataFrame, label: str, features: str, weigh: Callable[[DataFrame, str, str, Mapping[int, int]], DataFrame] | None = None,
) -> Iterator[DataFrame]:
    """Label, features and weight ``__w`` (1 without ``weigh``), held in few tasks while they are fitted."""
    rows = df.select(label, features)
    if weigh is None:
        n, rows = rows.count(), rows.withColumn("__w", F.lit(1.0))
    else:
        counts = class_counts(rows, label)
        n, rows = sum(counts.values()), weigh(rows, label, "__w", counts)
    held = few_tasks(rows, n).persist()
    try:
        yield held
    finally:
        held.unpersist()


def fit_logistic(df: DataFrame, label: str, features: str = "features", c: float = 0.1, balanced: bool = True, max_iter: int = 1000):
    """Ridge-penalised logistic model; strength 1/C on the summed loss, so 1/(C n) on Spark's mean loss."""
    data = balanced_weights(df, label, "__w") if balanced else df.withColumn("__w", F.lit(1.0))
    n = data.agg(F.sum("__w")).first()[0]
    return LogisticRegression(
        labelCol=label, featuresCol=features, weightCol="__w", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-6,
    ).fit(data)


def fit_forest(df: DataFrame, label: str, features: str = "features", trees: int = 100, depth: int = 4, balanced: bool = True):
    data = balanced_weights(df, label, "__w") if balanced else df.withColumn("__w", F.lit(1.0))
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, weightCol="__w", numTrees=trees, maxDepth=depth, seed=SEED,
    ).fit(data)


def fit_ridge(df: DataFrame, label: str, features: str = "features", alpha: float = 1.0):
    """Ridge with strength alpha on the summed squares. Spark works on the mean and divides the
    strength by the spread of the label, so both are undone."""
    n, spread = df.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(
        labelCol=label, featuresCol=features, regParam=alpha / n * (spread or 1.0), elasticNetParam=0.0, standardization=False,
        solver="normal",
    ).fit(df)


def fit_boosted_classifier(
    df: DataFrame, label: str, features: str = "features", rounds: int = 200, depth: int = 4, rate: float = 0.05,
    subsample: float = 0.8, columns: float = 0.8, weighted: bool = True, min_rows: int = 1, min_gain: float = 0.0,
):
    with fit_rows(df, label, features, _positive if weighted else None) as data:
        return GBTClassifier(
            labelCol=label, featuresCol=features, weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=rate,
            subsamplingRate=subsample, featureSubsetStrategy=str(columns), minInstancesPerNode=min_rows, minInfoGain=min_gain,
            seed=SEED,
        ).fit(data)


def fit_boosted_regressor(
    df: DataFrame, label: str, features: str = "features", rounds: int = 200, depth: int = 4, rate: float = 0.05,
    subsample: float = 0.8, columns: float = 0.8,
):
    with fit_rows(df, label, features) as data:
        return GBTRegressor(
            labelCol=label, featuresCol=features, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
            featureSubsetStrategy=str(columns), seed=SEED,
        ).fit(data)


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the probability of the positive class, or the prediction of a regressor."""
    if isinstance(model, VectorTrees):
        return model.score(df, name)
    out = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    extra = [c for c in ("rawPrediction", "probability", "prediction") if c in out.columns and c not in df.columns]
    return out.withColumn(name, value).drop(*extra)


FitFn = Callable[[DataFrame, str, str], object]


class Forest(NamedTuple):
    """Settings of a forest; called, it is the fit by Spark's own learner."""

    trees: int = 100
    depth: int = 4
    balanced: bool = True

    def __call__(self, df: DataFrame, label: str, features: str):
        return fit_forest(df, label, features, *self)

    def together(self, df: DataFrame, features: str) -> Bagged | None:
        """The settings to grow it beside the boosted fits, where its rows are many, but fit one task.

        Spark's learner goes down every tree from its root for each row and level. It keeps the small fits, of which it
        samples no rows to find the edges of bins, and those that must be spread over tasks.
        """
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array(features)))).first()
        if n <= lockstep.COUNTED_ROWS or n > lockstep.task_rows(width):
            return None
        return Bagged(self.trees, self.depth, self.balanced, math.ceil(math.sqrt(width)) / width if self.trees > 1 else 1.0)


def validation_models(rounds: int = 200, trees: int = 100) -> dict[str, FitFn]:
    """The three models of the validation step."""
    return {
        "Logistic Regression": lambda d, y, x: fit_logistic(d, y, x),
        "Random Forest": Forest(trees, 6),
        "Boosted Trees": Boosted(rounds, 6, 0.1),
    }


def fit_all(spark: SparkSession, asked: Sequence[tuple[FitFn, DataFrame, str, str, str]]) -> list:
    """Models of all (fit, rows, label, features, key) in their order: boosted ones and large forests grow together, beside the others."""
    forests = [i for i, a in enumerate(asked) if isinstance(a[0], Forest)]
    large = dict(zip(forests, side_by_side(spark, [lambda a=asked[i]: a[0].together(a[1], a[3]) for i in forests])))
    asked = [(large.get(i) or a[0], *a[1:]) for i, a in enumerate(asked)]
    together = [i for i, a in enumerate(asked) if isinstance(a[0], Boosted | Bagged)]
    others = [i for i in range(len(asked)) if i not in set(together)]
    jobs = [lambda: fit_lockstep([asked[i] for i in together])] if together else []
    out = side_by_side(spark, jobs + [lambda i=i: asked[i][0](*asked[i][1:4]) for i in others])
    found = dict(zip(together, out[0])) if together else {}
    found |= zip(others, out[len(jobs):])
    return [found[i] for i in range(len(asked))]


# ---------------------------------------------------------------- ablation and cross-validation


def feature_set_ablation(
    train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], models: Mapping[str, FitFn], label: str = "label_binary",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Scores of every model on every feature set: rows (feature_set, model, *keep, label, score), fitted side by side."""
    spark = train.sparkSession

    def ready(set_name: str, cols: Sequence[str]) -> tuple[str, DataFrame, DataFrame]:
        tr, te, used = prepare(train, test, cols)
        return set_name, assemble(tr, used, "__x").select(label, "__x").persist(), assemble(te, used, "__x")

    def one(name: str, fit: FitFn, set_name: str, tr: DataFrame, te: DataFrame) -> DataFrame:
        out = scored(fit(tr, label, "__x"), te)
        return out.select(F.lit(set_name).alias("feature_set"), F.lit(name).alias("model"), *keep, F.col(label).alias("label"), "score")

    prepared = side_by_side(spark, [lambda s=s: ready(*s) for s in sets.items() if s[1]])
    # the boosted models take longest: those of all sets come first
    order = sorted(((m, d) for d in prepared for m in models.items()), key=lambda a: [*models].index(a[0][0]), reverse=True)
    parts = side_by_side(spark, [lambda a=(*m, *d): one(*a) for m, d in order])
    out = score_table(parts)
    for _, tr, _ in prepared:
        tr.unpersist()
    return out


def score_table(parts: Sequence[DataFrame]) -> DataFrame:
    """All scored rows, written once: metrics pass over them several times, and a pass would ask every model again."""
    return materialize(reduce(lambda a, b: a.unionByName(b), parts), "scores")


def held_rows(df: DataFrame, n: int) -> DataFrame:
    """Training rows held for many passes, in as few tasks as their number asks for."""
    return few_tasks(df, n).persist()


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], width: int = FITS_AT_ONCE) -> list:
    """Results of ``jobs`` in their order, some of them at a time.

    A fit is a long chain of short Spark jobs, which leaves executors idle between them. Each chain runs in a
    thread of the driver and in a scheduler pool of its own, so that with fair scheduling none waits for another.
    The first failure ends the rest.
    """
    def run(i: int) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{i % width}")
        return jobs[i]()

    with ThreadPoolExecutor(max(1, width)) as pool:
        asked = [pool.submit(inheritable_thread_target(spark)(run), i) for i in range(len(jobs))]
        try:
            return [a.result() for a in asked]
        finally:
            for a in asked:
                a.cancel()


def prepared_folds(
    indexed: DataFrame, n: int, cols: Sequence[str], k: int, label: str, idx: str = "idx", scale_inside: bool = True,
) -> list[tuple[int, DataFrame, DataFrame]]:
    """(fold, held training rows, test rows) of every fold, imputed and scaled inside it, columns in ``__x``."""
    return prepared_sets(indexed, n, [cols], k, label, idx, scale_inside)[0]


def prepared_sets(
    indexed: DataFrame, n: int, sets: Sequence[Sequence[str]], k: int, label: str, idx: str = "idx", scale_inside: bool = True,
) -> list[list[tuple[int, DataFrame, DataFrame]]]:
    """The folds of each of several sets of columns; a column's median, mean and spread in a fold are found once for all sets."""
    cols = list(dict.fromkeys(c for some in sets for c in some))

    def one(fold: int, end: int, stop: int) -> list[tuple[int, DataFrame, DataFrame]]:
        train = indexed.filter(F.col(idx) < end)
        test = indexed.filter((F.col(idx) >= end) & (F.col(idx) < stop))
        if scale_inside:
            train, test, _ = prepare(train, test, cols, drop_constant=False)
        test = few_tasks(test, stop - end)
        return [(fold, held_rows(assemble(train, some, "__x").select(label, "__x", idx), end), assemble(test, some, "__x")) for some in sets]

    folds = side_by_side(indexed.sparkSession, [lambda f=f: one(*f) for f in fold_bounds(n, k)])
    return [list(of_set) for of_set in zip(*folds)]


def _fold_rows(models: Sequence[tuple[object, object]], fold: int, test: DataFrame, label: str, idx: str = "idx") -> DataFrame:
    """Rows (fit, fold, idx, label, score) of all (name, model) of a fold; the test rows are read and prepared once for all of them."""
    names = [f"__s{i}" for i in range(len(models))]
    test = test.select(F.col(idx).alias("idx"), F.col(label).alias("label"), "__x")
    for c, (_, model) in zip(names, models):
        test = scored(model, test, c)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("fit"), F.col(c).alias("score")) for c, (name, _) in zip(names, models)]))
    return test.select("idx", "label", each.alias("__e")).select("__e.fit", F.lit(fold).alias("fold"), "idx", "label", "__e.score")


def fold_fits(indexed: DataFrame, folds: Sequence[tuple[int, DataFrame, DataFrame]], fits: Sequence[tuple[object, FitFn]], label: str, idx: str = "idx") -> DataFrame:
    """Out-of-fold rows (fit, fold, idx, label, score) of all ``fits`` (name, fit) on all folds, fitted side by side."""

    spark = indexed.sparkSession
    models = fit_all(spark, [(fit, train, label, "__x", idx) for _, fit in fits for _, train, _ in folds])
    out = score_table([
        _fold_rows([(name, model) for (name, _), model in zip(fits, models[i::len(folds)])], fold, test, label, idx)
        for i, (fold, _, test) in enumerate(folds)
    ])
    for _, train, _ in folds:
        train.unpersist()
    return out


def cross_validate(
    indexed: DataFrame, n: int, cols: Sequence[str], fit: FitFn, k: int = 5, label: str = "label_binary", idx: str = "idx",
    scale_inside: bool = True,
) -> DataFrame:
    """Out-of-fold rows (fold, idx, label, score); imputing and scaling are fitted inside each fold."""
    return fold_fits(indexed, prepared_folds(indexed, n, cols, k, label, idx, scale_inside), [("", fit)], label, idx).drop("fit")


def fold_scores(out_of_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return roc_auc(out_of_fold, "score", "label", [*by, "fold"]).withColumnRenamed("roc_auc", "auc")


def time_series_cv(
    df: DataFrame, order: str, ties: Sequence[str], sets: Mapping[str, Sequence[str]], models: Mapping[str, FitFn], k: int = 5,
    label: str = "label_binary",
) -> DataFrame:
    """Fold AUC of every model on every feature set: rows (feature_set, model, fold, auc)."""
    indexed = chronological_index(df, order, ties).persist()
    n = indexed.count()
    used = {set_name: cols for set_name, cols in sets.items() if cols}
    folds = prepared_sets(indexed, n, [*used.values()], k, label)
    each = [(set_name, *f) for set_name, fs in zip(used, folds) for f in reversed(fs)]
    # the slower models and the larger folds first; one call, so that the boosted fits of all sets grow together
    names = [*reversed(models)]
    fitted = fit_all(df.sparkSession, [(models[name], train, label, "__x", "idx") for name in names for *_, train, _ in each])
    out = score_table([
        _fold_rows([*zip(names, fitted[i::len(each)])], fold, test, label).withColumn("feature_set", F.lit(set_name))
        for i, (set_name, fold, _, test) in enumerate(each)
    ])
    for *_, train, _ in each:
        train.unpersist()
    return fold_scores(out.withColumnRenamed("fit", "model"), ["feature_set", "model"])


def mean_auc(oof: DataFrame) -> float:
    return fold_scores(oof).agg(F.avg("auc")).first()[0]


# ---------------------------------------------------------------- search, votes, stacks


def random_settings(n: int = 20, seed: int = SEED) -> list[dict]:
    """Random settings of a boosted model over seven ranges."""
    rng = random.Random(seed)
    return [
        {
            "depth": rng.randrange(4, 12), "rate": rng.uniform(0.01, 0.21), "rounds": rng.randrange(100, 400),
            "subsample": rng.uniform(0.6, 1.0), "columns": rng.uniform(0.6, 1.0), "min_rows": rng.randrange(1, 8),
            "min_gain": rng.uniform(0.0, 0.5) * 0.001,
        }
        for _ in range(n)
    ]


def random_search(indexed: DataFrame, n: int, cols: Sequence[str], settings: Sequence[dict], k: int = 3, label: str = "label_binary") -> DataFrame:
    """Cross-validated AUC of every setting, best flagged."""
    from callgauge.operators.aggregates import fold_summary

    fits = [(i, Boosted(**s)) for i, s in enumerate(settings)]
    fits.sort(key=lambda f: -settings[f[0]]["rounds"] * settings[f[0]]["depth"])  # the longest first
    oof = fold_fits(indexed, prepared_folds(indexed, n, cols, k, label), fits, label)
    scores = fold_scores(oof.withColumnRenamed("fit", "setting"), ["setting"])
    out = fold_summary(scores, ["setting"])
    names = sorted(settings[0])
    table = indexed.sparkSession.createDataFrame([(i, *[float(s[k]) for k in names]) for i, s in enumerate(settings)], ["setting", *names])
    best = out.agg(F.max("mean_auc").alias("__best"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    joined = one(out.join(table, "setting")).join(one(best), "__one")
    return joined.withColumn("is_best", F.col("mean_auc") == F.col("__best")).drop("__best", "__one")


def soft_vote(predictions: Sequence[DataFrame], key: Sequence[str], score: str = "score") -> DataFrame:
    """Mean probability of several models: their rows are stacked and averaged, one shuffle for any number of models."""
    both = reduce(lambda a, b: a.unionByName(b), [p.select(*key, "label", score) for p in predictions])
    return both.groupBy(*key, "label").agg(F.avg(score).alias(score), F.count(score).alias("models"))


def stack_models(
    train: DataFrame, test: DataFrame, features: str, label: str, key: str, base: Mapping[str, FitFn], folds: int = 3, n: int | None = None,
) -> DataFrame:
    """Out-of-fold probabilities of the base models feed a logistic model; returns scored test rows.

    The base models are fitted side by side, on each part of the ``n`` training rows and on all of them.
    """
    data, asked = stack_fits(train, features, label, key, base, folds, n)
    return stack_scores(data, test, features, label, key, len(base), folds, fit_all(train.sparkSession, asked))


def stack_fits(
    train: DataFrame, features: str, label: str, key: str, base: Mapping[str, FitFn], folds: int, n: int | None = None,
) -> tuple[DataFrame, list[tuple[FitFn, DataFrame, str, str, str]]]:
    """Held training rows with their ``__fold``, and the fits a stack asks for: each base model without each part, then on all."""
    data = held_rows(train.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds))), train.count() if n is None else n)
    rows = [*[data.filter(F.col("__fold") != f) for f in range(folds)], data]
    return data, [(fit, d, label, features, key) for fit in base.values() for d in rows]


def stack_scores(data: DataFrame, test: DataFrame, features: str, label: str, key: str, members: int, folds: int, models: Sequence) -> DataFrame:
    """Scored test rows of a stack whose fits are done."""
    rounds = [*range(folds), None]
    by_model = [
        [scored(m, test if f is None else data.filter(F.col("__fold") == f), f"p{i}").select(key, label, f"p{i}")
         for f, m in zip(rounds, models[i * len(rounds):(i + 1) * len(rounds)])]
        for i in range(members)
    ]
    joined = reduce(lambda a, b: a.join(b, [key, label]), [reduce(lambda a, b: a.unionByName(b), parts[:-1]) for parts in by_model])
    held = reduce(lambda a, b: a.join(b, [key, label]), [parts[-1] for parts in by_model])
    cols = [f"p{i}" for i in range(members)]
    joined = materialize(joined, "out-of-fold")
    data.unpersist()
    top = fit_logistic(assemble(joined, cols, "__p"), label, "__p", c=1.0, balanced=False)
    return scored(top, assemble(held, cols, "__p")).select(key, F.col(label).alias("label"), "score")


def compare_architectures(indexed: DataFrame, n: int, cols: Sequence[str], rounds: int = 150, trees: int = 200, k: int = 3, label: str = "label_binary", stack_folds: int = 3) -> DataFrame:
    """Fold AUC of boosted trees, forest and stack; (architecture, fold, auc)."""
    spark = indexed.sparkSession
    boosted = Boosted(rounds, 6, 0.3, 1.0, 1.0)
    forest = Forest(trees, 10, False)
    alone, base = {"Boosted Trees": boosted, "Random Forest": forest}, {"rf": forest, "gbt": boosted}

    # the larger folds first; each is prepared once, for the models alone and for its stack
    folds = prepared_folds(indexed, n, cols, k, label)[::-1]
    ends = [end for _, end, _ in fold_bounds(n, k)][::-1]
    stacks = [(fold, test, *stack_fits(train, "__x", label, "idx", base, stack_folds, end)) for (fold, train, test), end in zip(folds, ends)]
    asked = [(fit, train, label, "__x", "idx") for fit in alone.values() for _, train, _ in folds]
    fitted = fit_all(spark, [a for *_, fits in stacks for a in fits] + asked)
    by_model = fitted[-len(asked):]
    fitted = iter(fitted)
    out = score_table([_fold_rows([*zip(alone, by_model[i::len(folds)])], fold, test, label) for i, (fold, _, test) in enumerate(folds)])
    parts = [out.select(F.col("fit").alias("architecture"), "fold", "label", "score")]

    def combined(f: int, test: DataFrame, data: DataFrame, models: list) -> DataFrame:
        rows = stack_scores(data, test, "__x", label, "idx", len(base), stack_folds, models)
        return score_table([rows.select(F.lit("Stacking").alias("architecture"), F.lit(f).alias("fold"), "label", "score")])

    ready = [(f, test, data, [next(fitted) for _ in fits]) for f, test, data, fits in stacks]
    parts += side_by_side(spark, [lambda a=a: combined(*a) for a in ready])
    for _, train, _ in folds:
        train.unpersist()
    return fold_scores(reduce(lambda a, b: a.unionByName(b), parts), ["architecture"])


def validate_new_features(indexed: DataFrame, n: int, base: Sequence[str], new: Sequence[str], rounds: int = 100, k: int = 3, label: str = "label_binary") -> DataFrame:
    """Mean AUC without and with the new features, and the improvement."""
    fit = Boosted(rounds, 6, 0.1, 1.0, 1.0)
    parts = side_by_side(indexed.sparkSession, [
        lambda kind=kind, cols=cols: cross_validate(indexed, n, cols, fit, k, label).withColumn("kind", F.lit(kind))
        for kind, cols in (("baseline", list(base)), ("enhanced", [*base, *new]))
    ])
    scores = fold_scores(reduce(lambda a, b: a.unionByName(b), parts), ["kind"])
    out = scores.agg(
        F.avg(F.when(F.col("kind") == "baseline", F.col("auc"))).alias("baseline_auc"),
        F.avg(F.when(F.col("kind") == "enhanced", F.col("auc"))).alias("enhanced_auc"),
    )
    gain = F.col("enhanced_auc") - F.col("baseline_auc")
    return out.withColumns({"improvement": gain, "improvement_pct": F.coalesce(F.try_divide(gain, "baseline_auc") * 100, F.lit(0.0))})


def feature_importance(model, test: DataFrame, cols: Sequence[str], label: str, key: str, top: int | None = 20) -> DataFrame:
    """AUC lost when one column is taken from other rows, beside the model's own importance.

    A column is shuffled by handing each row the value of the row before it in a hash order
    of the keys, cut into ranges: no driver list, no one-task sort.
    """
    from callgauge.operators.features import rank_features
    from callgauge.operators.ordering import even_range
    from pyspark.sql import Window as W

    hashed = test.withColumn("__h", F.xxhash64(key)).persist()
    hashed = hashed.withColumn("__r", even_range(hashed, "__h")(F.col("__h")))
    w = W.partitionBy("__r").orderBy("__h", key)
    wrap = W.partitionBy("__r").orderBy("__h", key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shuffled = hashed.withColumns({f"__s{i}": F.coalesce(F.lag(c).over(w), F.last(c).over(wrap)) for i, c in enumerate(cols)})
    shuffled = shuffled.persist()
    parts = [scored(model, assemble(shuffled, cols, model.getFeaturesCol())).select(F.lit("").alias("feature"), F.col(label).alias("label"), "score")]
    for i, c in enumerate(cols):
        swapped = shuffled.withColumn(c, F.col(f"__s{i}"))
        parts.append(scored(model, assemble(swapped, cols, model.getFeaturesCol())).select(F.lit(c).alias("feature"), F.col(label).alias("label"), "score"))
    auc = roc_auc(reduce(lambda a, b: a.unionByName(b), parts), "score", "label", ["feature"])
    whole = auc.filter("feature = ''").select(F.col("roc_auc").alias("__whole"), F.lit(1).alias("__one"))
    own = [float(v) for v in model.featureImportances.toArray()] if hasattr(model, "featureImportances") else [0.0] * len(cols)
    own_table = test.sparkSession.createDataFrame(list(zip(cols, own)), "feature string, own_importance double")
    out = auc.filter("feature <> ''").withColumn("__one", F.lit(1)).join(whole, "__one").join(own_table, "feature")
    return rank_features(out.select("feature", (F.col("__whole") - F.col("roc_auc")).alias("score"), "own_importance"), top)
