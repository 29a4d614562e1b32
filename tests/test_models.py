"""Splits, fits and significance on small data with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.operators import aggregates as ag, evaluation as ev, modeling as md, ordering as od


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=240) > 0.3).astype(int)
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i // 3), *map(float, x[i]), int(y[i]), float(x[i, 0] * 2 - x[i, 1])) for i in range(240)]
    return spark.createDataFrame(rows, "i int, d date, a double, b double, c double, y int, r double").persist()


COLS = ["a", "b", "c"]


def test_folds_match_the_expanding_window(spark):
    assert md.fold_bounds(23, 5) == [(1, 8, 11), (2, 11, 14), (3, 14, 17), (4, 17, 20), (5, 20, 23)]
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(i // 4)) for i in range(23)], "i int, d date")
    got = md.time_series_folds(df, "d", ["i"], 5).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in got} == {(f, k): (5 + 3 * f if k == "train" else 3) for f in range(1, 6) for k in ("train", "test")}


def test_split_cuts_inside_a_date(data):
    got = md.chronological_split(data, "d", ["i"], 0.3)
    assert {r.i for r in got.filter("is_train").collect()} == set(range(168))


def test_ridge_equals_closed_form(data):
    x = np.array([[r.a, r.b, r.c] for r in data.orderBy("i").collect()])
    y = np.array([r.r for r in data.orderBy("i").collect()]) + 0.1 * np.sin(np.arange(240))
    df = data.withColumn("t", F.col("r") + 0.1 * F.sin(F.col("i")))
    m = md.fit_ridge(md.assemble(df, COLS), "t", alpha=30.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 30.0 * np.eye(3), xc.T @ yc)
    assert m.coefficients.toArray() == pytest.approx(want, abs=1e-3)


def test_logistic_equals_penalised_maximum(data):
    rows = data.orderBy("i").collect()
    x, y = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.y for r in rows])
    w = np.where(y == 1, 240 / (2 * y.sum()), 240 / (2 * (240 - y.sum())))
    beta, c = np.zeros(4), 0.1
    xb = np.c_[x, np.ones(240)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ beta))
        pen = np.diag([1, 1, 1, 0.0]) / c
        beta -= np.linalg.solve(xb.T @ (xb * (w * p * (1 - p))[:, None]) + pen, xb.T @ (w * (p - y)) + pen @ beta)
    m = md.fit_logistic(md.assemble(data, COLS), "y")
    assert [*m.coefficients.toArray(), m.intercept] == pytest.approx(beta.tolist(), abs=1e-3)


def test_models_learn_and_vote(data):
    d = md.chronological_split(data, "d", ["i"]).persist()
    train, test, used = md.prepare(d.filter("is_train"), d.filter("not is_train"), COLS)
    train, test = md.assemble(train, used), md.assemble(test, used)
    models = [md.fit_logistic(train, "y"), md.fit_forest(train, "y", trees=10), md.fit_boosted_classifier(train, "y", rounds=5)]
    scores = [md.scored(m, test).select("i", F.col("y").alias("label"), "score") for m in models]
    for s in [*scores, md.soft_vote(scores, ["i"])]:
        assert ev.roc_auc(s, "score", "label").first().roc_auc > 0.8
    imp = md.feature_importance(models[1], test.drop("features"), used, "y", "i").collect()
    assert imp[0].feature == "a" and imp[0].score > 0.1


def test_cross_validation_rows(data):
    out = md.time_series_cv(data, "d", ["i"], {"all": COLS, "none": []}, {"lr": lambda d, y, x: md.fit_logistic(d, y, x)}, k=3, label="y")
    r = ag.fold_summary(out, ["feature_set", "model"]).collect()
    assert len(r) == 1 and r[0].folds == 3 and r[0].min_auc > 0.7


def test_auc_turns_with_the_labels_and_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0)], "s double, y int")
    a = ev.roc_auc(df, "s", "y").first().roc_auc
    b = ev.roc_auc(df.withColumn("y", 1 - F.col("y")), "s", "y").first().roc_auc
    assert a == pytest.approx((1 + 0.5 + 0 + 1 + 1 + 0.5) / 6) and a + b == pytest.approx(1)
    assert ev.roc_auc(df.filter("y = 1"), "s", "y").first().roc_auc is None


def test_delong_of_equal_scores(spark):
    rows = [(i, i % 2, (i * 7 % 13) / 13) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, y int, s double").withColumn("t", F.col("s"))
    r = ev.delong_test(df, "y", "s", "t", ["i"]).first()
    assert (r.z_statistic, r.p_value) == (0.0, 1.0) and r.auc_1 == r.auc_2


def test_significance_of_many_models_by_definition(spark):
    """Eight models, one of them a copy, one with gaps: variances and products pair by pair."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 90)
    score = {f"m{i}": np.round(rng.normal(size=90) + y * i / 4, 1) for i in range(7)} | {"m7": None}
    score["m7"] = score["m6"].copy()
    gaps = {("m2", i) for i in range(0, 90, 9)}
    rows = [(i, int(y[i]), m, float(s[i])) for m, s in score.items() for i in range(90) if (m, i) not in gaps]
    got = {(r.model_1, r.model_2): r for r in ev.pairwise_significance(
        spark.createDataFrame(rows + [(200, None, "m0", 1.0), (201, 1, "m0", None)], "i int, label int, model string, score double"), ["i"]).collect()}
    assert len(got) == 28
    place = {}
    for m, s in score.items():
        have = [i for i in range(90) if (m, i) not in gaps]
        for i in have:
            other = [s[j] for j in have if y[j] != y[i]]
            wins = sum((s[i] > o) + 0.5 * (s[i] == o) for o in other) / len(other)
            place[m, i] = wins if y[i] else 1 - sum((s[i] > o) + 0.5 * (s[i] == o) for o in other) / len(other)
    for (a, b), r in got.items():
        common = [i for i in range(90) if (a, i) in place and (b, i) in place]
        var, auc = 0.0, {}
        for side in (0, 1):
            u, v = (np.array([place[m, i] for i in common if y[i] == side]) for m in (a, b))
            var += np.var(u - v, ddof=1) / len(u)
            auc = {"a": u.mean(), "b": v.mean()} if side else auc
        assert (r.auc_1, r.auc_2) == pytest.approx((auc["a"], auc["b"]))
        z = (auc["a"] - auc["b"]) / math.sqrt(var) if (a, b) != ("m6", "m7") else 0.0
        assert r.z_statistic == pytest.approx(z, abs=1e-9)
        assert r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-5)


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.0, 1.96, 3.3, 6.0, -1.96]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(ev._normal_tail(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=2e-7)


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0.2, 1), (0.3, 0)], "s double, y int")
    r = ev.classification_metrics(df, "s", "y").first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_index_feeds_the_search(data):
    idx = od.chronological_index(data, "d", ["i"]).persist()
    settings = [dict(s, rounds=2, depth=2) for s in md.random_settings(2)]
    out = md.random_search(idx, 240, COLS, settings, k=2, label="y").collect()
    assert len(out) == 2 and sum(r.is_best for r in out) >= 1
    got = md.validate_new_features(idx.withColumn("z", F.col("a") * 2), 240, ["b"], ["z"], rounds=3, k=2, label="y").first()
    assert got.improvement > 0.1
