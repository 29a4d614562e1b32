"""Numeric features, joins, sets and gates on hand-made rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.operators import aggregates as ag, features as ft, joins as jn, matching as mt, projections as pj, quality as ql, scoring as sc, sets as st

INF, NAN = float("inf"), float("nan")


def test_ratios(spark):
    df = spark.createDataFrame([(10.0, 100.0, 0.0, None), (None, 0.0, 5.0, 2.0)], "Net_Income double, Total_Revenue double, Total_Equity double, Total_Debt double")
    a, b = ft.financial_ratios(df).collect()
    assert (a.Profit_Margin, a.ROE, a.Debt_to_Equity) == (0.1, 0.0, 0.0) and (b.Profit_Margin, b.ROE, b.Debt_to_Equity) == (0.0, None, 0.4)
    assert "Current_Ratio" not in a.asDict()


def test_fill_order(spark):
    d = dt.date(2020, 1, 1)
    rows = [("a", d, None, None), ("a", d + dt.timedelta(1), 4.0, None), ("a", d + dt.timedelta(2), NAN, None), ("b", d, INF, None), ("b", d + dt.timedelta(9), 10.0, None)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, x double, y double")
    got = {(r.Ticker, r.Date): (r.x, r.y) for r in ft.fill_missing(df, ["x", "y"]).collect()}
    # forward fill first, so the median is over 4, 4 and 10
    assert got[("a", d)] == (4.0, 0.0) and got[("a", d + dt.timedelta(2))] == (4.0, 0.0) and got[("b", d)] == (4.0, 0.0)
    c = ft.fill_counts(df, ["x", "y"]).first()
    assert (c.missing_before, c.missing_after_ffill, c.missing_after_median, c.missing_final, c.records_with_missing_values) == (8, 7, 5, 0, 5)


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(101)] + [(1000.0, 3.0)], "x double, c double")
    x = np.array([*range(101), 1000.0], dtype=float)
    w = np.clip(x, *np.quantile(x, [0.01, 0.99]))
    got = [r.x for r in ft.robust_scale(ft.winsorize(df, ["x", "c"]), ["x", "c"]).collect()]
    q = np.quantile(w, [0.25, 0.5, 0.75])
    assert got == pytest.approx(((w - q[1]) / (q[2] - q[0])).tolist())
    assert ft.constant_columns(df.withColumn("n", F.lit(None).cast("double")), ["x", "c", "n"]) == ["c", "n"]


def test_train_statistics_only(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (-INF, None)], "x double, n double")
    test = spark.createDataFrame([(NAN, 5.0), (5e7, None)], "x double, n double")
    a, b = ft.impute_train_median(train, test, ["x", "n"])
    assert [r.x for r in a.collect()] == [1.0, 3.0, 2.0, 2.0] and [r.x for r in b.collect()] == [2.0, 5e7]
    a, b = ft.standard_scale(a, b, ["x", "n"])
    s = np.std([1, 3, 2, 2])
    assert [r.x for r in b.collect()] == pytest.approx([0.0, (1e6 - 2) / s]) and [r.n for r in a.collect()] == [0.0] * 4


def test_labels_with_missing_and_fit_on(spark):
    df = spark.createDataFrame([(float(v),) for v in (-3, -1, 0, 1, 2, 5)] + [(None,)], "abnormal_return double")
    got = [(r.abnormal_return, r.label_binary, r.label_median, r.label_tertile) for r in ft.labels(df).collect()]
    lo, hi = np.quantile([-3, -1, 0, 1, 2, 5], [0.33, 0.67])
    for v, b, m, t in got:
        want = (0, 0, 1) if v is None else (int(v > 0), int(v > 0.5), 2 if v >= hi else 0 if v <= lo else 1)
        assert (b, m, t) == want
    assert [r.label_median for r in ft.labels(df.filter("abnormal_return > 1"), fit_on=df).collect()] == [1, 1]
    same = ft.labels(spark.createDataFrame([(1.0,), (1.0,)], "abnormal_return double")).collect()
    assert [r.label_tertile for r in same] == [2, 2]


def test_generated_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 0.0), (4.0, 0.0, -0.5, 1.0)], "financial_a double, financial_b double, sentiment_score double, lm_x double")
    g = ft.discovery_groups(df.withColumn("financial_DateDiff", F.lit(1.0)))
    made = ft.interaction_features(df, g) | ft.polynomial_features(df, g) | ft.ratio_features(df, g) | ft.row_aggregates(df, g)
    a, b = df.select(*[c.alias(n) for n, c in made.items()]).collect()
    assert a["interact_financial_axsentiment_score"] == 0.5 and a["ratio_financial_a_div_financial_b"] == 0.5 and b["ratio_financial_a_div_financial_b"] is None
    assert b["poly_financial_a_sqrt"] == 2.0 and b["poly_log_financial_a"] == pytest.approx(math.log(5)) and "poly_log_financial_b" not in made
    assert b["agg_financial_std"] == pytest.approx(np.std([4, 0], ddof=1)) and b["agg_financial_max"] == 4.0
    assert not any("DateDiff" in n for n in made)


def test_mutual_information_prefers_the_informative_column(spark):
    rows = [(float(i % 97), float(i), i % 2 if i % 10 else 1, int(i > 500)) for i in range(1000)]
    df = spark.createDataFrame(rows, "noise double, signal double, z int, y int")
    got = {r.feature: r.score for r in ft.mutual_information(df, ["noise", "signal"], "y").collect()}
    assert got["signal"] > 0.5 > 0.05 > got["noise"] >= 0
    picked = [r.feature for r in ft.select_features(ft.mutual_information(df, ["noise", "signal"], "y"), threshold=0.3).collect()]
    assert picked == ["signal"]
    none = ft.select_features(ft.mutual_information(df, ["noise", "signal"], "y"), threshold=9.0).collect()
    assert [r.feature for r in none] == ["signal", "noise"]


def test_fuse_renames_and_refuses_repeats(spark):
    a = spark.createDataFrame([("k", "q", 1.0)], "ticker string, quarter string, word_count double")
    s = spark.createDataFrame([("k", "q", 2.0, "x")], "ticker string, quarter string, word_count double, note string")
    out = jn.fuse_features(a, s, s)
    assert out.columns == ["ticker", "quarter", "word_count", "word_count_finbert", "word_count_nlp"]
    twice = s.unionByName(s)
    assert jn.fuse_features(a, twice, s).count() == 2
    with pytest.raises(ValueError):
        jn.fuse_features(a, twice, s, check_unique=True)


def test_statement_join_takes_first_match(spark):
    k = "Ticker string, Date date"
    d = dt.date(2024, 3, 31)
    inc = spark.createDataFrame([("a", d, 5.0), ("b", d, 6.0)], k + ", `Total Revenue` double")
    bal = spark.createDataFrame([("a", d, 1.0), ("a", d, 2.0)], k + ", `Total Assets` double")
    cash = spark.createDataFrame([("b", d, 9.0)], k + ", `Free Cash Flow` double")
    got = {r.Ticker: r for r in jn.join_statements(inc, bal, cash).collect()}
    assert len(got["a"]) == 30 and got["a"].Total_Assets == 1.0 and got["b"].Total_Assets is None and got["b"].Free_Cash_Flow == 9.0


def test_sources_and_history(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    got = {r.k: r.v for r in jn.first_source_wins([mk(("a", 1)), mk(("a", 2), ("b", 2)), mk(("b", 3), ("c", 3))], ["k"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    assert sorted((r.k, r.v) for r in st.extend_history(mk(("a", 1)), mk(("a", 9), ("b", 9)), ["k"]).collect()) == [("a", 1), ("b", 9)]
    assert st.dedupe(mk(("a", 3), ("a", 1), ("b", 2)), ["k"], ["v"]).orderBy("k").collect() == [("a", 1), ("b", 2)]


def test_new_bars_only_after_the_last_stored(spark):
    d = lambda n: dt.date(2024, 1, n)
    stored = spark.createDataFrame([("a", d(1), 1.0), ("a", d(2), 2.0)], "Ticker string, Date date, Close double").withColumn("Volume", F.lit(5))
    fresh = spark.createDataFrame([("a", d(2), 9.0), ("a", d(3), 3.0), ("b", d(1), 7.0)], "Ticker string, Date date, Close double")
    out = st.append_new_bars(stored, fresh, columns=["Ticker", "Date", "Close", "Volume"])
    assert sorted((r.Ticker, r.Date, r.Close, r.Volume) for r in out.collect()) == [("a", d(1), 1.0, 5), ("a", d(2), 2.0, 5), ("a", d(3), 3.0, 0)]


def test_columns_by_name(spark):
    g = pj.statement_groups(["Ticker", "Date", "Total_Revenue", "Cash_And_Equivalents", "Operating_Cash_Flow", "Working_Capital"])
    assert g["balance_features"] == ["Cash_And_Equivalents", "Operating_Cash_Flow", "Working_Capital"] and g["cashflow_features"] == ["Operating_Cash_Flow", "Working_Capital"]
    cols = ["financial_x", "lm_negative", "avg_sentence_length", "embedding_000", "price_after_earnings", "financial_match_type", "ticker"]
    fit, val = pj.model_feature_sets(cols), pj.model_feature_sets(cols, validation=True)
    assert "financial_match_type" in fit["financial_only"] and val["financial_only"] == ["financial_x"]
    assert "avg_sentence_length" not in fit["sentiment_only"] and "avg_sentence_length" in val["sentiment_only"]
    assert "embedding_000" in fit["full_with_finbert"] and "embedding_000" not in fit["combined"]
    real = spark.createDataFrame([("REAL",), ("synthetic",), (None,)], "source string")
    assert pj.filter_real_only(real).count() == 2


def test_summaries(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (3.0, None)], "a double, b double")
    assert {r.column: r.completeness for r in ag.completeness(df).collect()} == {"a": 100.0, "b": 33.33}
    assert ag.clamped_bins(4) == 5 and ag.clamped_bins(40) == 20 and ag.clamped_bins(1000) == 30 and ag.clamped_bins(0) == 10
    h = ag.histogram(df, "a", 2).collect()
    assert [(r.bin, r["count"]) for r in h] == [(1, 1), (2, 2)]
    empty = df.filter("a > 9")
    assert ag.stage_funnel([ag.stage_counts(empty, "s", F.lit(True))]).first().success_rate == 0
    assert ag.resolve_total([], df).first().total == int(3 / 0.752)


def test_gates(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    bad = ql.data_volume_gate(df, 11)
    good = ql.data_volume_gate(df, 10)
    assert not bad.first().passed and good.first().passed
    assert ql.run_status(good).first().status == "success" and ql.run_status(good.unionByName(bad)).first().status == "completed_with_warnings"
    none = ql.feature_gate(df, None)
    assert none.first().decision == "none" and ql.run_status(none).first().stop
    m = spark.createDataFrame([("baseline", 0.57), ("boosted", 0.57), ("search", 0.60)], "source string, roc_auc double")
    got = {r.gate: r.passed for r in ql.model_gate(m).collect()}
    assert got == {"baseline_auc": True, "improvement": True, "architecture": True}
    assert ql.best_source(m.filter("source <> 'search'")).first().best_model == "baseline"


def test_matching_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), float(s), float(rng.random())) for i, s in enumerate(rng.integers(0, 60, 300))]
    df = spark.createDataFrame(rows, "i int, t int, s double, v double")
    got = {r.i: r.distance for r in mt.matched_pairs(df, "t", "i", "s", "v").collect()}
    want = {i: min(abs(s - s2) for _, t2, s2, _ in rows if t2 == 0) for i, t, s, _ in rows if t == 1}
    assert got == want
    assert mt.matched_pairs(df, "t", "i", "s", "v", caliper=0.0).count() == sum(d == 0 for d in want.values())


def test_bootstrap_covers_a_clear_effect(spark):
    rows = [(i, 2.0 + (i % 5) * 0.1, 1.0) for i in range(200)]
    pairs = spark.createDataFrame(rows, "i int, v double, control_value double")
    r = mt.treatment_effect(pairs, "v", "i").first()
    assert r.ci_lower < 1.2 < r.ci_upper and r.significant and r.direction == "POSITIVE" and r.replicates == 200
    assert r.ci_upper - r.ci_lower < 0.1
    again = mt.bootstrap_interval(pairs.repartition(5), "v", "i").first()
    assert again.ci_lower == pytest.approx(r.ci_lower)


def test_scoring_goes_on_after_a_bad_batch(spark):
    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return np.tile([0.0, 0.0, 2.0], (len(texts), 1)), np.ones((len(texts), 4))
        return model

    df = spark.createDataFrame([("ok",), ("bad",)], "t string").coalesce(1)
    got = {r.t: r for r in sc.score_batches(df, "t", make, 4, batch=1).collect()}
    assert got["bad"].probs == pytest.approx([1 / 3] * 3) and got["bad"].embedding == [0.0] * 4
    assert got["bad"].score_failed and not got["ok"].score_failed
    assert got["ok"].probs[2] == pytest.approx(math.exp(2) / (2 + math.exp(2))) and got["ok"].embedding == [1.0] * 4


def test_pooling_and_increments(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)], "k string, v array<double>, m int")
    got = {r.k: r.embedding for r in sc.masked_mean_pool(df, ["k"], "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    done = spark.createDataFrame([("a", 1)], "k string, s int")
    out = sc.incremental_score(spark.createDataFrame([("a",), ("b",)], "k string"), done, ["k"], lambda d: d.withColumn("s", F.lit(7)))
    assert {r.k: r.s for r in out.collect()} == {"a": 1, "b": 7}


def test_nan_and_infinity_are_missing(spark):
    from callgauge.operators import aggregates as ag
    from callgauge.operators.quantiles import exact_quantiles

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, nan), (2.0, nan), (nan, None), (inf, nan), (3.0, -inf)], "a double, b double")
    assert {r["column"]: (r.missing, r.missing_pct) for r in ag.missing_report(df).collect()} == {"a": (2, 40.0), "b": (5, 100.0)}
    assert {r["column"]: r.completeness for r in ag.completeness(df).collect()} == {"a": 60.0, "b": 0.0}
    got = {r["column"]: r for r in ag.describe(df).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["max"], got["a"]["p50"]) == (3, 2.0, 3.0, 2.0) and got["b"]["count"] == 0
    assert exact_quantiles(df, ["a", "b"], [0.0, 1.0]) == {"a": [1.0, 3.0], "b": [None, None]}
    row = ag.distribution_stats(df, "a").first()
    assert (row["mean"], row["positive"], row["max"]) == (2.0, 3, 3.0)
    assert ag.zscore_outliers(df, ["b"]).count() == 0 and ag.iqr_outliers(df, ["b"]).count() == 0
