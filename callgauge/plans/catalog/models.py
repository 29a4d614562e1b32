"""Fits, validation and significance. Fitted models are checked by their rows; what follows
from given scores is checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgauge.operators import aggregates as ag, attribution as at, boosting as bt, evaluation as ev, matching as mt, modeling as md, ordering as od
from callgauge.plans.catalog.alignment import r
from callgauge.plans.registry import query
from callgauge.plans.views import LEXICON_FEATURES, TEXT_FEATURES
from callgauge.session import materialize

SETS = {"text": TEXT_FEATURES, "lexicon": LEXICON_FEATURES, "combined": TEXT_FEATURES + LEXICON_FEATURES}
TREES = 100
#: The members of ablation, vote and stack, with the library's own settings.
MEMBERS = {
    "logistic": lambda d, y, x: md.fit_logistic(d, y, x), "forest": lambda d, y, x: md.fit_forest(d, y, x, trees=TREES),
    "boosted": lambda d, y, x: md.fit_boosted_classifier(d, y, x),
}


def _split(t):
    d = md.chronological_split(t.stored_scored, "date", ["doc_id"]).persist()
    return d.filter("is_train"), d.filter("not is_train")


def _ready(t, cols=tuple(SETS["combined"])):
    train, test = _split(t)
    train, test, used = md.prepare(train, test, cols)
    return md.assemble(train, used).persist(), md.assemble(test, used).persist(), used


def _indexed(t):
    d = od.chronological_index(t.stored_scored, "date", ["doc_id"]).persist()
    return d, d.count()


def _metrics(model, test, name):
    out = ev.classification_metrics(md.scored(model, test), "score", "label_binary")
    return out.select(F.lit("fit").alias("phase"), F.lit(name).alias("model"), "roc_auc", "accuracy", "f1", "precision", "recall", "tp", "fp", "fn", "tn")


@query("fit_logistic")
def fit_logistic(t):
    train, test, _ = _ready(t)
    return _metrics(md.fit_logistic(train, "label_binary"), test, "logistic")


@query("fit_forest")
def fit_forest(t):
    train, test, _ = _ready(t)
    return _metrics(md.fit_forest(train, "label_binary", trees=TREES), test, "forest")


@query("fit_boosted_classifier")
def fit_boosted_classifier(t):
    train, test, _ = _ready(t)
    return _metrics(md.fit_boosted_classifier(train, "label_binary"), test, "boosted")


STEPS = bt.Settings(rounds=2, depth=1, rate=0.5, bins=8)


def _steps_sql(cols, label, logistic):
    """Two boosted trees of one cut each, in SQL: every edge of every column is tried in each round."""
    points = " UNION ALL ".join(f"SELECT doc_id, {k} AS f, CAST({c} AS DOUBLE) AS x FROM v_scored WHERE {label} IS NOT NULL" for k, c in enumerate(cols))
    parts = [
        f"points AS ({points})", f"edges AS (SELECT f, unnest(list_distinct(quantile_disc(x, [{', '.join(f'{i / STEPS.bins}' for i in range(1, STEPS.bins))}]))) AS e FROM points GROUP BY f)",
        f"s0 AS (SELECT doc_id, CAST({label} AS DOUBLE) AS y, {'0.0' if logistic else f'avg({label}) OVER ()'} AS m FROM v_scored WHERE {label} IS NOT NULL)",
    ]
    for k in range(1, STEPS.rounds + 1):
        p = "1 / (1 + exp(-m))"
        slopes = f"({p}) - y AS g, ({p}) * (1 - {p}) AS h" if logistic else "m - y AS g, 1.0 AS h"
        parts += [
            f"g{k} AS (SELECT doc_id, {slopes} FROM s{k - 1})", f"t{k} AS (SELECT sum(g) AS tg, sum(h) AS th FROM g{k})",
            f"c{k} AS (SELECT f, e, sum(g) FILTER (x <= e) AS gl, sum(h) FILTER (x <= e) AS hl FROM points JOIN g{k} USING (doc_id) JOIN edges USING (f) GROUP BY f, e)",
            f"""b{k} AS (SELECT * FROM c{k}, t{k} WHERE hl >= 1 AND th - hl >= 1
  ORDER BY round(gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1), {bt.DIGITS}) DESC, f, e LIMIT 1)""",
            f"s{k} AS (SELECT s.doc_id, s.y, m - {STEPS.rate} * CASE WHEN x <= e THEN gl / (hl + 1) ELSE (tg - gl) / (th - hl + 1) END AS m FROM s{k - 1} s JOIN points p ON s.doc_id = p.doc_id JOIN b{k} b ON p.f = b.f)",
        ]
    score = "1 / (1 + exp(-m))" if logistic else "m"
    return f"WITH {', '.join(parts)} SELECT doc_id, round({score}, 6) AS score FROM s{STEPS.rounds}"


_STEP_COLS = ["word_count", "sentence_count", "avg_word_length", "lm_uncertainty"]


@query("boosted_label_steps", _steps_sql(_STEP_COLS, "label_binary", True))
def boosted_label_steps(t):
    """Probability after two second-order rounds of one cut each."""
    d = t.stored_scored
    return bt.fit_second_order(d, _STEP_COLS, "label_binary", "doc_id", STEPS).score(d.filter("label_binary IS NOT NULL")).select("doc_id", r("score"))


@query("boosted_number_steps", _steps_sql(_STEP_COLS, "lexical_diversity", False))
def boosted_number_steps(t):
    """Estimate of a number after two rounds of one cut each."""
    d = t.stored_scored
    return bt.fit_second_order(d, _STEP_COLS, "lexical_diversity", "doc_id", STEPS, logistic=False).score(d.filter("lexical_diversity IS NOT NULL")).select("doc_id", r("score"))


@query("fit_second_order")
def fit_second_order(t):
    """Second-order boosted trees with penalties and drawn rows and columns, judged on the later rows."""
    train, test = _split(t)
    model = bt.fit_second_order(train, SETS["combined"], "label_binary", "doc_id", bt.Settings(rounds=10, depth=3, rate=0.3, bins=32, l1=0.1, min_gain=0.1, columns=0.8, subsample=0.8))
    out = ev.classification_metrics(model.score(test), "score", "label_binary")
    return out.select(F.lit("fit").alias("phase"), F.lit("second order").alias("model"), "roc_auc", "accuracy", "f1", "precision", "recall", "tp", "fp", "fn", "tn")


def _returns(t):
    cols = ["financial_Total_Revenue", "financial_Net_Income", "financial_Total_Debt", "financial_Total_Assets"]
    d = md.chronological_split(t.stored_targets, "transcript_date", ["ticker", "doc_id"]).persist()
    train, test, used = md.prepare(d.filter("is_train"), d.filter("not is_train"), cols)
    return md.assemble(train, used), md.assemble(test, used)


@query("fit_ridge")
def fit_ridge(t):
    train, test = _returns(t)
    return ev.regression_metrics(md.scored(md.fit_ridge(train, "abnormal_return"), test), "score", "abnormal_return")


@query("fit_boosted_regressor")
def fit_boosted_regressor(t):
    train, test = _returns(t)
    mean = train.agg(F.avg("abnormal_return")).first()[0]
    return ev.regression_metrics(md.scored(md.fit_boosted_regressor(train, "abnormal_return"), test), "score", "abnormal_return", mean)


@query(
    "positive_class_weights",
    """
SELECT label_binary, n, round(tot / (k * n), 6) AS balanced_weight, round(CASE WHEN label_binary = 1 THEN neg / n ELSE 1 END, 6) AS positive_weight
FROM (SELECT label_binary, count(*) AS n, sum(count(*)) OVER () AS tot, count(*) OVER () AS k, sum(count(*) FILTER (WHERE label_binary = 0)) OVER () AS neg FROM v_scored GROUP BY 1)""",
)
def positive_class_weights(t):
    out = md.positive_class_weights(t.scored, "label_binary")
    return out.withColumns({c: F.round(c, 6) for c in ("balanced_weight", "positive_weight")})


@query("feature_set_ablation")
def feature_set_ablation(t):
    train, test = _split(t)
    out = md.feature_set_ablation(train, test, SETS, MEMBERS)
    return ev.classification_metrics(out, "score", "label", by=["feature_set", "model"])


@query("leaderboard")
def leaderboard(t):
    train, test, _ = _ready(t)
    return ev.leaderboard([
        _metrics(md.fit_logistic(train, "label_binary"), test, "logistic"), _metrics(md.fit_forest(train, "label_binary", trees=TREES), test, "forest"),
    ])


@query("time_series_cv")
def time_series_cv(t):
    scores = md.time_series_cv(t.stored_scored, "date", ["doc_id"], SETS, md.validation_models())
    return ag.fold_summary(scores, ["feature_set", "model"])


@query("random_search")
def random_search(t):
    d, n = _indexed(t)
    return md.random_search(d, n, TEXT_FEATURES, md.random_settings())


@query("soft_vote")
def soft_vote(t):
    train, test, _ = _ready(t)
    parts = [
        md.scored(m, test).select("doc_id", F.col("label_binary").alias("label"), "score")
        for m in (fit(train, "label_binary", "features") for fit in MEMBERS.values())
    ]
    return md.soft_vote(parts, ["doc_id"])


@query("stack_models")
def stack_models(t):
    train, test, _ = _ready(t)
    return md.stack_models(train, test, "features", "label_binary", "doc_id", MEMBERS)


@query("compare_architectures")
def compare_architectures(t):
    d, n = _indexed(t)
    return ag.fold_summary(md.compare_architectures(d, n, TEXT_FEATURES), ["architecture"])


@query("validate_new_features")
def validate_new_features(t):
    d, n = _indexed(t)
    d = d.withColumn("agg_length", F.col("word_count") * F.col("avg_word_length"))
    return md.validate_new_features(d, n, TEXT_FEATURES, ["agg_length"])


@query("feature_importance")
def feature_importance(t):
    train, test, used = _ready(t)
    model = md.fit_forest(train, "label_binary", trees=TREES)
    return md.feature_importance(model, test.drop("features"), used, "label_binary", "doc_id")


@query("tree_contributions")
def tree_contributions(t):
    """Features by the mean size of what they add to a forest's probability on the later rows."""
    train, test, used = _ready(t)
    return at.mean_contributions(md.fit_forest(train, "label_binary", trees=TREES), test, used)


# ---------------------------------------------------------------- evaluation of given scores

_S = "SELECT doc_id, label_binary AS y, lexical_diversity AS s1, avg_word_length AS s2, lm_uncertainty AS s3 FROM v_scored"


@query(
    "roc_auc",
    f"""
SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS roc_auc
FROM (SELECT avg_word_length AS s FROM v_scored WHERE label_binary = 1) p, (SELECT avg_word_length AS s FROM v_scored WHERE label_binary = 0) n""",
)
def roc_auc(t):
    return ev.roc_auc(materialize(t.scored.select("avg_word_length", "label_binary"), "scores"), "avg_word_length", "label_binary").select(r("roc_auc"))


@query(
    "roc_auc_by_group",
    """
SELECT l_returnflag, round((sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS roc_auc
FROM (SELECT l_returnflag, l_discount > 0.05 AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
             + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rk FROM lineitem) GROUP BY 1""",
)
def roc_auc_by_group(t):
    d = t.lineitem.withColumn("y", (F.col("l_discount") > 0.05).cast("int"))
    return ev.roc_auc(d, "l_extendedprice", "y", ["l_returnflag"]).select("l_returnflag", r("roc_auc"))


@query(
    "midranks",
    """
SELECT a.doc_id, round(avg(CASE WHEN a.y = 1 THEN CASE WHEN b.s < a.s THEN 1.0 WHEN b.s = a.s THEN 0.5 ELSE 0 END
                           ELSE CASE WHEN b.s > a.s THEN 1.0 WHEN b.s = a.s THEN 0.5 ELSE 0 END END), 6) AS placement
FROM (SELECT doc_id, label_binary AS y, word_count AS s FROM v_scored) a JOIN (SELECT label_binary AS y, word_count AS s FROM v_scored) b ON a.y <> b.y GROUP BY 1""",
)
def midranks(t):
    return ev.midranks(t.scored.select("doc_id", "word_count", "label_binary"), "word_count", "label_binary").select("doc_id", r("placement"))


@query(
    "classification_metrics",
    """
SELECT l_linestatus, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (SELECT l_linestatus, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn,
             count(*) FILTER (WHERE NOT p AND NOT y) AS tn
      FROM (SELECT l_linestatus, l_quantity / 50 > 0.5 AS p, l_extendedprice > 40000 AS y FROM lineitem) GROUP BY 1)""",
)
def classification_metrics(t):
    d = t.lineitem.select("l_linestatus", (F.col("l_quantity") / 50).alias("s"), (F.col("l_extendedprice") > 40000).cast("int").alias("y"))
    out = ev.classification_metrics(d, "s", "y", by=["l_linestatus"]).drop("roc_auc")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "regression_metrics",
    """
SELECT round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2,
       round(avg(CAST((y > 0) = (p > 0) AS INTEGER)), 6) AS direction, round(sqrt(avg(pow(y - 100, 2))), 4) AS naive_rmse,
       round(sqrt(avg(pow(y - 100, 2))) - sqrt(avg(pow(y - p, 2))), 4) AS rmse_gain
FROM (SELECT l_extendedprice - 40000 AS y, l_quantity * 1500 - 40000 AS p FROM lineitem)""",
)
def regression_metrics(t):
    d = t.lineitem.select((F.col("l_extendedprice") - 40000).alias("y"), (F.col("l_quantity") * 1500 - 40000).alias("p"))
    out = ev.regression_metrics(d, "p", "y", 100.0)
    return out.select(*[r(c, n) for c, n in (("rmse", 4), ("mae", 4), ("r2", 6), ("direction", 6), ("naive_rmse", 4), ("rmse_gain", 4))])


@query(
    "error_analysis",
    """
SELECT CASE WHEN p AND NOT y THEN 'False Positive' WHEN NOT p AND y THEN 'False Negative' ELSE 'Correct' END AS error_type, count(*) AS rows,
       round(avg(v), 4) AS mean_return, round(stddev_samp(v), 4) AS std_return, round(avg(c), 6) AS mean_confidence, round(stddev_samp(c), 6) AS std_confidence
FROM (SELECT l_quantity / 50 > 0.5 AS p, l_extendedprice > 40000 AS y, l_extendedprice AS v, l_quantity / 50 AS c FROM lineitem) GROUP BY 1""",
)
def error_analysis(t):
    c = F.col("l_quantity") / 50
    d = t.lineitem.select((c > 0.5).cast("int").alias("p"), (F.col("l_extendedprice") > 40000).cast("int").alias("y"), F.col("l_extendedprice").alias("v"), c.alias("c"))
    out = ev.error_analysis(d, "p", "y", "c", "v")
    return out.select("error_type", "rows", r("mean_return", 4), r("std_return", 4), r("mean_confidence"), r("std_confidence"))


_PLACED = """
r AS (SELECT doc_id, y, m, s, rank() OVER (PARTITION BY m ORDER BY s) + (count(*) OVER (PARTITION BY m, s) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY m, y ORDER BY s) + (count(*) OVER (PARTITION BY m, y, s) - 1) / 2.0 AS rc,
             count(*) FILTER (WHERE y = 1) OVER (PARTITION BY m) AS np, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY m) AS nn FROM long),
p AS (SELECT doc_id, y, m, np, nn, CASE WHEN y = 1 THEN (ra - rc) / nn ELSE 1 - (ra - rc) / np END AS v FROM r),
q AS (SELECT a.m AS model_1, b.m AS model_2, a.y, a.v AS v1, b.v AS v2, a.np, a.nn FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.m < b.m),
s AS (SELECT model_1, model_2, avg(v1) FILTER (WHERE y = 1) AS auc_1, avg(v2) FILTER (WHERE y = 1) AS auc_2,
             (var_samp(v1) FILTER (WHERE y = 1) + var_samp(v2) FILTER (WHERE y = 1) - 2 * covar_samp(v1, v2) FILTER (WHERE y = 1)) / max(np)
           + (var_samp(v1) FILTER (WHERE y = 0) + var_samp(v2) FILTER (WHERE y = 0) - 2 * covar_samp(v1, v2) FILTER (WHERE y = 0)) / max(nn) AS d FROM q GROUP BY 1, 2)"""

#: Two-sided tail of the standard normal: Simpson's rule with 400 steps over the density from 0 to |z|.
_TAIL = """
t AS (SELECT *, 1 - 2 * (SELECT sum((CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(k * abs(z) / 400, 2) / 2))
                          FROM range(401) AS g(k)) * abs(z) / 1200 / sqrt(2 * pi()) AS p FROM (SELECT *, (auc_1 - auc_2) / sqrt(d) AS z FROM s))"""


@query(
    "pairwise_significance",
    f"""WITH long AS (SELECT doc_id, y, 'a' AS m, s1 AS s FROM ({_S}) UNION ALL SELECT doc_id, y, 'b', s2 FROM ({_S}) UNION ALL SELECT doc_id, y, 'c', s3 FROM ({_S})), {_PLACED}, {_TAIL}
SELECT model_1, model_2, round(auc_1, 6) AS auc_1, round(auc_2, 6) AS auc_2, round(abs(auc_1 - auc_2), 6) AS auc_diff, round(z, 5) AS z_statistic,
       round(p, 5) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance,
       CASE WHEN auc_1 > auc_2 THEN model_1 ELSE model_2 END AS better_model FROM t""",
)
def pairwise_significance(t):
    d = t.stored_scored.select("doc_id", F.col("label_binary").alias("label"), F.col("lexical_diversity").alias("a"), F.col("avg_word_length").alias("b"), F.col("lm_uncertainty").alias("c"))
    long = d.unpivot(["doc_id", "label"], ["a", "b", "c"], "model", "score")
    out = ev.pairwise_significance(long, ["doc_id"])
    return out.select("model_1", "model_2", r("auc_1"), r("auc_2"), r("auc_diff"), r("z_statistic", 5), r("p_value", 5), "significance", "better_model")


@query(
    "delong_test",
    f"""WITH long AS (SELECT doc_id, y, 'a' AS m, s1 AS s FROM ({_S}) UNION ALL SELECT doc_id, y, 'b', s2 FROM ({_S})), {_PLACED}, {_TAIL}
SELECT round(auc_1, 6) AS auc_1, round(auc_2, 6) AS auc_2, round(z, 5) AS z_statistic, round(p, 5) AS p_value FROM t""",
)
def delong_test(t):
    return ev.delong_test(t.stored_scored, "label_binary", "lexical_diversity", "avg_word_length", ["doc_id"]).select(r("auc_1"), r("auc_2"), r("z_statistic", 5), r("p_value", 5))


# ---------------------------------------------------------------- matched comparison

_PAIRS = """
pairs AS (SELECT doc_id, s, v, cid, cs, cv FROM (
    SELECT a.doc_id, a.s, a.v, c.doc_id AS cid, c.s AS cs, c.v AS cv,
           row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.s - c.s), c.s, c.doc_id DESC) AS n
    FROM (SELECT doc_id, n_chars AS s, quality AS v FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) a,
         (SELECT doc_id, n_chars AS s, quality AS v FROM documents JOIN labels USING (doc_id) WHERE toxic = 0) c) WHERE n = 1)"""


def _pairs(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return mt.matched_pairs(d, "toxic", "doc_id", "n_chars", "quality")


@query("matched_pairs", f"WITH {_PAIRS.strip()} SELECT doc_id, abs(s - cs) AS distance, cid AS control_key FROM pairs")
def matched_pairs(t):
    return _pairs(t).select("doc_id", "distance", "control_key")


@query(
    "pair_effect",
    f"""WITH {_PAIRS.strip()} SELECT round(avg(v - cv), 6) AS effect, round(stddev_samp(v - cv) / sqrt(count(*)), 6) AS standard_error,
       round(avg(v - cv) / (stddev_samp(v - cv) / sqrt(count(*))), 5) AS t_statistic, round(avg(v - cv) / sqrt((var_samp(v) + var_samp(cv)) / 2), 6) AS cohens_d, count(*) AS pairs
FROM pairs""",
)
def pair_effect(t):
    out = mt.pair_effect(_pairs(t), "quality")
    return out.select(r("effect"), r("standard_error"), r("t_statistic", 5), r("cohens_d"), "pairs")


@query(
    "pair_effect_by_group",
    f"""WITH {_PAIRS.strip()} SELECT source, round(avg(v - cv), 6) AS effect, count(*) AS pairs FROM pairs JOIN documents USING (doc_id) GROUP BY 1""",
)
def pair_effect_by_group(t):
    out = mt.pair_effect(_pairs(t).join(t.documents.select("doc_id", "source"), "doc_id"), "quality", ["source"])
    return out.select("source", r("effect"), "pairs")


def _weight(draw: str) -> str:
    return " + ".join(f"CASE WHEN {draw} >= {cut} THEN 1 ELSE 0 END" for cut in mt.poisson_cuts())


@query(
    "effect_interval",
    f"""WITH {_PAIRS.strip()},
first AS (SELECT rep, v - cv AS d, ((doc_id % {mt.PRIME} + {mt.PRIME}) % {mt.PRIME} * {mt.STEPS[0]} + rep * {mt.STEPS[1]} + 42) % {mt.PRIME} AS a FROM pairs, range(1, 201) r(rep)),
second AS (SELECT *, a * a % {mt.PRIME} AS b FROM first),
third AS (SELECT *, (b * {mt.STEPS[2]} + a * {mt.STEPS[3]}) % {mt.PRIME} AS c FROM second),
weighed AS (SELECT rep, d, {_weight(f"(c * c + b) % {mt.PRIME}")} AS w FROM third),
effects AS (SELECT rep, sum(w * d) / nullif(sum(w), 0) AS effect FROM weighed WHERE d IS NOT NULL GROUP BY rep)
SELECT round(quantile_cont(effect, 0.025), 6) AS ci_lower, round(quantile_cont(effect, 0.975), 6) AS ci_upper, count(effect) AS replicates FROM effects""",
)
def effect_interval(t):
    """Bootstrap interval of the difference between toxic documents and their matches."""
    return mt.bootstrap_interval(_pairs(t), "quality", "doc_id").select(r("ci_lower"), r("ci_upper"), "replicates")


@query("treatment_effect")
def treatment_effect(t):
    """Propensity of a toxic label given text statistics, matched comparison, bootstrap interval."""
    scored = mt.propensity(t.stored_scored, "toxic", TEXT_FEATURES).persist()
    pairs = mt.matched_pairs(scored, "toxic", "doc_id", "propensity", "label_binary", caliper=0.2)
    return mt.treatment_effect(pairs.persist(), "label_binary", "doc_id")

