"""Statement features, scaling, generated features, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgauge.functions import fixed
from callgauge.operators import features as ft, information as inf, scoring as sc
from callgauge.plans.catalog.alignment import day, r
from callgauge.plans.registry import query
from callgauge.plans.views import LEXICON


@query(
    "financial_ratios",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN Total_Revenue = 0 THEN 0 ELSE Net_Income / Total_Revenue END, 6) AS Profit_Margin,
       round(CASE WHEN Current_Liabilities = 0 THEN 0 ELSE Current_Assets / Current_Liabilities END, 6) AS Current_Ratio,
       round(CASE WHEN Total_Equity = 0 THEN 0 ELSE Total_Debt / Total_Equity END, 6) AS Debt_to_Equity,
       round(Total_Revenue / Total_Assets, 6) AS Asset_Turnover, round(Net_Income / Total_Assets, 6) AS ROA,
       round(CASE WHEN Total_Equity = 0 THEN 0 ELSE Net_Income / Total_Equity END, 6) AS ROE
FROM v_gappy""",
)
def financial_ratios(t):
    out = ft.financial_ratios(t.gappy)
    return out.select("ticker", day("date"), *[r(c) for c in ("Profit_Margin", "Current_Ratio", "Debt_to_Equity", "Asset_Turnover", "ROA", "ROE")])


_FILLED = """
f AS (SELECT ticker, date, last_value(Net_Income IGNORE NULLS) OVER w AS Net_Income, last_value(Current_Assets IGNORE NULLS) OVER w AS Current_Assets, Total_Revenue
      FROM v_gappy WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT median(Net_Income) AS a, median(Current_Assets) AS b FROM f),
g AS (SELECT ticker, date, coalesce(Net_Income, a, 0) AS Net_Income, coalesce(Current_Assets, b, 0) AS Current_Assets, Total_Revenue FROM f, m)"""


@query("fill_missing", f"WITH {_FILLED.strip()} SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(Net_Income, 3) AS Net_Income, round(Current_Assets, 3) AS Current_Assets FROM g")
def fill_missing(t):
    out = ft.fill_missing(t.gappy, ["Net_Income", "Current_Assets"], "ticker", "date")
    return out.select("ticker", day("date"), r("Net_Income", 3), r("Current_Assets", 3))


@query(
    "fill_counts",
    f"""WITH {_FILLED.strip()}
SELECT CAST(2 * count(*) - count(Net_Income) - count(Current_Assets) AS BIGINT) AS missing_before,
       count(*) FILTER (WHERE Net_Income IS NULL OR Current_Assets IS NULL) AS records_with_missing_values,
       (SELECT CAST(2 * count(*) - count(Net_Income) - count(Current_Assets) AS BIGINT) FROM f) AS missing_after_ffill,
       CAST(0 AS BIGINT) AS missing_after_median, CAST(0 AS BIGINT) AS missing_final
FROM v_gappy""",
)
def fill_counts(t):
    return ft.fill_counts(t.gappy, ["Net_Income", "Current_Assets"], "ticker", "date")


@query(
    "winsorize",
    """
SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, hi), lo), 4) AS price
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)""",
)
def winsorize(t):
    return ft.winsorize(t.lineitem, ["l_extendedprice"]).select("l_orderkey", "l_linenumber", r("l_extendedprice", 4, "price"))


@query(
    "clipped_counts",
    """
SELECT 'l_extendedprice' AS column, count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS clipped
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)""",
)
def clipped_counts(t):
    return ft.clipped_counts(t.lineitem, ["l_extendedprice"])


@query(
    "robust_scale",
    """
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / (b - a), 6) AS price
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)""",
)
def robust_scale(t):
    return ft.robust_scale(t.lineitem, ["l_extendedprice"]).select("l_orderkey", "l_linenumber", r("l_extendedprice", 6, "price"))


@query(
    "scaler_parameters",
    """
SELECT 'l_extendedprice' AS column, round(quantile_cont(l_extendedprice, 0.5), 4) AS center,
       round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS scale FROM lineitem""",
)
def scaler_parameters(t):
    return ft.scaler_parameters(t.lineitem, ["l_extendedprice"]).select("column", r("center", 4), r("scale", 4))


_STATEMENTS = ["Total_Revenue", "Net_Income", "Total_Debt", "Tax_Provision", "Total_Assets", "Current_Assets", "Current_Liabilities", "Total_Equity"]
_NORMALIZED = [*_STATEMENTS, *fixed.STATEMENT_RATIOS]
_all = lambda expr: ", ".join(f"{expr.format(c=c)} AS {c}" for c in _NORMALIZED)
_ALL_FILLED = f"""raw AS (SELECT *, {", ".join(f"CASE WHEN {d} = 0 THEN 0 ELSE {n} / {d} END AS {c}" for c, (n, d) in fixed.STATEMENT_RATIOS.items())} FROM v_gappy),
fwd AS (SELECT ticker, date, {_all("last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date)")} FROM raw),
mid AS (SELECT {_all("quantile_cont({c}, 0.5)")} FROM fwd),
filled AS (SELECT fwd.ticker, fwd.date, {_all("coalesce(fwd.{c}, mid.{c}, 0)")} FROM fwd, mid)"""


@query(
    "normalize_financials",
    f"""WITH {_ALL_FILLED},
lo AS (SELECT {_all("quantile_cont({c}, 0.01)")} FROM filled), hi AS (SELECT {_all("quantile_cont({c}, 0.99)")} FROM filled),
cut AS (SELECT filled.ticker, filled.date, {_all("greatest(least(filled.{c}, hi.{c}), lo.{c})")} FROM filled, lo, hi),
m AS (SELECT {_all("quantile_cont({c}, 0.5)")} FROM cut),
w AS (SELECT {_all("coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1)")} FROM cut)
SELECT cut.ticker, strftime(cut.date, '%Y-%m-%d') AS date, {", ".join(f"round((cut.{c} - m.{c}) / w.{c}, {6 if c == 'Net_Income' else 4}) AS {c}" for c in _NORMALIZED)}
FROM cut, m, w""",
)
def normalize_financials(t):
    """Ratios, filling, winsorizing and scaling of the whole statement table, all columns."""
    out = ft.normalize_financials(t.gappy, "ticker", "date")
    return out.select("ticker", day("date"), *[r(c, 6 if c == "Net_Income" else 4) for c in _NORMALIZED])


@query(
    "normalizing_outliers",
    f"WITH {_ALL_FILLED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE abs((filled.{c} - s.m) / s.d) > 3) AS outliers FROM filled, (SELECT avg({c}) AS m, stddev_samp({c}) AS d FROM filled) s"
        for c in _NORMALIZED
    ),
)
def normalizing_outliers(t):
    """The outliers that normalising counts between filling and clipping."""
    return ft.normalizing_outliers(t.gappy, "ticker", "date")


@query(
    "impute_and_scale",
    """
WITH tr AS (SELECT *, CASE WHEN (ticker + quarter(date)) % 5 <> 0 THEN Total_Revenue END AS x FROM v_financials WHERE date < DATE '1999-01-01'),
te AS (SELECT *, CASE WHEN (ticker + quarter(date)) % 5 <> 0 THEN Total_Revenue END AS x FROM v_financials WHERE date >= DATE '1999-01-01'),
m AS (SELECT median(x) AS m FROM tr), s AS (SELECT avg(least(coalesce(x, m), 1e6)) AS a, stddev_pop(least(coalesce(x, m), 1e6)) AS d FROM tr, m)
SELECT side, ticker, strftime(date, '%Y-%m-%d') AS date, round((least(coalesce(x, m), 1e6) - a) / d, 6) AS x
FROM (SELECT 'train' AS side, * FROM tr UNION ALL SELECT 'test', * FROM te), m, s""",
)
def impute_and_scale(t):
    """Training medians, means and spreads applied to the training rows and to the later ones."""
    d = t.financials.withColumn("x", F.when((F.col("ticker") + F.quarter("date")) % 5 != 0, F.col("Total_Revenue")).otherwise(F.lit(float("inf"))))
    sides = ft.impute_train_median(d.filter("date < '1999-01-01'"), d.filter("date >= '1999-01-01'"), ["x"])
    train, test = (side.withColumn("side", F.lit(name)) for side, name in zip(ft.standard_scale(*sides, ["x"]), ("train", "test")))
    return train.unionByName(test).select("side", "ticker", day("date"), r("x"))


@query(
    "generated_features",
    """
SELECT doc_id, round(financial_Total_Assets * word_count, 2) AS inter, round(financial_Total_Assets * financial_Total_Assets, 2) AS sq, round(sqrt(financial_Total_Assets), 6) AS root,
       round(ln(1 + financial_Total_Assets), 6) AS lg, round(financial_Tax_Provision / financial_Total_Assets, 6) AS rat,
       round((financial_Tax_Provision + financial_Total_Assets + financial_Total_Debt) / 3, 4) AS mean, round(greatest(financial_Tax_Provision, financial_Total_Assets, financial_Total_Debt), 4) AS top,
       round(sqrt((pow(financial_Tax_Provision - (financial_Tax_Provision + financial_Total_Assets + financial_Total_Debt) / 3, 2) + pow(financial_Total_Assets - (financial_Tax_Provision + financial_Total_Assets + financial_Total_Debt) / 3, 2)
             + pow(financial_Total_Debt - (financial_Tax_Provision + financial_Total_Assets + financial_Total_Debt) / 3, 2)) / 2), 4) AS spread
FROM (SELECT a.doc_id, financial_Tax_Provision, financial_Total_Assets, financial_Total_Debt, CAST(n_chars AS DOUBLE) AS word_count FROM v_aligned a JOIN documents USING (doc_id))""",
)
def generated_features(t):
    """Interactions, powers, ratios and row aggregates of aligned calls."""
    d = t.aligned.join(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("lm_sentiment_score")), "doc_id")
    d = d.select("doc_id", "financial_Tax_Provision", "financial_Total_Assets", "financial_Total_Debt", "lm_sentiment_score").persist()
    g = ft.discovery_groups(d)
    made = ft.interaction_features(d, g) | ft.polynomial_features(d, g) | ft.ratio_features(d, g) | ft.row_aggregates(d, g)
    x = "financial_Total_Assets"
    return d.select("doc_id", *[F.round(made[k], n).alias(a) for a, k, n in (
        ("inter", f"interact_{x}xlm_sentiment_score", 2), ("sq", f"poly_{x}_sq", 2), ("root", f"poly_{x}_sqrt", 6), ("lg", f"poly_log_{x}", 6),
        ("rat", f"ratio_financial_Tax_Provision_div_{x}", 6), ("mean", "agg_financial_mean", 4), ("top", "agg_financial_max", 4), ("spread", "agg_financial_std", 4),
    )])


@query(
    "sanitize_generated",
    """
SELECT event_id, coalesce(CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN NULL ELSE value END, m) AS v
FROM events, (SELECT median(value) AS m FROM events WHERE user_id % 10 > 1)""",
)
def sanitize_generated(t):
    k = F.col("user_id") % 10
    d = t.events.withColumns({
        "v": F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("nan"))).otherwise(F.col("value")), "flat": F.lit(7.0), "nothing": F.lit(None).cast("double"),
    })
    out, kept = ft.sanitize_generated(d, ["v", "flat", "nothing"])
    assert kept == ["v"]
    return out.select("event_id", "v")


_MI_COLS = ["word_count", "sentence_count", "avg_word_length", "lexical_diversity"]
_MI_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, greatest(sum(n / tot * ln(n * tot / (nb * ny))), 0) AS score FROM (
    SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY label_binary) AS ny FROM (
        SELECT label_binary, b, count(*) AS n FROM (
            SELECT label_binary, len(list_filter(e, lambda x: {c} > x)) AS b FROM v_scored, (
                SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM v_scored)) GROUP BY 1, 2))"""
    for c in _MI_COLS
)


@query("mutual_information", f"SELECT feature, round(score, 6) AS score FROM ({_MI_SQL})")
def mutual_information(t):
    return ft.mutual_information(t.stored_scored, _MI_COLS, "label_binary").select("feature", r("score"))


_PSI = "[" + ", ".join(map(repr, inf.digamma_table())) + "]"


def _psi(n: str) -> str:
    """Digamma in SQL, as the operator forms it."""
    series = f"ln({n}) - 1 / (2.0 * {n}) - 1 / (12.0 * pow({n}, 2)) + 1 / (120.0 * pow({n}, 4)) - 1 / (252.0 * pow({n}, 6))"
    return f"CASE WHEN {n} <= {inf.SUMMED} THEN {_PSI}[{n}] ELSE {series} END"


_NEAR_COLS = [*_MI_COLS, "lm_uncertainty"]


@query(
    "neighbour_information",
    f"""
WITH wide AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, label_binary AS y, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _NEAR_COLS)} FROM v_scored WHERE label_binary IS NOT NULL),
k AS (SELECT least(5, greatest(1, count(*) // 5)) AS k FROM v_scored),
points AS ({" UNION ALL ".join(f"SELECT i, y, '{c}' AS feature, {c} AS x FROM wide WHERE {c} IS NOT NULL" for c in _NEAR_COLS)}),
sized AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS n_class FROM points) WHERE n_class > 1),
reach AS (SELECT feature, i, d, kk FROM (
  SELECT a.feature, a.i, abs(b.x - a.x) AS d, least(k.k, a.n_class - 1) AS kk, row_number() OVER (PARTITION BY a.feature, a.i ORDER BY abs(b.x - a.x)) AS place
  FROM sized a JOIN sized b ON a.feature = b.feature AND a.y = b.y AND a.i <> b.i, k) WHERE place = kk),
inside AS (SELECT a.feature, a.i, a.n_class, r.kk, count(*) AS m FROM sized a JOIN reach r ON a.feature = r.feature AND a.i = r.i
  JOIN sized b ON a.feature = b.feature AND (abs(b.x - a.x) < r.d OR b.x = a.x) GROUP BY ALL),
totals AS (SELECT feature, count(*) AS n, avg({_psi('kk')}) AS k, avg({_psi('n_class')}) AS c, avg({_psi('m')}) AS m FROM inside GROUP BY feature)
SELECT feature, round(greatest({_psi('n')} + k - c - m, 0), 6) AS score FROM totals""",
)
def neighbour_information(t):
    """Mutual information of text figures with the label, by nearest neighbours."""
    return inf.neighbour_information(t.stored_scored, _NEAR_COLS, "label_binary").select("feature", r("score"))


@query("select_features", f"SELECT feature, rank FROM (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rank, score FROM ({_MI_SQL})) WHERE score > 0.02 OR (SELECT max(score) FROM ({_MI_SQL})) <= 0.02")
def select_features(t):
    scores = ft.mutual_information(t.stored_scored, _MI_COLS, "label_binary").persist()
    return ft.select_features(scores).select("feature", F.col("rank").cast("long").alias("rank"))


@query(
    "drop_constant_columns",
    "SELECT CAST(count(*) AS BIGINT) AS n, 'lang,source' AS dropped_not FROM documents",
)
def drop_constant_columns(t):
    d = t.documents.withColumn("one", F.lit(1)).select("doc_id", "one", "n_chars", "lang", "source")
    left = ft.drop_constant_columns(d)
    assert left.columns == ["doc_id", "n_chars", "lang", "source"]
    return left.agg(F.count(F.lit(1)).alias("n"), F.lit("lang,source").alias("dropped_not"))


# ---------------------------------------------------------------- scores and embeddings


@query(
    "softmax_scores",
    """
SELECT vec_id, round(a / (a + b + c), 6) AS sentiment_negative, round(b / (a + b + c), 6) AS sentiment_neutral, round(c / (a + b + c), 6) AS sentiment_positive,
       round((c - a) / (a + b + c), 6) AS sentiment_score
FROM (SELECT vec_id, exp(CAST(embedding[1] AS DOUBLE)) AS a, exp(CAST(embedding[2] AS DOUBLE)) AS b, exp(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings)""",
)
def softmax_scores(t):
    out = sc.softmax_scores(t.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("logits")), "logits")
    return out.select("vec_id", *[r(c) for c in ("sentiment_negative", "sentiment_neutral", "sentiment_positive", "sentiment_score")])


@query(
    "sentiment_features",
    """
SELECT vec_id, round((c - a) / (a + b + c), 6) AS mgmt_sentiment_score, round(a / (a + b + c), 6) AS analyst_sentiment_negative, CAST(0 AS DOUBLE) AS sentiment_divergence
FROM (SELECT vec_id, exp(CAST(embedding[1] AS DOUBLE)) AS a, exp(CAST(embedding[2] AS DOUBLE)) AS b, exp(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings)""",
)
def sentiment_features(t):
    from callgauge.functions.numeric import softmax

    d = t.embeddings.select("vec_id", softmax(F.slice("embedding", 1, 3)).alias("probs"))
    out = sc.sentiment_features(d, "probs", ["vec_id"])
    return out.select("vec_id", r("mgmt_sentiment_score"), r("analyst_sentiment_negative"), "sentiment_divergence")


@query(
    "masked_mean_pool",
    """
SELECT label, i, round(sum(x * w) / greatest(sum(w), 1e-9), 5) AS value FROM (
    SELECT label, vec_id % 3 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""",
)
def masked_mean_pool(t):
    d = t.embeddings.withColumn("mask", F.col("vec_id") % 3)
    out = sc.masked_mean_pool(d, ["label"], "embedding", "mask")
    return out.select("label", F.posexplode("embedding").alias("i", "value")).select("label", F.col("i").cast("long").alias("i"), r("value", 5))


@query(
    "embedding_to_columns",
    "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS embedding_000, CAST(embedding[8] AS DOUBLE) AS embedding_007, CAST(embedding[64] AS DOUBLE) AS embedding_063 FROM embeddings",
)
def embedding_to_columns(t):
    out = sc.embedding_to_columns(t.embeddings, "embedding", 64, ["vec_id"])
    return out.select("vec_id", *[F.col(c).cast("double").alias(c) for c in ("embedding_000", "embedding_007", "embedding_063")])


@query("embedding_size", "SELECT min(len(embedding)) AS min_size, max(len(embedding)) AS max_size FROM embeddings")
def embedding_size(t):
    return sc.embedding_size(t.embeddings, "embedding").select(F.col("min_size").cast("long").alias("min_size"), F.col("max_size").cast("long").alias("max_size"))


@query(
    "score_batches",
    r"""
SELECT doc_id, round(exp(10.0 * n_neg / n) / (exp(10.0 * n_neg / n) + exp(1) + exp(10.0 * n_pos / n)), 6) AS negative,
       round(exp(10.0 * n_pos / n) / (exp(10.0 * n_neg / n) + exp(1) + exp(10.0 * n_pos / n)), 6) AS positive, CAST(16 AS BIGINT) AS size,
       CASE WHEN len(w) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mass, FALSE AS score_failed
FROM (SELECT doc_id, w, greatest(len(w), 1) AS n, len(list_filter(w, lambda x: x IN ('that', 'with'))) AS n_pos, len(list_filter(w, lambda x: x IN ('this', 'from'))) AS n_neg
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents))""",
)
def score_batches(t):
    """Every document scored by the default lexicon model in Arrow batches."""
    model = sc.lexicon_model(LEXICON["positive"], LEXICON["negative"])
    out = sc.score_batches(t.documents.select("doc_id", "text"), "text", model, 16)
    mass = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 3)
    return out.select(
        "doc_id", F.round(F.col("probs")[0], 6).alias("negative"), F.round(F.col("probs")[2], 6).alias("positive"),
        F.size("embedding").cast("long").alias("size"), mass.alias("mass"), "score_failed",
    )

