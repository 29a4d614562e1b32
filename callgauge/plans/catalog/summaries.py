"""Aggregations, windows, sorting, set operations, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgauge.operators import aggregates as ag, features as ft, projections as pj, quality as ql, sets as st
from callgauge.plans.catalog.alignment import day, r
from callgauge.plans.registry import query
from callgauge.session import new_path
from callgauge.sources.snapshots import SnapshotTable, store_new_bars


@query(
    "dataset_summary",
    """
SELECT count(*) AS total_records, CAST(23 AS BIGINT) AS total_features, count(DISTINCT ticker) AS unique_tickers, count(DISTINCT quarter) AS quarters_covered,
       strftime(min(transcript_date), '%Y-%m-%d') AS date_start, strftime(max(transcript_date), '%Y-%m-%d') AS date_end
FROM v_aligned""",
)
def dataset_summary(t):
    return ag.dataset_summary(t.aligned).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("date_start", "date_end")})


@query(
    "completeness",
    """
SELECT 'Net_Income' AS column, round_even(100.0 * count(Net_Income) / count(*), 2) AS completeness FROM v_gappy UNION ALL
SELECT 'Current_Assets', round_even(100.0 * count(Current_Assets) / count(*), 2) FROM v_gappy UNION ALL
SELECT 'Total_Revenue', round_even(100.0 * count(Total_Revenue) / count(*), 2) FROM v_gappy""",
)
def completeness(t):
    return ag.completeness(t.gappy, ["Net_Income", "Current_Assets", "Total_Revenue"])


@query(
    "overall_completeness",
    """
SELECT round_even((100 + round_even(100.0 * count(Net_Income) / count(*), 2) + round_even(100.0 * count(Current_Assets) / count(*), 2)) / 3, 2) AS overall_completeness
FROM v_gappy""",
)
def overall_completeness(t):
    return ag.overall_completeness(t.gappy, ["Net_Income", "Current_Assets", "Total_Revenue"])


@query(
    "group_completeness",
    """
SELECT 'income_features' AS column_group, round((100 + 100.0 * count(Net_Income) / count(*) + 100) / 3, 6) AS completeness FROM v_gappy UNION ALL
SELECT 'balance_features', round((200 + 100.0 * count(Current_Assets) / count(*) + 100.0 * count(Current_Liabilities) / count(*) + 100.0 * count(Total_Equity) / count(*)) / 5, 6) FROM v_gappy UNION ALL
SELECT 'all_features', round((400 + 100.0 * count(Net_Income) / count(*) + 100.0 * count(Current_Assets) / count(*) + 100.0 * count(Current_Liabilities) / count(*) + 100.0 * count(Total_Equity) / count(*)) / 8, 6) FROM v_gappy""",
)
def group_completeness(t):
    groups = pj.statement_groups(t.gappy.columns, ("ticker", "date"))
    return ag.group_completeness(t.gappy, groups).withColumn("completeness", F.round("completeness", 6))


@query(
    "missing_report",
    """
SELECT 'Net_Income' AS column, count(*) - count(Net_Income) AS missing, round(100.0 * (count(*) - count(Net_Income)) / count(*), 6) AS missing_pct FROM v_gappy UNION ALL
SELECT 'Current_Assets', count(*) - count(Current_Assets), round(100.0 * (count(*) - count(Current_Assets)) / count(*), 6) FROM v_gappy UNION ALL
SELECT 'Total_Debt', 0, 0.0""",
)
def missing_report(t):
    out = ag.missing_report(t.gappy, ["Net_Income", "Current_Assets", "Total_Debt"])
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "missing_totals",
    """
SELECT CAST(2 * count(*) - count(Net_Income) - count(Current_Assets) AS BIGINT) AS total_missing, CAST(2 AS BIGINT) AS columns_affected FROM v_gappy""",
)
def missing_totals(t):
    return ag.missing_totals(t.gappy, ["Net_Income", "Current_Assets", "Total_Debt"])


@query(
    "zscore_outliers",
    """
SELECT 'l_extendedprice' AS column, count(*) FILTER (WHERE abs((l_extendedprice - m) / s) > 1.7) AS outliers
FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) UNION ALL
SELECT 'l_quantity', count(*) FILTER (WHERE abs((l_quantity - m) / s) > 1.7)
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)""",
)
def zscore_outliers(t):
    return ag.zscore_outliers(t.lineitem.withColumn("flat", F.lit(1.0)), ["l_extendedprice", "l_quantity", "flat"], 1.7)


@query(
    "iqr_outliers",
    """
SELECT 'value' AS column, count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers
FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)""",
)
def iqr_outliers(t):
    return ag.iqr_outliers(t.events, ["value"], 1.5)


@query(
    "distribution_stats",
    """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
       count(*) FILTER (WHERE value > 0) AS positive, count(*) FILTER (WHERE value <= 0) AS non_positive,
       round(100.0 * count(*) FILTER (WHERE value > 0) / count(*), 6) AS positive_pct,
       round(100.0 * count(*) FILTER (WHERE value <= 0) / count(*), 6) AS non_positive_pct
FROM events GROUP BY 1""",
)
def distribution_stats(t):
    out = ag.distribution_stats(t.events, "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "positive_pct", "non_positive_pct")})


@query("value_counts", "SELECT source, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def value_counts(t):
    return ag.value_counts(t.documents, "source", 10)


@query("monthly_counts", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS count FROM orders GROUP BY 1")
def monthly_counts(t):
    return ag.monthly_counts(t.orders, "o_orderdate").select(day("month"), "count")


@query("group_agg", "SELECT l_suppkey, round(avg(l_discount), 8) AS mean, max(l_discount) AS max, count(l_discount) AS count FROM lineitem GROUP BY 1")
def group_agg(t):
    return ag.group_agg(t.lineitem, "l_suppkey", "l_discount").withColumn("mean", F.round("mean", 8))


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
       round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75,
       round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
)


@query("describe", _DESCRIBE)
def describe(t):
    return ag.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])


@query(
    "exact_quantiles",
    """
SELECT 'o_totalprice' AS column, round(quantile_cont(o_totalprice, 0.01), 6) AS p01, round(quantile_cont(o_totalprice, 0.33), 6) AS p33,
       round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders""",
)
def exact_quantiles(t):
    from callgauge.operators.quantiles import exact_quantiles as eq

    q = eq(t.orders, ["o_totalprice"], [0.01, 0.33, 0.99])["o_totalprice"]
    return t.orders.agg(
        F.lit("o_totalprice").alias("column"), *[F.round(F.lit(v), 6).alias(n) for n, v in zip(("p01", "p33", "p99"), q)],
        F.count(F.lit(1)).alias("n"),
    ).drop("n")


@query(
    "train_medians",
    """
SELECT round(coalesce(median(Net_Income), 0), 3) AS net_income, round(coalesce(median(Current_Assets), 0), 3) AS current_assets, CAST(0 AS DOUBLE) AS empty
FROM v_gappy WHERE date < DATE '2000-01-01'""",
)
def train_medians(t):
    from callgauge.operators.quantiles import medians

    train = t.gappy.filter("date < '2000-01-01'").withColumn("nothing", F.lit(None).cast("double"))
    m = medians(train, ["Net_Income", "Current_Assets", "nothing"], 0.0)
    return train.groupBy().agg(
        F.round(F.lit(m["Net_Income"]), 3).alias("net_income"), F.round(F.lit(m["Current_Assets"]), 3).alias("current_assets"),
        F.lit(m["nothing"]).alias("empty"),
    )


@query(
    "histogram",
    """
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)) + 1, 50) AS BIGINT) AS bin, count(*) AS count
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""",
)
def histogram(t):
    return ag.histogram(t.events, "value", 50).select(F.col("bin").cast("long").alias("bin"), "count")


@query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY 1")
def correlation(t):
    return ag.correlation(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("correlation", F.round("correlation", 6))


@query(
    "result_kpis",
    """
SELECT count(*) AS calls, round(avg(abnormal_return), 6) AS avg_abnormal_return, round(avg(label_binary), 6) AS share_beat_market,
       round(stddev_samp(abnormal_return), 6) AS typical_swing FROM v_labelled""",
)
def result_kpis(t):
    out = ag.result_kpis(ft.labels(t.stored_targets))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_abnormal_return", "share_beat_market", "typical_swing")})


@query(
    "stage_funnel",
    """
SELECT 'texts' AS stage, count(*) AS total, count(*) FILTER (WHERE length(text) > 100) AS passed,
       round(100.0 * count(*) FILTER (WHERE length(text) > 100) / greatest(count(*), 1), 6) AS success_rate FROM documents UNION ALL
SELECT 'statements', count(*), count(*) FILTER (WHERE match_type IN ('tight', 'fallback')),
       round(100.0 * count(*) FILTER (WHERE match_type IN ('tight', 'fallback')) / greatest(count(*), 1), 6) FROM v_match""",
)
def stage_funnel(t):
    from callgauge.operators.alignment import asof_tiered

    matched = asof_tiered(t.calls.drop("text"), t.financials, ["ticker"], "date", "date", ["Total_Debt"])
    out = ag.stage_funnel([
        ag.stage_counts(t.documents, "texts", F.length("text") > 100), ag.stage_counts(matched, "statements", F.col("statement").isNotNull()),
    ])
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "entity_period_counts",
    "SELECT round(count(*) / count(DISTINCT l_suppkey), 6) AS rows_per_entity, count(DISTINCT CAST(l_shipdate AS DATE)) AS periods FROM lineitem",
)
def entity_period_counts(t):
    out = ag.entity_period_counts(t.lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("d")), "l_suppkey", "d")
    return out.withColumn("rows_per_entity", F.round("rows_per_entity", 6))


@query(
    "fold_summary",
    """
SELECT o_orderstatus, round(avg(x), 6) AS mean_auc, round(stddev_pop(x), 6) AS std_auc, round(min(x), 6) AS min_auc, round(max(x), 6) AS max_auc, count(x) AS folds
FROM (SELECT o_orderstatus, year(o_orderdate) AS y, avg(CAST(o_totalprice > 200000 AS INTEGER)) AS x FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def fold_summary(t):
    scores = t.orders.groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("auc"))
    out = ag.fold_summary(scores, ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_auc", "std_auc", "min_auc", "max_auc")})


@query(
    "resolve_total",
    "SELECT count(*) AS total FROM documents",
)
def resolve_total(t):
    nothing = t.events.filter("event_type = 'none'").agg(F.max("event_id").alias("total"))
    return ag.resolve_total([nothing, t.documents.agg(F.count(F.lit(1)).alias("total")), t.orders.agg(F.count(F.lit(1)).alias("total"))], t.labels)


@query(
    "sentiment_trend",
    """
SELECT c.quarter, count(*) AS calls, round(avg(CAST(x > 0 AS INTEGER)), 6) AS bullish, round(avg(CAST(x < 0 AS INTEGER)), 6) AS bearish,
       round(avg(CAST(x = 0 AS INTEGER)), 6) AS neutral
FROM (SELECT doc_id, CASE WHEN word_count > 0 THEN (n_pos - n_neg) / word_count ELSE 0 END AS x FROM v_textstats) s JOIN v_calls c USING (doc_id) GROUP BY 1""",
)
def sentiment_trend(t):
    from callgauge.functions.text import tokenize
    from callgauge.operators.texts import lexicon_scores
    from callgauge.plans.views import LEXICON

    f = lexicon_scores(t.calls.withColumn("tok", tokenize(F.col("text"))), "tok", LEXICON)
    return ag.sentiment_trend(f, "lm_net_sentiment").withColumns({c: F.round(c, 6) for c in ("bullish", "bearish", "neutral")})


@query(
    "newest_signal",
    """
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(p, 6) AS p, CASE WHEN p > 0.58 THEN 'BUY' WHEN p < 0.45 THEN 'SELL' ELSE 'HOLD' END AS signal,
       CASE WHEN abs(p - 0.5) > 0.15 THEN 'High' WHEN abs(p - 0.5) > 0.07 THEN 'Medium' ELSE 'Low' END AS conviction
FROM (SELECT user_id, CAST(ts AS DATE) AS day, value / (1 + value) AS p, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def newest_signal(t):
    from callgauge.functions.text import conviction, signal

    e = t.events.select("user_id", "event_id", F.to_date("ts").alias("day"), (F.col("value") / (1 + F.col("value"))).alias("p"))
    out = ag.newest_signal(e, "p", "user_id", "day", "event_id", signal(F.col("p")))
    return out.select("user_id", day("day"), r("p"), "signal", conviction(F.col("p")).alias("conviction"))


# ---------------------------------------------------------------- windows, sorts, sets


@query(
    "running_best",
    """
SELECT user_id, event_id, max(value) OVER w AS best_so_far,
       round(CASE WHEN max(value) OVER p IS NULL THEN value WHEN value > max(value) OVER p THEN value - max(value) OVER p ELSE 0 END, 6) AS improvement,
       value = max(value) OVER w AS was_best
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_best(t):
    out = st.running_best(t.events, ["user_id"], "event_id", "value")
    return out.select("user_id", "event_id", "best_so_far", r("improvement"), "was_best")


@query("sort_by_entity_date", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders ORDER BY 1, 3, 2")
def sort_by_entity_date(t):
    return st.sort_by_entity_date(t.orders, "o_custkey", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", day("o_orderdate"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t):
    return st.top_k(t.orders, "o_totalprice", 20, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("first_rows", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 200")
def first_rows(t):
    return st.first_rows(t.events, 200, ["event_id"]).select("event_id", "user_id")


@query(
    "best_by",
    "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1",
)
def best_by(t):
    return st.best_by(t.events.select("event_type", "event_id", "value"), "value", ["event_type"], ["event_id"])


@query(
    "signed_contribution_order",
    """
SELECT feature, round(value, 6) AS value, n AS rank_in_sign FROM (
    SELECT *, row_number() OVER (PARTITION BY value < 0 ORDER BY abs(value) DESC, feature) AS n
    FROM (SELECT p_brand AS feature, avg(p_retailprice) - 1000 AS value FROM part GROUP BY 1)) WHERE (value < 0 AND n <= 2) OR (value > 0 AND n <= 3)""",
)
def signed_contribution_order(t):
    c = t.part.groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_retailprice") - 1000).alias("value"))
    return st.signed_contribution_order(c, top=(3, 2)).select("feature", r("value"), F.col("rank_in_sign").cast("long").alias("rank_in_sign"))


@query(
    "union_tables",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(close, 9) AS close, round(low, 9) AS low, CAST(NULL AS DOUBLE) AS open FROM v_prices UNION ALL
SELECT ticker, strftime(date, '%Y-%m-%d'), round(close, 9), low, open FROM v_bars""",
)
def union_tables(t):
    both = st.union_tables([t.prices.select("ticker", "date", "close", "low"), t.bars.select("ticker", "date", "close", "low", "open")])
    return both.select("ticker", day("date"), r("close", 9), F.round("low", 9).alias("low"), "open")


@query(
    "dedupe",
    """
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, event_id, value FROM (
    SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events) WHERE n = 1""",
)
def dedupe(t):
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return st.dedupe(e, ["user_id", "day"], ["event_id"]).select("user_id", day("day"), "event_id", "value")


@query(
    "extend_history",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(x, 2) AS x FROM (
    SELECT ticker, date, Total_Revenue AS x FROM v_financials UNION ALL
    SELECT l_suppkey, last_day(make_date(year(l_shipdate), 12, 1)), sum(l_extendedprice) FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM v_financials f WHERE f.ticker = l_suppkey AND f.date = last_day(make_date(year(l_shipdate), 12, 1))) GROUP BY 1, 2)""",
)
def extend_history(t):
    annual = t.lineitem.groupBy(F.col("l_suppkey").alias("ticker"), F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)).alias("date")).agg(
        F.sum("l_extendedprice").alias("x"))
    quarterly = t.financials.select("ticker", "date", F.col("Total_Revenue").alias("x"))
    return st.extend_history(quarterly, annual, ["ticker", "date"]).select("ticker", day("date"), r("x", 2))


@query(
    "append_new_bars",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, close, dividends FROM (
    SELECT ticker, date, close, CAST(1 AS BIGINT) AS dividends FROM v_bars WHERE date <= DATE '2024-01-20' UNION ALL
    SELECT ticker, date, high, 0 FROM v_bars WHERE date > (SELECT max(date) FROM v_bars WHERE date <= DATE '2024-01-20'))""",
)
def append_new_bars(t):
    stored = t.bars.filter("date <= '2024-01-20'").select("ticker", "date", "close", F.lit(1).alias("dividends"))
    fresh = t.bars.select("ticker", "date", F.col("high").alias("close"))
    out = st.append_new_bars(stored, fresh, ["ticker", "date"], "date", ["ticker", "date", "close", "dividends"])
    return out.select("ticker", day("date"), "close", F.col("dividends").cast("long").alias("dividends"))


@query(
    "snapshot_bars",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, close, dividends FROM (
    SELECT ticker, date, close, CAST(1 AS BIGINT) AS dividends FROM v_bars WHERE date <= DATE '2024-01-20' UNION ALL
    SELECT ticker, date, high, 0 FROM v_bars WHERE date > (SELECT max(date) FROM v_bars WHERE date <= DATE '2024-01-20'))""",
)
def snapshot_bars(t):
    """As append_new_bars, but each batch is a version of a stored table; the second is started twice."""
    table = SnapshotTable(t.spark, new_path(t.spark, "bars"))
    columns = ["ticker", "date", "close", "dividends"]
    stored = t.bars.filter("date <= '2024-01-20'").select("ticker", "date", "close", F.lit(1).alias("dividends"))
    fresh = t.bars.select("ticker", "date", F.col("high").alias("close"))
    for batch, bars in (("stored", stored), ("fresh", fresh), ("fresh", fresh)):
        store_new_bars(table, bars, ["ticker", "date"], "date", columns, batch)
    return table.read().select("ticker", day("date"), "close", F.col("dividends").cast("long").alias("dividends"))


# ---------------------------------------------------------------- gates and reports


@query(
    "gates",
    """
WITH n AS (SELECT count(*) AS n FROM v_aligned), c AS (SELECT count(*) AS n FROM v_calls), s AS (SELECT floor(n * 0.7) AS k, n FROM n)
SELECT 'data_volume' AS gate, CAST(n AS DOUBLE) AS measured, n >= 500 AS passed FROM n UNION ALL
SELECT 'parse_rate', round((SELECT count(*) FILTER (WHERE length(text) > 0) FROM documents) / (SELECT count(*) FROM documents), 6), TRUE UNION ALL
SELECT 'temporal_alignment', 0.0, TRUE UNION ALL
SELECT 'feature_set', 0.0, FALSE UNION ALL
SELECT 'feature_count', 13.0, FALSE UNION ALL
SELECT 'train_share', round(k / n, 6), TRUE FROM s""",
)
def gates(t):
    return _gates(t).select("gate", F.round("measured", 6).alias("measured"), "passed")


def _gates(t):
    from callgauge.operators.modeling import chronological_split

    aligned = t.stored_aligned
    split = chronological_split(aligned, "transcript_date", ["ticker", "doc_id"]).withColumnRenamed("is_train", "t")
    parts = [
        ql.data_volume_gate(aligned, 500), ql.parse_rate_gate(t.documents, F.length("text") > 0), ql.alignment_gate(aligned),
        ql.feature_gate(None, t.documents), ql.integration_gate(split, F.col("t")),
    ]
    return st.union_tables(parts)


@query(
    "run_status",
    "SELECT 'completed_with_warnings' AS status, CAST(6 AS BIGINT) AS decisions, CAST(2 + CAST(count(*) < 500 AS INTEGER) AS BIGINT) AS warnings, FALSE AS stop FROM v_aligned",
)
def run_status(t):
    return ql.run_status(_gates(t))


@query(
    "decision_counts",
    """
SELECT 'ingestion' AS agent, 'data_ingestion' AS phase, CAST(1 AS BIGINT) AS decisions, CAST(count(*) >= 500 AS BIGINT) AS passed FROM v_aligned UNION ALL
SELECT * FROM (VALUES ('preprocessing', 'preprocessing', 2, 2), ('features', 'feature_extraction', 1, 0), ('integration', 'integration', 2, 1)) x(agent, phase, decisions, passed)""",
)
def decision_counts(t):
    return ql.decision_counts(ql.decision_log([_gates(t)]))


@query(
    "model_gate",
    """
SELECT 'baseline_auc' AS gate, round(b, 6) AS measured, b >= 0.55 AS passed FROM x UNION ALL
SELECT 'improvement', round(m - b, 6), m - b >= 0.02 FROM x UNION ALL SELECT 'architecture', round(m, 6), TRUE FROM x""".replace(
        "FROM x", "FROM (SELECT max(CASE WHEN l_linenumber = 1 THEN a END) AS b, max(a) AS m FROM (SELECT l_linenumber, avg(CAST(l_discount > 0.04 AS INTEGER)) AS a FROM lineitem GROUP BY 1)) x"
    ),
)
def model_gate(t):
    m = t.lineitem.groupBy("l_linenumber").agg(F.avg((F.col("l_discount") > 0.04).cast("double")).alias("roc_auc"))
    m = m.withColumn("source", F.when(F.col("l_linenumber") == 1, "baseline").otherwise(F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))))
    return ql.model_gate(m).select("gate", F.round("measured", 6).alias("measured"), "passed")


@query(
    "stage_assertions",
    """
SELECT 'alignment rate' AS "check", round(100.0 * a / c, 6) AS measured, 100.0 * a / c >= 50 AS passed
FROM (SELECT count(*) AS a FROM v_aligned), (SELECT count(*) AS c FROM v_calls) UNION ALL
SELECT 'look-ahead rows', 0.0, TRUE UNION ALL
SELECT 'shortest text', CAST(min(length(text)) AS DOUBLE), min(length(text)) >= 1 FROM documents""",
)
def stage_assertions(t):
    one = lambda d: d.withColumn("__one", F.lit(1))
    rate = one(t.aligned.agg(F.count(F.lit(1)).alias("a"))).join(one(t.calls.agg(F.count(F.lit(1)).alias("c"))), "__one")
    out = ql.stage_assertions([
        ("alignment rate", rate, F.col("a") / F.col("c") * 100, ">=", 50),
        ("look-ahead rows", ql.lookahead_violations(t.aligned), F.col("financial_after_event"), "=", 0),
        ("shortest text", t.documents.agg(F.min(F.length("text")).alias("m")), F.col("m"), ">=", 1),
    ])
    return out.select("check", F.round("measured", 6).alias("measured"), "passed")


@query(
    "quality_report",
    """
SELECT 'summary' AS section, 'total_records' AS metric, CAST(count(*) AS DOUBLE) AS value FROM v_aligned UNION ALL
SELECT 'summary', 'unique_tickers', count(DISTINCT ticker) FROM v_aligned UNION ALL
SELECT 'summary', 'quarters_covered', count(DISTINCT quarter) FROM v_aligned UNION ALL
SELECT 'temporal_integrity', 'avg_gap_days', round(avg(financial_date_diff_days), 6) FROM v_aligned UNION ALL
SELECT 'temporal_integrity', 'max_gap_days', max(financial_date_diff_days) FROM v_aligned UNION ALL
SELECT 'temporal_integrity', 'financial_after_event', 0 UNION ALL
SELECT 'returns', 'mean', round(avg(stock_return_3day), 6) FROM v_aligned UNION ALL
SELECT 'returns', 'std', round(stddev_samp(stock_return_3day), 6) FROM v_aligned UNION ALL
SELECT 'returns', 'positive', count(*) FILTER (WHERE stock_return_3day > 0) FROM v_aligned""",
)
def quality_report(t):
    wanted = ["total_records", "unique_tickers", "quarters_covered", "avg_gap_days", "max_gap_days", "financial_after_event", "mean", "std", "positive"]
    out = ql.quality_report(t.stored_aligned, [ag.stage_counts(t.documents, "texts", F.length("text") > 0)])
    return out.filter(F.col("metric").isin(*wanted)).select("section", "metric", F.round("value", 6).alias("value"))


@query(
    "distribution_shift",
    """
SELECT round(avg(label_binary) FILTER (WHERE i < floor(n * 0.7)), 6) AS train_positive_rate, round(avg(label_binary) FILTER (WHERE i >= floor(n * 0.7)), 6) AS test_positive_rate,
       abs(avg(label_binary) FILTER (WHERE i < floor(n * 0.7)) - avg(label_binary) FILTER (WHERE i >= floor(n * 0.7))) > 0.10 AS shifted
FROM (SELECT label_binary, row_number() OVER (ORDER BY date, doc_id) - 1 AS i, count(*) OVER () AS n FROM v_scored)""",
)
def distribution_shift(t):
    from callgauge.operators.evaluation import distribution_shift as shift
    from callgauge.operators.modeling import chronological_split

    s = chronological_split(t.scored.select("doc_id", "date", "label_binary"), "date", ["doc_id"])
    return shift(s, "label_binary", F.col("is_train")).withColumns({c: F.round(c, 6) for c in ("train_positive_rate", "test_positive_rate")})


@query(
    "chronological_split",
    """
SELECT doc_id, i < floor(n * 0.7) AS is_train FROM (SELECT doc_id, row_number() OVER (ORDER BY date, ticker, doc_id) - 1 AS i, count(*) OVER () AS n FROM v_calls)""",
)
def chronological_split(t):
    from callgauge.operators.modeling import chronological_split as split

    return split(t.calls.select("doc_id", "ticker", "date"), "date", ["ticker", "doc_id"]).select("doc_id", "is_train")


@query(
    "time_series_folds",
    """
SELECT doc_id, fold, CASE WHEN i < n - (5 - fold + 1) * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM (SELECT doc_id, row_number() OVER (ORDER BY date, doc_id) - 1 AS i, count(*) OVER () AS n FROM v_calls), (SELECT unnest([1, 2, 3, 4, 5]) AS fold)
WHERE i < n - (5 - fold) * (n // 6)""",
)
def time_series_folds(t):
    from callgauge.operators.modeling import time_series_folds as folds

    return folds(t.calls.select("doc_id", "date"), "date", ["doc_id"], 5).select("doc_id", "fold", "role")

