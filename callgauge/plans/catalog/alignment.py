"""Joins over time, and the labels and gates that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgauge.operators import alignment as al, aggregates as ag, features as ft, joins as jn, ordering as od, quality as ql, sets as st
from callgauge.plans.registry import query


def day(c, name=None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or (c if isinstance(c, str) else None))


def r(c, n=6, name=None):
    return F.round(c, n).alias(name or c)


@query(
    "beat_the_market",
    """
SELECT doc_id, ticker, strftime(transcript_date, '%Y-%m-%d') AS transcript_date, strftime(financial_date, '%Y-%m-%d') AS financial_date,
       financial_match_type, strftime(market_date_before, '%Y-%m-%d') AS market_date_before,
       strftime(market_date_after, '%Y-%m-%d') AS market_date_after, round(stock_return_3day, 6) AS stock_return_3day,
       round(sp500_return_3day, 6) AS sp500_return_3day, round(abnormal_return, 6) AS abnormal_return,
       label_binary, label_median, label_tertile
FROM v_labelled""",
)
def beat_the_market(t):
    """For each call: which statement and price window apply, and did the stock beat the market?"""
    out = ft.labels(t.stored_targets)
    return out.select(
        "doc_id", "ticker", day("transcript_date"), day("financial_date"), "financial_match_type", day("market_date_before"),
        day("market_date_after"), r("stock_return_3day"), r("sp500_return_3day"), r("abnormal_return"),
        "label_binary", "label_median", "label_tertile",
    )


@query(
    "asof_tiered",
    """
SELECT m.doc_id, m.ticker, m.match_type, CASE WHEN m.match_type IN ('tight', 'fallback') THEN strftime(m.fdate, '%Y-%m-%d') END AS financial_date,
       CASE WHEN m.match_type IN ('tight', 'fallback') THEN round(f.Total_Revenue, 2) END AS revenue
FROM v_match m LEFT JOIN v_financials f ON f.ticker = m.ticker AND f.date = m.fdate""",
)
def asof_tiered(t):
    out = al.asof_tiered(t.calls.drop("text"), t.financials, ["ticker"], "date", "date", ["Total_Revenue"])
    return out.select("doc_id", "ticker", "match_type", day("statement.date", "financial_date"), r("statement.Total_Revenue", 2, "revenue"))


@query(
    "asof_by_clock",
    """
SELECT c.event_id, CAST(epoch_us(max(f.ts) FILTER (WHERE f.ts <= c.ts)) AS BIGINT) AS view_us,
       CASE WHEN count(f.ts) = 0 THEN 'no_ticker' WHEN min(f.ts) > c.ts THEN 'all_future'
            WHEN c.ts - max(f.ts) FILTER (WHERE f.ts <= c.ts) < INTERVAL 3 DAY THEN 'tight' ELSE 'other' END AS kind
FROM (SELECT * FROM events WHERE event_type = 'purchase') c
LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') f USING (user_id)
GROUP BY c.event_id, c.ts""",
)
def asof_by_clock(t):
    """Last view at or before each purchase of the same user, compared by clock time."""
    facts = t.events.filter("event_type = 'view'").select("user_id", "ts", "value")
    asks = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = al.asof_tiered(asks, facts, ["user_id"], "ts", "ts", ["value"], tight=2, fallback=40)
    kind = F.when(F.col("match_type").isin("fallback", "too_stale"), "other").otherwise(F.col("match_type"))
    return out.select("event_id", F.unix_micros(F.col("statement.ts").cast("timestamp")).alias("view_us"), kind.alias("kind"))


@query(
    "asof_by_date",
    """
SELECT c.event_id, CAST(date_diff('day', max(f.d) FILTER (WHERE f.d <= c.d), c.d) AS DOUBLE) AS days
FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase') c
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view') f USING (user_id)
GROUP BY c.event_id, c.d""",
)
def asof_by_date(t):
    """The same lookup by calendar day: a view later on the day of the purchase counts."""
    facts = t.events.filter("event_type = 'view'").select("user_id", "ts", "value")
    asks = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = al.asof_tiered(asks, facts, ["user_id"], "ts", "ts", ["value"], tight=2, fallback=40, by_date=True)
    return out.select("event_id", F.col("match_days").cast("double").alias("days"))


@query(
    "asof_orders",
    """
SELECT o.o_orderkey, strftime(max(p.o_orderdate), '%Y-%m-%d') AS last_urgent
FROM orders o LEFT JOIN (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT') p
  ON p.o_custkey = o.o_custkey AND p.o_orderdate <= o.o_orderdate GROUP BY o.o_orderkey""",
)
def asof_orders(t):
    """Newest urgent order of the customer at each order: both sides large, no limit on the gap."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.to_date("o_orderdate").alias("u"))
    orders = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    out = od.asof(orders, urgent, ["o_custkey"], "d", "u", [])
    return out.select("o_orderkey", day("match.u", "last_urgent"))


@query(
    "event_window_prices",
    """
SELECT doc_id, CASE WHEN after_date IS NOT NULL THEN strftime(before_date, '%Y-%m-%d') END AS market_date_before,
       CASE WHEN before_date IS NOT NULL THEN strftime(after_date, '%Y-%m-%d') END AS market_date_after, round(ret, 6) AS stock_return_3day
FROM v_window""",
)
def event_window_prices(t):
    out = al.event_window_prices(t.calls.drop("text"), t.prices, ["ticker"], "date", "date", "close")
    return out.select("doc_id", day("market_date_before"), day("market_date_after"), r("stock_return_3day"))


@query(
    "align",
    """
SELECT doc_id, quarter, strftime(transcript_date, '%Y-%m-%d') AS transcript_date, CAST(financial_date_diff_days AS BIGINT) AS gap,
       financial_match_type, round(price_before_earnings, 7) AS price_before, round(price_after_earnings, 7) AS price_after,
       round(financial_Net_Income, 3) AS financial_Net_Income, round(financial_Total_Equity, 2) AS financial_Total_Equity
FROM v_aligned""",
)
def align(t):
    return t.aligned.select(
        "doc_id", "quarter", day("transcript_date"), F.col("financial_date_diff_days").cast("long").alias("gap"), "financial_match_type",
        r("price_before_earnings", 7, "price_before"), r("price_after_earnings", 7, "price_after"),
        r("financial_Net_Income", 3), r("financial_Total_Equity", 2),
    )


@query(
    "alignment_rejects",
    """
SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN m.match_type NOT IN ('tight', 'fallback') THEN m.match_type
                WHEN w.before_date IS NULL OR w.after_date IS NULL THEN 'missing_market_data' ELSE 'aligned' END AS reason
    FROM v_match m JOIN v_window w USING (doc_id)) WHERE reason <> 'aligned' GROUP BY 1""",
)
def alignment_rejects(t):
    out = al.alignment_rejects(t.calls.drop("text"), t.financials, t.prices)
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "benchmark_window_return",
    "SELECT doc_id, round(sp500_return_3day, 6) AS sp500_return_3day, round(abnormal_return, 6) AS abnormal_return FROM v_targets",
)
def benchmark_window_return(t):
    return t.targets.select("doc_id", r("sp500_return_3day"), r("abnormal_return"))


@query(
    "labels",
    """
SELECT label_binary, label_median, label_tertile, count(*) AS n, round(avg(abnormal_return), 6) AS mean_return
FROM v_labelled GROUP BY 1, 2, 3""",
)
def labels(t):
    out = ft.labels(t.stored_targets)
    return out.groupBy("label_binary", "label_median", "label_tertile").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("abnormal_return"), 6).alias("mean_return")
    )


@query(
    "lookahead_violations",
    """
SELECT count(*) FILTER (WHERE financial_date > transcript_date) AS financial_after_event,
       count(*) FILTER (WHERE market_date_before > transcript_date) AS before_after_event,
       count(*) FILTER (WHERE market_date_after <= transcript_date) AS after_not_after_event,
       bool_and(financial_date <= transcript_date AND market_date_before <= transcript_date AND market_date_after > transcript_date) AS passed
FROM v_aligned""",
)
def lookahead_violations(t):
    return ql.lookahead_violations(t.aligned)


@query(
    "target_violations",
    """
SELECT count(*) FILTER (WHERE market_date_after < transcript_date) AS after_before_event,
       count(*) FILTER (WHERE market_date_before > transcript_date) AS before_after_event,
       count(*) FILTER (WHERE NOT is_temporally_valid) AS flagged_invalid, TRUE AS passed
FROM v_targets""",
)
def target_violations(t):
    return ql.target_violations(t.targets)


@query(
    "nth_bar_after",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date,
       strftime(coalesce(lead(date, 3) OVER w, lead(date, 2) OVER w, lead(date, 1) OVER w), '%Y-%m-%d') AS after_date,
       round(coalesce(lead(close, 3) OVER w, lead(close, 2) OVER w, lead(close, 1) OVER w), 9) AS after_close
FROM v_prices WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
)
def nth_bar_after(t):
    out = od.nth_after(t.prices, ["ticker"], "date", 3, ["close"])
    return out.select("ticker", day("date"), day("after.date", "after_date"), r("after.close", 9, "after_close"))


@query(
    "fill_forward",
    """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date,
       round(last_value(Net_Income IGNORE NULLS) OVER w, 3) AS Net_Income, round(last_value(Current_Assets IGNORE NULLS) OVER w, 2) AS Current_Assets
FROM v_gappy WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def fill_forward(t):
    out = od.fill_forward(t.gappy, ["ticker"], "date", ["Net_Income", "Current_Assets"])
    return out.select("ticker", day("date"), r("Net_Income", 3), r("Current_Assets", 2))


@query(
    "chronological_index",
    "SELECT doc_id, row_number() OVER (ORDER BY date, ticker, doc_id) - 1 AS idx FROM v_calls",
)
def chronological_index(t):
    return od.chronological_index(t.calls.select("doc_id", "ticker", "date"), "date", ["ticker", "doc_id"]).select("doc_id", "idx")


@query(
    "chronological_index_orders",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders",
)
def chronological_index_orders(t):
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return od.chronological_index(d, "d", ["o_orderkey"]).select("o_orderkey", "idx")


@query(
    "join_statements",
    """
SELECT i.l_suppkey AS Ticker, strftime(i.d, '%Y-%m-%d') AS Date, round(i.x, 2) AS Total_Revenue, round(b.x, 2) AS Total_Assets,
       round(c.x, 2) AS Free_Cash_Flow, CAST(NULL AS DOUBLE) AS Gross_Profit
FROM (SELECT l_suppkey, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS d, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2) i
LEFT JOIN (SELECT l_suppkey, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS d, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) b USING (l_suppkey, d)
LEFT JOIN (SELECT l_suppkey, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS d, sum(l_tax) AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) c USING (l_suppkey, d)""",
)
def join_statements(t):
    end = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
    part = lambda d, c, name: d.groupBy(F.col("l_suppkey").alias("Ticker"), end.alias("Date")).agg(F.sum(c).alias(name))
    li = t.lineitem
    out = jn.join_statements(
        part(li, "l_extendedprice", "Total Revenue"), part(li.filter("l_returnflag = 'A'"), "l_quantity", "Total Assets"),
        part(li.filter("l_linestatus = 'O'"), "l_tax", "Free Cash Flow"),
    )
    return out.select("Ticker", day("Date"), r("Total_Revenue", 2), r("Total_Assets", 2), r("Free_Cash_Flow", 2), "Gross_Profit")


@query(
    "fuse_features",
    """
SELECT a.doc_id, a.financial_match_type, round(s.word_count, 6) AS word_count, s.label AS label, round(n.word_count, 6) AS word_count_nlp,
       round(a.stock_return_3day, 6) AS stock_return_3day
FROM v_aligned a LEFT JOIN (SELECT doc_id, CAST(n_chars AS DOUBLE) AS word_count, quality AS label FROM documents JOIN labels USING (doc_id)) s USING (doc_id)
LEFT JOIN v_textstats n USING (doc_id)""",
)
def fuse_features(t):
    from callgauge.functions.text import tokenize
    from callgauge.operators.texts import text_statistics

    sent = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("word_count"), F.col("quality").alias("label"), "lang")
    nlp = text_statistics(t.documents.withColumn("tok", tokenize(F.col("text"))), "text", "tok").select("doc_id", "word_count", "lang")
    out = jn.fuse_features(t.aligned, sent, nlp, ["doc_id"])
    return out.select(
        "doc_id", "financial_match_type", r("word_count"), "label", r(F.col("word_count_nlp").cast("double"), 6, "word_count_nlp"), r("stock_return_3day"),
    )


@query(
    "only_aligned",
    "SELECT c.doc_id, c.lang FROM v_calls c WHERE EXISTS (SELECT 1 FROM v_aligned a WHERE a.ticker = c.ticker AND a.quarter = c.quarter)",
)
def only_aligned(t):
    return jn.only_aligned(t.calls.drop("text"), t.aligned).select("doc_id", "lang")


@query(
    "first_source_wins",
    """
SELECT user_id, day, origin, round(v, 4) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY p) AS n FROM (
        SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, 'purchase' AS origin, max(value) AS v, 0 AS p FROM events WHERE event_type = 'purchase' GROUP BY 1, 2
        UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d'), 'click', max(value), 1 FROM events WHERE event_type = 'click' GROUP BY 1, 2
        UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d'), 'view', max(value), 2 FROM events WHERE event_type = 'view' GROUP BY 1, 2
        UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d'), 'signup', max(value), 3 FROM events WHERE event_type = 'signup' GROUP BY 1, 2
        UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d'), 'error', max(value), 4 FROM events WHERE event_type = 'error' GROUP BY 1, 2)) WHERE n = 1""",
)
def first_source_wins(t):
    parts = [
        t.events.filter(F.col("event_type") == k).groupBy("user_id", day("ts", "day")).agg(F.max("value").alias("v")).withColumn("origin", F.lit(k))
        for k in ("purchase", "click", "view", "signup", "error")
    ]
    return jn.first_source_wins(parts, ["user_id", "day"]).select("user_id", "day", "origin", r("v", 4))


@query(
    "map_quarter_to_call_date",
    """
SELECT doc_id, quarter, strftime(last_day(last_day(make_date(CAST(right(quarter, 4) AS INTEGER), CAST(quarter[2] AS INTEGER) * 3, 1)) + INTERVAL 1 DAY), '%Y-%m-%d') AS date
FROM v_calls""",
)
def map_quarter_to_call_date(t):
    return jn.map_quarter_to_call_date(t.calls.select("doc_id", "quarter")).select("doc_id", "quarter", day("date"))


@query(
    "ingest_gate",
    "SELECT doc_id FROM v_calls WHERE date <= DATE '2000-12-31'",
)
def ingest_gate(t):
    return jn.ingest_gate(t.calls, "date", "2000-12-31").select("doc_id")


@query(
    "missing_entity_periods",
    """
SELECT s.ticker, q.quarter FROM (SELECT DISTINCT ticker FROM v_financials) s, (SELECT DISTINCT quarter FROM v_calls) q
WHERE NOT EXISTS (SELECT 1 FROM v_calls c WHERE c.ticker = s.ticker AND c.quarter = q.quarter)""",
)
def missing_entity_periods(t):
    quarters = [row[0] for row in t.calls.select("quarter").distinct().collect()]
    return jn.missing_entity_periods(t.financials, quarters, t.calls)


@query(
    "entity_timeline",
    """
SELECT ticker, string_agg('Q' || quarter(date) || ' ' || year(date) || ' ' || strftime(date + 21, '%Y-%m-%d'), ';' ORDER BY date) AS timeline
FROM v_financials GROUP BY 1""",
)
def entity_timeline(t):
    out = st.entity_timeline(t.financials, "ticker", "date")
    item = lambda x: F.concat_ws(" ", x["quarter"], F.date_format(x["call_date"], "yyyy-MM-dd"))
    return out.select("ticker", F.array_join(F.transform("timeline", item), ";").alias("timeline"))


@query(
    "gap_stats",
    """
SELECT round(avg(financial_date_diff_days), 6) AS avg_gap_days, median(financial_date_diff_days) AS median_gap_days, max(financial_date_diff_days) AS max_gap_days,
       count(*) FILTER (WHERE financial_match_type = 'tight') AS tight, count(*) FILTER (WHERE financial_match_type = 'fallback') AS fallback,
       round(avg(financial_date_diff_days) FILTER (WHERE financial_match_type = 'fallback'), 6) AS fallback_avg_gap_days
FROM v_aligned""",
)
def gap_stats(t):
    return ag.gap_stats(t.aligned).withColumns({c: F.round(c, 6) for c in ("avg_gap_days", "fallback_avg_gap_days")})
