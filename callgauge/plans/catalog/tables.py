"""Sources, sinks, shaping and projections."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from callgauge.functions import calendar as cal
from callgauge.operators import features as ft, joins as jn, projections as pj, scoring as sc
from callgauge.plans.catalog.alignment import day, r
from callgauge.plans.registry import query
from callgauge.session import new_path
from callgauge.sources import readers, shaping, sinks, snapshots


@query(
    "table_csv_roundtrip",
    "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, round(Total_Revenue, 2) AS Total_Revenue, round(Total_Equity, 2) AS Total_Equity FROM v_financials",
)
def table_csv_roundtrip(t):
    path = sinks.write_table(t.financials, new_path(t.spark, "statements"), "csv")
    back = readers.read_table(t.spark, path, t.financials.schema, "csv")
    return back.select("ticker", day("date"), r("Total_Revenue", 2), r("Total_Equity", 2))


@query(
    "table_parquet_roundtrip",
    "SELECT quarter, count(*) AS n, count(DISTINCT ticker) AS tickers FROM v_calls GROUP BY 1",
)
def table_parquet_roundtrip(t):
    path = sinks.write_table(t.calls.drop("text").repartition("quarter"), new_path(t.spark, "calls"), "parquet", ["quarter"])
    return readers.read_table(t.spark, path).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"))


@query(
    "records_json_roundtrip",
    "SELECT doc_id, quarter, strftime(date, '%Y-%m-%d') AS date, md5(text) AS digest FROM v_calls",
)
def records_json_roundtrip(t):
    path = sinks.write_records_json(t.calls, new_path(t.spark, "records"))
    back = readers.read_transcripts_json(t.spark, path, t.calls.schema, lines=True)
    return back.select("doc_id", "quarter", day("date"), F.md5("text").alias("digest"))


@query(
    "metadata_projection_roundtrip",
    "SELECT doc_id, ticker, quarter, source FROM v_calls",
)
def metadata_projection_roundtrip(t):
    path = sinks.write_metadata_projection(t.calls, ["doc_id", "ticker", "quarter", "source"], new_path(t.spark, "metadata"))
    return readers.read_table(t.spark, path, "doc_id long, ticker long, quarter string, source string", "csv")


@query("run_stats_roundtrip", "SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS english FROM documents")
def run_stats_roundtrip(t):
    stats = t.documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("english"))
    return t.spark.read.schema("total long, english long").json(sinks.write_run_stats(stats, new_path(t.spark, "stats")))


@query(
    "text_by_key_roundtrip",
    """
SELECT lang, source, count(*) * 6 + CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) + count(*) AS lines,
       count(*) FILTER (WHERE TRUE) AS headers
FROM documents GROUP BY 1, 2""",
)
def text_by_key_roundtrip(t):
    d = t.documents.select("lang", "source", "text", F.lit("Some Company").alias("company_name"), F.lit("1999-01-01").alias("date"))
    path = sinks.write_text_by_key(d, new_path(t.spark, "texts"), "text", ["lang", "source"])
    back = t.spark.read.schema("value string, lang string, source string").option("lineSep", "\n").text(path)
    return back.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").startswith("Company: Some")).alias("headers"))


@query(
    "statements_to_long",
    """
SELECT s.k AS Ticker, y.y || '-12-31' AS Date, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 2) AS A,
       round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 2) AS N
FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) s CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem) y
LEFT JOIN lineitem ON l_suppkey = s.k AND year(l_shipdate) = y.y GROUP BY 1, 2""",
)
def statements_to_long(t):
    """A statement with one column per year end, turned into one row per year end."""
    years = sorted(row[0] for row in t.lineitem.select(F.year("l_shipdate")).distinct().collect())
    wide = t.lineitem.groupBy(F.col("l_suppkey").alias("Ticker"), F.col("l_returnflag").alias("item")).agg(*[
        F.sum(F.when(F.year("l_shipdate") == y, F.col("l_extendedprice"))).alias(f"{y}-12-31") for y in years
    ])
    out = shaping.statements_to_long(wide, "item", [f"{y}-12-31" for y in years], ["A", "N"])
    return out.select("Ticker", day("Date"), r("A", 2), r("N", 2))


@query(
    "shape_tickers",
    "SELECT 'S-' || s_suppkey || '-X' AS Ticker, s_name AS Company_Name, CAST(s_nationkey AS VARCHAR) AS Sector, '2026-02-08' AS Collection_Date FROM supplier",
)
def shape_tickers(t):
    raw = t.supplier.select(
        F.concat(F.lit("S."), F.col("s_suppkey").cast("string"), F.lit(".X")).alias("Symbol"), F.col("s_name").alias("Security"),
        F.col("s_nationkey").cast("string").alias("GICS Sector"), F.lit("").alias("GICS Sub-Industry"), F.lit("").alias("Headquarters Location"),
        F.lit("").alias("Date added"), F.lit("").alias("Founded"),
    )
    return shaping.shape_tickers(raw, "2026-02-08").select("Ticker", "Company_Name", "Sector", day("Collection_Date"))


@query(
    "incremental_score",
    """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'stored' ELSE 'scored' END AS origin, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END AS score
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def incremental_score(t):
    """Labelled documents are done already; the others get scored."""
    done = t.labels.select("doc_id", F.lit("stored").alias("origin"), F.col("quality").cast("long").alias("score"))
    score = lambda d: d.select("doc_id", F.lit("scored").alias("origin"), F.col("n_chars").alias("score"))
    return sc.incremental_score(t.documents, done, ["doc_id"], score)


@query(
    "snapshot_scores",
    """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE 'rest' END AS batch, d.n_chars AS score, 2 AS versions
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def snapshot_scores(t):
    """Labelled documents come first, then all; the second run is started twice."""
    table = snapshots.SnapshotTable(t.spark, new_path(t.spark, "scores"))
    labelled = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    for batch, rows in (("labelled", labelled), ("rest", t.documents), ("rest", t.documents)):
        snapshots.score_new(table, rows, ["doc_id"], lambda d, b=batch: d.select("doc_id", F.lit(b).alias("batch"), F.col("n_chars").alias("score")), batch)
    return table.read().withColumn("versions", F.lit(len(table.versions())))


@query("collection_log", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS loaded FROM customer")
def collection_log(t):
    return shaping.collection_log(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "collection_rate",
    """
SELECT count(*) FILTER (WHERE x) AS succeeded, count(*) FILTER (WHERE NOT x) AS failed, round(avg(CAST(x AS INTEGER)), 6) AS success_rate
FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS x FROM customer)""",
)
def collection_rate(t):
    log = shaping.collection_log(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return shaping.collection_rate(log).withColumn("success_rate", F.round("success_rate", 6))


@query(
    "flatten_results",
    """
SELECT 'run_' || lang AS run, 'set_' || lang AS feature_set, 'logistic_regression' AS model, 'roc_auc' AS metric, round(avg(n_chars), 6) AS value FROM documents GROUP BY lang UNION ALL
SELECT 'run_' || lang, 'set_' || lang, 'logistic_regression', 'f1', CAST(count(*) AS DOUBLE) FROM documents GROUP BY lang""",
)
def flatten_results(t):
    """Nested result files as they come from fitted models, one per language here."""
    stats = t.documents.groupBy("lang").agg(F.avg("n_chars").alias("a"), F.count(F.lit(1)).alias("n"))
    body = F.create_map(
        F.concat(F.lit("run_"), F.col("lang")),
        F.struct(F.concat(F.lit("set_"), F.col("lang")).alias("feature_set"), F.struct(F.col("a").alias("roc_auc"), F.col("n").alias("f1")).alias("logistic_regression")),
    )
    path = new_path(t.spark, "results")
    stats.repartition("lang").select(F.to_json(body).alias("value"), "lang").write.partitionBy("lang").text(path)
    return readers.flatten_results(t.spark, os.path.join(path, "*")).select("run", "feature_set", "model", "metric", r("value"))


# ---------------------------------------------------------------- projections


@query("filter_real_only", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src4')")
def filter_real_only(t):
    marked = F.when(F.col("source") == "src3", "synthetic").when(F.col("source") == "src4", "Synthetic").when(F.col("source") == "src5", F.lit(None)).otherwise(F.col("source"))
    return pj.filter_real_only(t.documents.withColumn("kind", marked), "kind").select("doc_id", "source")


@query(
    "filter_results",
    "SELECT doc_id, quarter, round(abnormal_return, 6) AS abnormal_return FROM v_targets WHERE quarter IN ('Q1 1996', 'Q3 1998', 'Q4 2000') AND abnormal_return > 0",
)
def filter_results(t):
    out = pj.filter_results(t.targets, [], ["Q1 1996", "Q3 1998", "Q4 2000"], "Positive")
    return out.select("doc_id", "quarter", r("abnormal_return"))


@query(
    "model_feature_sets",
    """
SELECT 'financial_only' AS feature_set, CAST(9 AS BIGINT) AS columns, count(*) AS rows FROM v_aligned UNION ALL
SELECT 'sentiment_only', 0, count(*) FROM v_aligned UNION ALL SELECT 'combined', 12, count(*) FROM v_aligned UNION ALL SELECT 'full_with_finbert', 12, count(*) FROM v_aligned""",
)
def model_feature_sets(t):
    sets = pj.model_feature_sets(t.aligned.columns)
    rows = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.lit(len(c)).cast("long").alias("columns")) for n, c in sets.items()])
    return t.aligned.agg(F.count(F.lit(1)).alias("rows")).withColumn("x", F.explode(rows)).select("x.feature_set", "x.columns", "rows")


@query(
    "leak_free_numeric",
    "SELECT doc_id, round(financial_Total_Revenue, 2) AS financial_Total_Revenue, round(financial_Total_Debt, 2) AS financial_Total_Debt FROM v_targets",
)
def leak_free_numeric(t):
    """Without leaking, text and constant columns only measures are left."""
    d = t.stored_targets.withColumn("same_everywhere", F.lit(1.0)).withColumn("nothing", F.lit(None).cast("double"))
    numeric, _ = pj.numeric_only(pj.drop_leak_patterns(pj.drop_leak_columns(d)))
    left = ft.drop_constant_columns(numeric)
    assert not {"same_everywhere", "nothing", "abnormal_return"} & set(left.columns)
    return left.select("doc_id", r("financial_Total_Revenue", 2), r("financial_Total_Debt", 2))


@query(
    "coerce_numeric",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS t FROM events",
)
def coerce_numeric(t):
    d = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("t"))
    return pj.coerce_numeric(d, ["k", "t"])


@query(
    "results_view",
    """
SELECT ticker AS "Company", quarter AS "Quarter", round(abnormal_return, 6) AS "Gain vs Market", round(stock_return_3day, 6) AS "3-Day Return",
       label_binary AS "Beat Market (1=Yes)" FROM v_labelled""",
)
def results_view(t):
    out = pj.results_view(ft.labels(t.stored_targets))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ("Gain vs Market", "3-Day Return")})


# ---------------------------------------------------------------- calendar


@query(
    "calendar",
    """
SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label,
       strftime(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH), '%Y-%m-%d') AS quarter_end,
       strftime(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) + 21, '%Y-%m-%d') AS call_date,
       'Q' || quarter(o_orderdate) AS by_month, CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS BIGINT) AS days_left,
       strftime(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) END, '%Y-%m-%d') AS event_date,
       CAST(o_orderdate - INTERVAL 3 HOUR AS TIMESTAMP) = o_orderdate - INTERVAL 3 HOUR AS utc_ok, TRUE AS bad_label_is_null
FROM orders""",
)
def calendar(t):
    d = t.orders.withColumn("label", cal.quarter_label(F.col("o_orderdate")))
    own = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    zoned = cal.to_utc(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+03:00")))
    return d.select(
        "o_orderkey", "label", day(cal.quarter_end(F.col("label")), "quarter_end"), day(cal.call_date_after_quarter(F.col("label")), "call_date"),
        cal.quarter_of_month_abbr(F.date_format("o_orderdate", "MMM")).alias("by_month"),
        cal.days_between(F.lit("2002-01-01 12:00:00").cast("timestamp"), F.col("o_orderdate")).cast("long").alias("days_left"),
        day(cal.event_date(own, F.col("label")), "event_date"),
        (F.unix_seconds(zoned) == F.unix_seconds(F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))) - 3 * 3600).alias("utc_ok"),
        cal.quarter_end(F.replace("label", F.lit("Q"), F.lit("X"))).isNull().alias("bad_label_is_null"),
    )


@query(
    "pairwise_models",
    """
SELECT a.user_id, a.event_type AS model_1, b.event_type AS model_2, round(a.v, 6) AS score_1, round(b.v, 6) AS score_2
FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) a JOIN (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) b
  ON a.user_id = b.user_id AND a.event_type < b.event_type""",
)
def pairwise_models(t):
    s = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return jn.pairwise_models(s, ["user_id"], "event_type", "v").select("user_id", "model_1", "model_2", r("score_1"), r("score_2"))
