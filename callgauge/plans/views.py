"""Views that let the given parquet tables play calls, statements and prices.

Each view exists twice: as a DataFrame, and as the SQL the checks use.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.functions.calendar import quarter_label
from callgauge.session import materialize

# words of the invented prose that stand in for a lexicon
LEXICON = {
    "positive": ["that", "with"],
    "negative": ["this", "from"],
    "uncertainty": ["the"],
    "litigious": ["license"],
    "constraining": ["and"],
}

MEASURES = [
    "Total_Revenue", "Net_Income", "Total_Debt", "Tax_Provision", "Total_Assets",
    "Current_Assets", "Current_Liabilities", "Total_Equity",
]


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


class Tables:
    """The parquet tables of one folder and the views on them; nothing is read until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def prices(self) -> DataFrame:
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        return self.lineitem.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
            F.min(unit).alias("low"), F.max(unit).alias("high"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"),
        )

    @cached_property
    def index(self) -> DataFrame:
        return self.lineitem.groupBy(F.to_date("l_shipdate").alias("date")).agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")
        )

    @cached_property
    def financials(self) -> DataFrame:
        """Quarterly statements of all orders."""
        d = F.to_date("l_shipdate")
        end = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
        price, qty = F.col("l_extendedprice"), F.col("l_quantity")
        flag = lambda k: F.sum(F.when(F.col("l_returnflag") == k, price))
        return self.lineitem.groupBy(F.col("l_suppkey").alias("ticker"), end.alias("date")).agg(
            F.sum(price).alias("Total_Revenue"), F.sum(price * (1 - F.col("l_discount"))).alias("Net_Income"),
            F.sum(price * F.col("l_discount")).alias("Total_Debt"), F.sum(price * F.col("l_tax")).alias("Tax_Provision"),
            F.sum(qty).alias("Total_Assets"), flag("A").alias("Current_Assets"),
            flag("N").alias("Current_Liabilities"), flag("R").alias("Total_Equity"),
        )

    @cached_property
    def gappy(self) -> DataFrame:
        """Statements with missing values in two measures and a zero in one."""
        q = F.quarter("date")
        return self.financials.withColumns({
            "Net_Income": F.when((F.col("ticker") + q) % 5 != 0, F.col("Net_Income")),
            "Current_Assets": F.when((F.col("ticker") + 2 * q) % 7 > 1, F.col("Current_Assets")),
            "Total_Equity": F.when((F.col("ticker") + q) % 11 == 0, F.lit(0.0)).otherwise(F.col("Total_Equity")),
        })

    @cached_property
    def calls(self) -> DataFrame:
        suppliers = self.supplier.count()
        date = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") * 37 % 2500).cast("int"))
        return self.documents.select(
            "doc_id", (F.col("doc_id") % F.lit(suppliers)).alias("ticker"), date.alias("date"),
            quarter_label(date).alias("quarter"), "text", "lang", "source",
        )

    @cached_property
    def aligned(self) -> DataFrame:
        from callgauge.operators.alignment import align

        return align(self.calls.drop("text"), self.financials, self.prices)

    @cached_property
    def targets(self) -> DataFrame:
        """Aligned calls with index return, abnormal return and labels."""
        from callgauge.operators.alignment import abnormal_return, benchmark_window_return

        out = benchmark_window_return(self.aligned, self.index, "market_date_before", "market_date_after")
        return out.withColumn("abnormal_return", abnormal_return(F.col("stock_return_3day"), F.col("sp500_return_3day")))

    @cached_property
    def stored_aligned(self) -> DataFrame:
        """The aligned table as a stage writes it, for queries that pass over it several times."""
        return materialize(self.aligned, "aligned")

    @cached_property
    def stored_targets(self) -> DataFrame:
        return materialize(self.targets, "targets")

    @cached_property
    def stored_scored(self) -> DataFrame:
        return materialize(self.scored, "scored")

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars of the event values per user."""
        at = F.struct("ts", "event_id")
        return self.events.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        """Conversation turns as role texts: the assistant speaks for management, others ask."""
        manages = F.col("role") == "assistant"
        return self.conversations.select(
            "conv_id", "turn", "role", F.when(manages, F.col("text")).otherwise("").alias("management_text"),
            F.when(manages, "").otherwise(F.col("text")).alias("analyst_text"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """Lexicon and text features of every document."""
        from callgauge.operators.texts import nlp_features

        return nlp_features(self.calls.withColumnRenamed("text", "full_text"), LEXICON, ["doc_id", "ticker", "quarter", "date"])

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled documents with text statistics: the table models are fitted on."""
        from callgauge.functions.text import tokenize
        from callgauge.operators.texts import lexicon_scores, text_statistics

        rows = self.labels.join(self.calls, "doc_id").withColumn("tok", tokenize(F.col("text")))
        rows = lexicon_scores(text_statistics(rows, "text", "tok"), "tok", LEXICON)
        return rows.select(
            "doc_id", "date", "lang", "source", F.col("quality").alias("label_binary"), "toxic", "word_count", "sentence_count",
            "avg_word_length", "avg_sentence_length", "unique_words", "lexical_diversity",
            "lm_negative", "lm_positive", "lm_uncertainty", "lm_constraining", "lm_net_sentiment",
        )


TEXT_FEATURES = ["word_count", "sentence_count", "avg_word_length", "avg_sentence_length", "unique_words", "lexical_diversity"]
LEXICON_FEATURES = ["lm_negative", "lm_positive", "lm_uncertainty", "lm_constraining", "lm_net_sentiment"]

VIEW_SQL = {
    "v_prices": """
SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice / l_quantity) AS low,
       max(l_extendedprice / l_quantity) AS high, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
FROM lineitem GROUP BY 1, 2""",
    "v_index": """
SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1""",
    "v_financials": """
SELECT l_suppkey AS ticker, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS date,
       sum(l_extendedprice) AS Total_Revenue, sum(l_extendedprice * (1 - l_discount)) AS Net_Income,
       sum(l_extendedprice * l_discount) AS Total_Debt, sum(l_extendedprice * l_tax) AS Tax_Provision,
       sum(l_quantity) AS Total_Assets, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS Current_Assets,
       sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS Current_Liabilities,
       sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS Total_Equity
FROM lineitem GROUP BY 1, 2""",
    "v_gappy": """
SELECT ticker, date, Total_Revenue, CASE WHEN (ticker + quarter(date)) % 5 <> 0 THEN Net_Income END AS Net_Income,
       Total_Debt, Tax_Provision, Total_Assets,
       CASE WHEN (ticker + 2 * quarter(date)) % 7 > 1 THEN Current_Assets END AS Current_Assets, Current_Liabilities,
       CASE WHEN (ticker + quarter(date)) % 11 = 0 THEN 0.0 ELSE Total_Equity END AS Total_Equity
FROM v_financials""",
    "v_calls": """
SELECT doc_id, doc_id % (SELECT count(*) FROM supplier) AS ticker,
       DATE '1995-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER) AS date,
       'Q' || quarter(DATE '1995-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER)) || ' '
           || year(DATE '1995-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER)) AS quarter,
       text, lang, source
FROM documents""",
    "v_statement_of": """
SELECT c.doc_id, max(f.date) FILTER (WHERE f.date <= c.date) AS fdate, count(f.date) AS n_any
FROM v_calls c LEFT JOIN v_financials f ON f.ticker = c.ticker GROUP BY c.doc_id""",
    "v_match": """
SELECT c.doc_id, c.ticker, c.date, s.fdate, c.date - s.fdate AS days,
       CASE WHEN s.n_any = 0 THEN 'no_ticker' WHEN s.fdate IS NULL THEN 'all_future' WHEN c.date - s.fdate <= 120 THEN 'tight'
            WHEN c.date - s.fdate <= 180 THEN 'fallback' ELSE 'too_stale' END AS match_type
FROM v_calls c JOIN v_statement_of s USING (doc_id)""",
    "v_before": """
SELECT c.doc_id, max(p.date) AS before_date FROM v_calls c JOIN v_prices p ON p.ticker = c.ticker AND p.date <= c.date GROUP BY 1""",
    "v_after": """
SELECT doc_id, max(date) AS after_date FROM (
    SELECT c.doc_id, p.date, row_number() OVER (PARTITION BY c.doc_id ORDER BY p.date) AS n
    FROM v_calls c JOIN v_prices p ON p.ticker = c.ticker AND p.date > c.date) WHERE n <= 3 GROUP BY 1""",
    "v_window": """
SELECT c.doc_id, c.ticker, c.date, b.before_date, a.after_date, p.close AS price_before, q.close AS price_after,
       (q.close - p.close) / p.close AS ret
FROM v_calls c LEFT JOIN (v_before b JOIN v_after a USING (doc_id)) USING (doc_id)
LEFT JOIN v_prices p ON p.ticker = c.ticker AND p.date = b.before_date
LEFT JOIN v_prices q ON q.ticker = c.ticker AND q.date = a.after_date""",
    "v_aligned": """
SELECT c.doc_id, c.ticker, c.quarter, c.lang, c.source, c.date AS transcript_date, m.fdate AS financial_date,
       m.days AS financial_date_diff_days, m.match_type AS financial_match_type, w.before_date AS market_date_before,
       w.after_date AS market_date_after, w.price_before AS price_before_earnings, w.price_after AS price_after_earnings,
       w.ret AS stock_return_3day, TRUE AS is_temporally_valid, f.Total_Revenue AS financial_Total_Revenue,
       f.Net_Income AS financial_Net_Income, f.Total_Debt AS financial_Total_Debt,
       f.Tax_Provision AS financial_Tax_Provision, f.Total_Assets AS financial_Total_Assets,
       f.Current_Assets AS financial_Current_Assets, f.Current_Liabilities AS financial_Current_Liabilities,
       f.Total_Equity AS financial_Total_Equity
FROM v_calls c JOIN v_match m USING (doc_id) JOIN v_window w USING (doc_id)
JOIN v_financials f ON f.ticker = c.ticker AND f.date = m.fdate
WHERE m.match_type IN ('tight', 'fallback') AND w.after_date IS NOT NULL""",
    "v_opened": """
SELECT a.doc_id, max(i.date) AS d FROM v_aligned a JOIN v_index i ON i.date <= a.market_date_before GROUP BY 1""",
    "v_closed": """
SELECT a.doc_id, min(i.date) AS d FROM v_aligned a JOIN v_index i ON i.date >= a.market_date_after GROUP BY 1""",
    "v_targets": """
SELECT a.*, (z.close - o.close) / o.close AS sp500_return_3day,
       a.stock_return_3day - coalesce((z.close - o.close) / o.close, 0) AS abnormal_return
FROM v_aligned a LEFT JOIN v_opened vo USING (doc_id) LEFT JOIN v_closed vc USING (doc_id)
LEFT JOIN v_index o ON o.date = vo.d LEFT JOIN v_index z ON z.date = vc.d""",
    "v_labelled": """
SELECT t.*, CAST(abnormal_return > 0 AS INTEGER) AS label_binary, CAST(abnormal_return > q.m AS INTEGER) AS label_median,
       CASE WHEN abnormal_return >= q.hi THEN 2 WHEN abnormal_return <= q.lo THEN 0 ELSE 1 END AS label_tertile
FROM v_targets t, (SELECT quantile_cont(abnormal_return, 0.5) AS m, quantile_cont(abnormal_return, 0.33) AS lo,
                          quantile_cont(abnormal_return, 0.67) AS hi FROM v_targets) q""",
    "v_bars": """
SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
FROM events GROUP BY 1, 2""",
    "v_turns": """
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN text ELSE '' END AS management_text,
       CASE WHEN role = 'assistant' THEN '' ELSE text END AS analyst_text
FROM conversations""",
    "v_tokens": """
SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tok FROM documents""",
    "v_textstats": """
SELECT doc_id, len(tok) AS word_count, length(text) AS char_count,
       len(list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '\\S'))) AS sentence_count,
       len(list_distinct(tok)) AS unique_words, length(text) - length(replace(text, '?', '')) AS question_count,
       CASE WHEN len(tok) > 0 THEN length(array_to_string(tok, '')) / len(tok) ELSE 0.0 END AS avg_word_length,
       len(list_filter(tok, lambda x: x IN ('that', 'with'))) AS n_pos, len(list_filter(tok, lambda x: x IN ('this', 'from'))) AS n_neg,
       len(list_filter(tok, lambda x: x = 'the')) AS n_unc, len(list_filter(tok, lambda x: x = 'license')) AS n_lit,
       len(list_filter(tok, lambda x: x = 'and')) AS n_con
FROM v_tokens""",
    "v_scored": """
SELECT l.doc_id, c.date, c.lang, c.source, l.quality AS label_binary, l.toxic, s.word_count, s.sentence_count, s.avg_word_length,
       CASE WHEN s.sentence_count > 0 THEN s.word_count / s.sentence_count ELSE 0.0 END AS avg_sentence_length, s.unique_words,
       CASE WHEN s.word_count > 0 THEN s.unique_words / s.word_count ELSE 0.0 END AS lexical_diversity,
       CASE WHEN s.word_count > 0 THEN s.n_neg / s.word_count ELSE 0.0 END AS lm_negative,
       CASE WHEN s.word_count > 0 THEN s.n_pos / s.word_count ELSE 0.0 END AS lm_positive,
       CASE WHEN s.word_count > 0 THEN s.n_unc / s.word_count ELSE 0.0 END AS lm_uncertainty,
       CASE WHEN s.word_count > 0 THEN s.n_con / s.word_count ELSE 0.0 END AS lm_constraining,
       CASE WHEN s.word_count > 0 THEN (s.n_pos - s.n_neg) / s.word_count ELSE 0.0 END AS lm_net_sentiment
FROM labels l JOIN v_calls c USING (doc_id) JOIN v_textstats s USING (doc_id)""",
}
