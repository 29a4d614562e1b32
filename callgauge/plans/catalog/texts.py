"""Text operators over whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgauge.functions import text as tx
from callgauge.operators import aggregates as ag, texts as tt
from callgauge.plans.catalog.alignment import r
from callgauge.plans.registry import query
from callgauge.plans.views import LEXICON

# license lines play the standard phrases of calls
PHRASES = [
    r"(?i)this work is licensed under the gnu general public license[^\n]{0,60}",
    r"(?i)released under the mit license\.?",
    r"(?i)licensed under (?:the apache license|cc by)[^\n]{0,40}",
]
MARKERS = [r"Licensed\s+under", r"Released\s+under", r"\bthat\b\s+\w+\s+the\b"]


def _sql_normal(c: str) -> str:
    for pattern, to in (
        (r"\s+", " "), (r"\[[^\]]*\]", ""), (r"<[^>]+>", ""), (r"\.{2,}", "."), (r"!{2,}", "!"), (r"\?{2,}", "?"),
        ("[@#$%^&*~`]", ""), ("[—–]", "-"), (" +- +", " - "), (r"([.!?]) +", r"\1 "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def _sql_phrases(c: str) -> str:
    for p in PHRASES:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({c}, '  +', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("normalize_text", f"SELECT doc_id, md5({_sql_normal('text')}) AS digest, length({_sql_normal('text')}) AS n FROM documents")
def normalize_text(t):
    d = t.documents.select("doc_id", tx.normalize_text(F.col("text")).alias("x"))
    return d.select("doc_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n"))


@query("normalize_markup", f"SELECT page_id, md5({_sql_normal('html')}) AS digest FROM pages")
def normalize_markup(t):
    return t.pages.select("page_id", F.md5(tx.normalize_text(F.col("html"))).alias("digest"))


@query("remove_boilerplate", f"SELECT doc_id, md5({_sql_phrases('text')}) AS digest, length({_sql_phrases('text')}) AS n FROM documents")
def remove_boilerplate(t):
    d = t.documents.select("doc_id", tx.remove_boilerplate(F.col("text"), PHRASES).alias("x"))
    return d.select("doc_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n"))


def _cleaned(t, **kw):
    return tt.clean_transcripts(t.documents.select("doc_id", "lang", F.col("text").alias("full_text")), boilerplate=PHRASES, **kw)


_CLEAN = f"(SELECT doc_id, length({_sql_phrases('text')}) AS before, {_sql_normal(_sql_phrases('text'))} AS x FROM documents)"


@query("clean_transcripts", f"SELECT doc_id, before AS original_length, length(x) AS cleaned_length, md5(x) AS digest, CAST(0 AS BIGINT) AS removed FROM {_CLEAN}")
def clean_transcripts(t):
    return _cleaned(t).select(
        "doc_id", F.col("full_text_original_length").cast("long").alias("original_length"), F.col("full_text_cleaned_length").cast("long").alias("cleaned_length"),
        F.md5("full_text_cleaned").alias("digest"), F.col("total_chars_removed").cast("long").alias("removed"),
    )


@query(
    "clean_sections",
    f"""SELECT doc_id, length({_sql_phrases('text')}) - length({_sql_normal(_sql_phrases('text'))}) AS removed FROM documents""",
)
def clean_sections(t):
    """Removed characters count the prepared and question parts only."""
    d = t.documents.select("doc_id", F.col("text").alias("prepared_remarks"))
    return tt.clean_transcripts(d, boilerplate=PHRASES).select("doc_id", F.col("total_chars_removed").cast("long").alias("removed"))


@query("cleaning_stats", f"SELECT count(*) AS total_processed, count(*) AS successfully_cleaned, round(avg(before), 6) AS avg_original_length, round(avg(length(x)), 6) AS avg_cleaned_length, CAST(0 AS BIGINT) AS total_chars_removed FROM {_CLEAN}")
def cleaning_stats(t):
    out = ag.cleaning_stats(_cleaned(t))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_original_length", "avg_cleaned_length")})


@query("drop_empty_text", f"SELECT lang, count(*) AS n FROM (SELECT lang, {_sql_normal(_sql_phrases('text'))} AS x FROM documents) WHERE length(x) > 0 GROUP BY 1")
def drop_empty_text(t):
    return tt.drop_empty_text(_cleaned(t)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_AT = "coalesce({}) AS pos".format(", ".join(
    f"CASE WHEN regexp_matches(text, '(?i){m}') THEN length(regexp_extract(text, '(?is)^(.*?)(?:{m})', 1)) + 1 END" for m in MARKERS))


@query("split_qa", f"SELECT doc_id, coalesce(CASE WHEN pos > 1 THEN pos END, 0) AS start FROM (SELECT doc_id, {_AT} FROM documents)")
def split_qa(t):
    return t.documents.select("doc_id", F.coalesce(tx.qa_start(F.col("text"), MARKERS), F.lit(0)).cast("long").alias("start"))


@query(
    "speaker_lines",
    r"""
SELECT conv_id, turn, md5(regexp_replace(regexp_replace('Management: ' || upper(replace(text, 'ß', 'SS')) || ' Operator: bye', '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS management,
       md5(regexp_replace(regexp_replace('Analyst:' || chr(10) || text, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS analyst
FROM conversations""",
)
def speaker_lines(t):
    """Role lines: the marks come from the default patterns, following lines keep the role."""
    made = F.concat(F.lit("Analyst:\n"), F.col("text"), F.lit("\nManagement: "), F.upper("text"), F.lit(" Operator: bye"))
    parts = tx.speaker_parts(made)
    return t.conversations.select("conv_id", "turn", F.md5(parts["management"]).alias("management"), F.md5(parts["analyst"]).alias("analyst"))


@query(
    "question_sentences",
    r"""SELECT doc_id, len(q) AS n, md5(array_to_string(q, '|')) AS digest
FROM (SELECT doc_id, regexp_extract_all(replace(text, ',', '?'), '[^.!?]*\?[^.!?]*') AS q FROM documents)""",
)
def question_sentences(t):
    q = tx.question_sentences(F.replace("text", F.lit(","), F.lit("?")))
    return t.documents.select("doc_id", F.size(q).cast("long").alias("n"), F.md5(F.array_join(q, "|")).alias("digest"))


@query(
    "extract_analyst",
    r"""
SELECT doc_id, md5(CASE WHEN len(p) > 1 THEN array_to_string(p[2:], ' ') ELSE array_to_string(regexp_extract_all(x, '[^.!?]*\?[^.!?]*'), ' ') END) AS digest
FROM (SELECT doc_id, replace(text, ',', '?') AS x, string_split_regex(replace(text, ',', '?'), '(?i)licensed under') AS p FROM documents)""",
)
def extract_analyst(t):
    x = tx.extract_analyst(F.replace("text", F.lit(","), F.lit("?")), ["licensed under", "no such intro"])
    return t.documents.select("doc_id", F.md5(x).alias("digest"))


@query(
    "segment",
    rf"""
SELECT doc_id, pos IS NULL AS fallback_used,
       md5(CASE WHEN pos IS NOT NULL THEN left(x, pos - 1) ELSE '' END) AS management_before_marker,
       md5(CASE WHEN pos IS NOT NULL THEN array_to_string(regexp_extract_all(substr(x, pos), '[^.!?]*\?[^.!?]*'), ' ')
                WHEN len(q) >= 3 THEN array_to_string(q, ' ') ELSE '' END) AS analyst
FROM (SELECT doc_id, x, CASE WHEN pos > 1 THEN pos END AS pos, regexp_extract_all(x, '[^.!?]*\?[^.!?]*') AS q
      FROM (SELECT doc_id, text AS x, {_AT} FROM (SELECT doc_id, replace(text, ',', '?') AS text FROM documents)))""",
)
def segment(t):
    d = t.documents.select("doc_id", F.replace("text", F.lit(","), F.lit("?")).alias("full_text_cleaned"))
    out = tt.segment(d, markers=MARKERS)
    before = F.when(~F.col("fallback_used"), F.col("management_text")).otherwise("")
    return out.select("doc_id", "fallback_used", F.md5(before).alias("management_before_marker"), F.md5("analyst_text").alias("analyst"))


_QUESTION_TEXT = _sql_normal("replace(text, ',', '?')")


@query(
    "segment_cleaned",
    rf"""
SELECT doc_id, TRUE AS fallback_used, md5(CASE WHEN len(q) >= 3 THEN array_to_string(q, ' ') ELSE '' END) AS analyst,
       md5(CASE WHEN len(q) >= 3 THEN regexp_replace(x, '[^.!?]*\?[^.!?]*', '', 'g') ELSE x END) AS management
FROM (SELECT doc_id, x, regexp_extract_all(x, '[^.!?]*\?[^.!?]*') AS q FROM (SELECT doc_id, {_QUESTION_TEXT} AS x FROM documents))""",
)
def segment_cleaned(t):
    """Roles of cleaned texts, which are a single line: question sentences go to the analysts."""
    d = t.documents.select("doc_id", tx.normalize_text(F.replace("text", F.lit(","), F.lit("?"))).alias("full_text_cleaned"))
    return tt.segment(d).select("doc_id", "fallback_used", F.md5("analyst_text").alias("analyst"), F.md5("management_text").alias("management"))


@query(
    "segment_counts",
    r"""
SELECT conv_id, turn, len(regexp_extract_all(management_text, '\S+')) AS management_word_count, len(regexp_extract_all(analyst_text, '\S+')) AS analyst_word_count,
       len(regexp_extract_all(management_text, '[.!?]+')) AS management_utterances, len(regexp_extract_all(analyst_text, '[.!?]+')) AS analyst_utterances,
       0.0::DOUBLE AS management_analyst_ratio
FROM v_turns""",
)
def segment_counts(t):
    c = ["management_word_count", "analyst_word_count", "management_utterances", "analyst_utterances"]
    out = tt.segment_counts(t.turns)
    return out.select("conv_id", "turn", *[F.col(x).cast("long").alias(x) for x in c], "management_analyst_ratio")


@query(
    "segmentation_stats",
    r"""
SELECT count(*) AS total_processed, round(avg(m), 6) AS avg_management_words, round(avg(a), 6) AS avg_analyst_words,
       round(coalesce(avg(m / a) FILTER (WHERE a > 0 AND m > 0), 0), 6) AS avg_ratio, count(*) FILTER (WHERE m = 0) AS fallback_used
FROM (SELECT len(regexp_extract_all(management_text, '\S+')) AS m, len(regexp_extract_all(analyst_text || ' ok so', '\S+')) AS a FROM v_turns)""",
)
def segmentation_stats(t):
    d = t.turns.withColumn("analyst_text", F.concat("analyst_text", F.lit(" ok so")))
    out = ag.segmentation_stats(tt.segment_counts(d).withColumn("fallback_used", F.col("management_word_count") == 0))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_management_words", "avg_analyst_words", "avg_ratio")})


@query("tokenize", "SELECT doc_id, len(tok) AS n, md5(array_to_string(tok, ' ')) AS digest FROM v_tokens")
def tokenize(t):
    tok = tx.tokenize(F.col("text"))
    return t.documents.select("doc_id", F.size(tok).cast("long").alias("n"), F.md5(F.array_join(tok, " ")).alias("digest"))


_LM = """
       round(CASE WHEN word_count > 0 THEN n_neg / word_count ELSE 0 END, 6) AS lm_negative, round(CASE WHEN word_count > 0 THEN n_pos / word_count ELSE 0 END, 6) AS lm_positive,
       round(CASE WHEN word_count > 0 THEN n_unc / word_count ELSE 0 END, 6) AS lm_uncertainty, round(CASE WHEN word_count > 0 THEN n_lit / word_count ELSE 0 END, 6) AS lm_litigious,
       round(CASE WHEN word_count > 0 THEN n_con / word_count ELSE 0 END, 6) AS lm_constraining, n_neg AS lm_negative_count, n_pos AS lm_positive_count,
       n_unc AS lm_uncertainty_count, round(CASE WHEN word_count > 0 THEN (n_pos - n_neg) / word_count ELSE 0 END, 6) AS lm_net_sentiment"""
_LM_NAMES = ["lm_negative", "lm_positive", "lm_uncertainty", "lm_litigious", "lm_constraining", "lm_net_sentiment"]
_LM_COUNTS = ["lm_negative_count", "lm_positive_count", "lm_uncertainty_count"]


@query("lexicon_scores", f"SELECT doc_id, {_LM} FROM v_textstats")
def lexicon_scores(t):
    out = tt.lexicon_scores(t.documents.withColumn("tok", tx.tokenize(F.col("text"))), "tok", LEXICON)
    return out.select("doc_id", *[r(c) for c in _LM_NAMES], *[F.col(c).cast("long").alias(c) for c in _LM_COUNTS])


@query(
    "text_statistics",
    """
SELECT doc_id, word_count, char_count, sentence_count, unique_words, question_count, round(avg_word_length, 6) AS avg_word_length,
       round(CASE WHEN sentence_count > 0 THEN word_count / sentence_count ELSE 0 END, 6) AS avg_sentence_length,
       round(CASE WHEN word_count > 0 THEN unique_words / word_count ELSE 0 END, 6) AS lexical_diversity
FROM v_textstats""",
)
def text_statistics(t):
    out = tt.text_statistics(t.documents.withColumn("tok", tx.tokenize(F.col("text"))), "text", "tok")
    ints = ["word_count", "char_count", "sentence_count", "unique_words", "question_count"]
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ints], *[r(c) for c in ("avg_word_length", "avg_sentence_length", "lexical_diversity")])


@query(
    "nlp_features",
    r"""
WITH x AS (SELECT conv_id, turn, regexp_extract_all(lower(management_text), '[\p{L}\p{N}_]+') AS m, regexp_extract_all(lower(analyst_text), '[\p{L}\p{N}_]+') AS a FROM v_turns),
y AS (SELECT conv_id, turn, len(m) AS mw, len(a) AS aw, len(list_filter(m, lambda w: w IN ('that', 'with'))) - len(list_filter(m, lambda w: w IN ('this', 'from'))) AS mn,
             len(list_filter(a, lambda w: w IN ('that', 'with'))) - len(list_filter(a, lambda w: w IN ('this', 'from'))) AS an,
             len(list_filter(m, lambda w: w = 'the')) AS mu, len(list_filter(a, lambda w: w = 'the')) AS au FROM x)
SELECT conv_id, turn, mw AS mgmt_word_count, aw AS analyst_word_count, mw + aw AS word_count,
       round(CASE WHEN mw > 0 THEN mn / mw ELSE 0 END - CASE WHEN aw > 0 THEN an / aw ELSE 0 END, 6) AS lm_sentiment_divergence,
       round(CASE WHEN mw > 0 THEN mu / mw ELSE 0 END - CASE WHEN aw > 0 THEN au / aw ELSE 0 END, 6) AS uncertainty_divergence,
       round(CASE WHEN mw + aw > 0 THEN (mn + an) / (mw + aw) ELSE 0 END, 6) AS lm_net_sentiment FROM y""",
)
def nlp_features(t):
    out = tt.nlp_features(t.turns, LEXICON, ["conv_id", "turn"])
    ints = ["mgmt_word_count", "analyst_word_count", "word_count"]
    return out.select("conv_id", "turn", *[F.col(c).cast("long").alias(c) for c in ints], *[r(c) for c in ("lm_sentiment_divergence", "uncertainty_divergence", "lm_net_sentiment")])


@query(
    "coalesce_text",
    """
SELECT doc_id, md5(CASE WHEN pos > 0 THEN left(text, pos - 1) ELSE text END) AS management, md5(CASE WHEN pos > 0 THEN substr(text, pos) ELSE '' END) AS analyst
FROM (SELECT doc_id, text, coalesce(least(nullif(strpos(upper(replace(text, 'ß', 'SS')), 'LICENSED UNDER'), 0), nullif(strpos(upper(replace(text, 'ß', 'SS')), ' THE '), 0)), 0) AS pos FROM documents)""",
)
def coalesce_text(t):
    """Texts without roles fall back to the whole text and are split at the earliest plain marker."""
    d = t.documents.select("doc_id", F.lit("").alias("management_text"), F.lit(" ").alias("analyst_text"), F.col("text").alias("full_text"))
    out = tt.coalesce_text(d, ["Licensed under", " the "])
    return out.select("doc_id", F.md5("management_text").alias("management"), F.md5("analyst_text").alias("analyst"))


@query(
    "model_text",
    r"SELECT conv_id, turn, md5(coalesce(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), ' ')) AS digest FROM conversations",
)
def model_text(t):
    return tt.model_text(t.turns).select("conv_id", "turn", F.md5("model_text").alias("digest"))


@query(
    "token_window",
    r"""
SELECT doc_id, md5(coalesce(nullif(array_to_string(CASE WHEN len(w) > 120 THEN w[61:570] ELSE w[1:510] END, ' '), ''), ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)""",
)
def token_window(t):
    return t.documents.select("doc_id", F.md5(tx.token_window(F.col("text"))).alias("digest"))


@query(
    "identity_from_filename",
    """
SELECT doc_id, upper(lang) AS ticker, 'Q' || (doc_id % 4 + 1) AS quarter, CAST(2010 + doc_id % 15 AS BIGINT) AS year FROM documents""",
)
def identity_from_filename(t):
    name = F.concat(F.lit("call-"), F.col("lang"), F.lit("_q"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(" "), (F.col("doc_id") % 15 + 2010).cast("string"), F.lit(".txt"))
    d = t.documents.select("doc_id", tx.identity_from_filename(name).alias("x"))
    return d.select("doc_id", "x.ticker", "x.quarter", F.col("x.year").cast("long").alias("year"))


@query(
    "identity_mismatch",
    r"""
SELECT doc_id, NOT regexp_matches(' ' || regexp_replace(h, '[^\p{L}\p{N}_]', ' ', 'g') || ' ', ' ' || upper(lang) || ' ') AS ticker_absent,
       CASE WHEN own THEN 'ok' WHEN o1 OR o2 THEN 'other' ELSE 'unclear' END AS quarter_status,
       CASE WHEN own THEN '' ELSE array_to_string(list_filter([CASE WHEN o1 THEN 'Q1' END, CASE WHEN o2 THEN 'Q2' END], lambda q: q IS NOT NULL), ' / ') END AS other_quarters,
       strpos(h, '2021') = 0 AS year_absent, CASE WHEN strpos(h, '2021') = 0 THEN regexp_extract(h, '20[1-9][0-9]') ELSE '' END AS other_year
FROM (SELECT doc_id, lang, h, strpos(h, 'THIRD QUARTER') > 0 OR strpos(h, 'Q3') > 0 OR strpos(h, '3RD QUARTER') > 0 OR strpos(h, 'THIRD-QUARTER') > 0 AS own,
             strpos(h, 'Q1') > 0 AS o1, strpos(h, 'Q2') > 0 AS o2
      FROM (SELECT doc_id, lang, upper(left('Q' || (doc_id % 3 + 1) || ' ' || (2019 + doc_id % 3) || ' ' || text, 1500)) AS h FROM documents))""",
)
def identity_mismatch(t):
    head = F.concat(F.lit("Q"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(" "), (F.col("doc_id") % 3 + 2019).cast("string"), F.lit(" "), F.col("text"))
    d = t.documents.select("doc_id", head.alias("x"), F.upper("lang").alias("ticker"), F.lit("Q3").alias("quarter"), F.lit(2021).alias("year"))
    out = tt.identity_mismatch(d, "x", "ticker", "quarter", "year")
    return out.select("doc_id", "ticker_absent", "quarter_status", "other_quarters", "year_absent", "other_year")


@query(
    "covered_symbols",
    """
SELECT c_custkey, symbol, regexp_matches(symbol, '^[A-Z]{1,5}(-[A-Z])?$') AS symbol_valid, symbol IN (SELECT upper(left(p_type, 5)) FROM part) AS symbol_covered
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(left(c_mktsegment, 8)) WHEN c_custkey % 3 = 1 THEN 'ECONO' ELSE upper(left(c_mktsegment, 4)) || '-B' END AS symbol FROM customer)""",
)
def covered_symbols(t):
    k = F.col("c_custkey") % 3
    symbol = F.when(k == 0, F.upper(F.substring("c_mktsegment", 1, 8))).when(k == 1, "ECONO").otherwise(F.concat(F.upper(F.substring("c_mktsegment", 1, 4)), F.lit("-B")))
    coverage = t.part.select(F.upper(F.substring("p_type", 1, 5)).alias("s"))
    return tt.covered_symbols(t.customer.select("c_custkey", symbol.alias("symbol")), "symbol", coverage, "s").select("c_custkey", "symbol", "symbol_valid", "symbol_covered")


@query(
    "term_frequency",
    " UNION ALL ".join(
        f"SELECT '{w}' AS term, CAST(sum(len(list_filter(tok, lambda x: x = '{w}'))) AS BIGINT) AS mentions, '{k}' AS class FROM v_tokens"
        for w, k in (("that", "growth"), ("with", "growth"), ("this", "risk"), ("license", "risk"))
    ),
)
def term_frequency(t):
    return tt.term_frequency(t.documents, "text", ["that", "with", "this", "license"], ["this", "license"])


@query("word_count", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents")
def word_count(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n"))


@query("token_length_stats", r"""
SELECT min(n) AS min_tokens, max(n) AS max_tokens, CAST(floor(avg(n)) AS BIGINT) AS avg_tokens
FROM (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents ORDER BY doc_id LIMIT 10)""")
def token_length_stats(t):
    return ag.token_length_stats(t.documents, tx.words(F.col("text")), "doc_id")


@query(
    "section_delta_and_bands",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount - l_tax > 0.05 THEN 'more positive' WHEN l_tax - l_discount > 0.05 THEN 'more negative' ELSE 'similar' END AS delta,
       CASE WHEN l_quantity / 50 > 0.6 THEN 'Positive' WHEN l_quantity / 50 > 0.45 THEN 'Cautious' ELSE 'Negative' END AS management_tone,
       CASE WHEN l_quantity / 50 > 0.6 THEN 'Receptive' WHEN l_quantity / 50 > 0.45 THEN 'Neutral' ELSE 'Skeptical' END AS analyst_tone,
       CASE WHEN l_quantity / 50 > 0.60 THEN 'BUY' WHEN l_quantity / 50 < 0.46 THEN 'SELL' ELSE 'HOLD' END AS signal
FROM lineitem""",
)
def section_delta_and_bands(t):
    share = F.col("l_quantity") / 50
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", tx.section_delta(F.col("l_tax"), F.col("l_discount"), F.col("l_discount"), F.col("l_tax")).alias("delta"),
        tx.tone_band(share).alias("management_tone"), tx.tone_band(share, "analyst").alias("analyst_tone"), tx.signal(share, 0.60, 0.46).alias("signal"),
    )


@query(
    "with_defaults",
    "SELECT doc_id, lang AS company_name, '' AS ticker, CAST(0 AS BIGINT) AS fiscal_year, CASE WHEN source = 'src0' THEN 'UNKNOWN' ELSE source END AS source FROM documents",
)
def with_defaults(t):
    d = t.documents.select("doc_id", F.col("lang").alias("company_name"), F.nullif("source", F.lit("src0")).alias("source"))
    return tt.with_defaults(d).select("doc_id", "company_name", "ticker", F.col("fiscal_year").cast("long").alias("fiscal_year"), "source")
