"""Patterns, names and limits that results depend on.

Everything here is data, written as the results need it.
"""

# Whitespace in the wide sense, as a pattern, its complement, and as characters.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
SPACE_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Standard phrases of calls, replaced by one blank, in this order.
BOILERPLATE = [
    r"(?si)this (?:call|conference|presentation|release|discussion) (?:contains?|includes?|may contain) forward.{0,20}looking statements?.{0,600}(?=\n\n|\z)",
    r"(?si)(?:caution|cautionary).{0,30}forward.{0,10}looking.{0,400}(?=\n\n|\z)",
    r"(?si)actual results? (?:may|could|might) (?:differ|vary).{0,400}(?=\n\n|\z)",
    r"(?si)(?:annual|quarterly) report on form \d+.{0,200}(?=\n\n|\z)",
    r"(?id)^.{0,400}(?:good (?:morning|afternoon|evening)[,.]?\s+(?:everyone|ladies|and welcome)|welcome to the .{0,60}(?:earnings|results|quarter).{0,60}(?:call|conference)|thank you for (?:joining|standing by|participating))[^\n]{0,200}",
    r"(?imd)^operator\s*:?.{0,200}(?:press \*|mute|queue|questions? and answers?|Q&A session)[^\n]{0,200}$",
    r"(?id)(?:ladies and gentlemen,? )?(?:this concludes|thank you for joining|you may (?:now )?disconnect)[^\n]{0,200}",
]

# Where the question part of a call begins; earlier entries win.
QA_MARKERS = [
    r"Questions?\s+and\s+Answers?",
    r"Q\s*&\s*A\s+Session",
    r"Q\s*&\s*A\b",
    r"Question\s+Session",
    r"Question-and-Answer",
    r"Analyst\s+Questions?",
    r"Questions?\s+from\s+Analysts?",
    r"(?:^|\n)Operator:\s*(?:Thank you|We will now|Our next question)",
]

# Lines that name a speaker of the company.
MANAGEMENT_LINES = [
    r"(?:^|\n)([A-Z][a-z]+ [A-Z][a-z]+)\s*[-–—]\s*(?:CEO|CFO|COO|CTO|President|Chairman|Chief)",
    r"(?:^|\n)([A-Z][a-z]+ [A-Z][a-z]+),\s*(?:CEO|CFO|COO|President|Chairman)",
    r"(?:^|\n)(Operator):",
    r"(?:^|\n)(Moderator):",
    r"Prepared Remarks?:?",
    r"Management Discussion:?",
    r"Opening Remarks?:?",
    r"Company Representatives?:?",
    r"(?:^|\n)(Management):",
    r"(?:^|\n)(Executive):",
]

# Lines that name an analyst or open the question part.
ANALYST_LINES = [
    r"(?:^|\n)([A-Z][a-z]+ [A-Z][a-z]+)\s*[-–—]\s*(?:Analyst|Morgan Stanley|Goldman Sachs|JP Morgan|Bank of America|Citi|Barclays|UBS|Credit Suisse|Deutsche Bank|Wells Fargo|RBC|BMO)",
    r"(?:^|\n)([A-Z][a-z]+ [A-Z][a-z]+),\s*(?:Analyst)",
    r"Q&A|Question-and-Answer|Questions? and Answers?",
    r"Analyst Questions?:?",
    r"Question Session:?",
    r"(?:^|\n)(Analyst):",
    r"(?:^|\n)(Question):",
    r"(?:^|\n)Q:",
    r"(?:^|\n)Question\s+\d+:",
]

# What introduces an analyst's turn inside the question part.
ANALYST_INTROS = [
    r"(?:^|\n)([A-Z][a-z]+ [A-Z][a-z]+)\s*[-–—]\s*(?:Analyst|Morgan Stanley|Goldman Sachs|JP\s*Morgan|Bank of America|Citi|Citigroup|Barclays|UBS|Credit Suisse|Deutsche Bank|Wells Fargo|RBC|BMO|Jefferies|Piper)",
    r"(?:^|\n)([A-Z][a-z]+ [A-Z][a-z]+),?\s*Analyst",
    r"(?:^|\n)Q:",
    r"(?:^|\n)Question\s+\d+:",
    r"(?:^|\n)Analyst:",
    r"(?:^|\n)Operator:\s*(?:Our next question|The next question|Thank you)",
]

# Plain markers for texts that were never segmented; the earliest wins.
SPLIT_MARKERS = [
    "QUESTION AND ANSWER", "Q&A", "QUESTIONS AND ANSWERS", "Question-and-Answer", "Questions and Answers",
]

# The five word categories of a lexicon.
LEXICON_CATEGORIES = ["negative", "positive", "uncertainty", "litigious", "constraining"]

# Terms watched in a call, and those of them that stand for risk.
WATCH_TERMS = [
    "uncertainty", "headwinds", "challenging", "tariffs", "inflation", "guidance",
    "growth", "margin", "demand", "macro", "supply chain", "strong",
]
RISK_TERMS = ["uncertainty", "headwinds", "challenging", "tariffs", "inflation", "macro", "supply chain"]

# Words of a file name that are no ticker.
NAME_STOP_WORDS = ["FILE", "TRANSCRIPT", "EARNINGS", "CALL", "REPORT", "Q", "QTR", "FY"]

# How a header names each quarter.
QUARTER_WORDS = {
    "Q1": ["FIRST QUARTER", "Q1", "1ST QUARTER", "FIRST-QUARTER"],
    "Q2": ["SECOND QUARTER", "Q2", "2ND QUARTER", "SECOND-QUARTER"],
    "Q3": ["THIRD QUARTER", "Q3", "3RD QUARTER", "THIRD-QUARTER"],
    "Q4": ["FOURTH QUARTER", "Q4", "4TH QUARTER", "FOURTH-QUARTER", "FULL YEAR", "ANNUAL"],
}

# Columns that must never be a feature.
LEAK_COLUMNS = [
    "stock_return_3day", "abnormal_return", "label_binary", "label_median", "label_tertile",
    "price_before_earnings", "price_after_earnings",
    "market_date_before", "market_date_after",
    "is_temporally_valid", "alignment_timestamp",
    "ticker", "company_name", "quarter",
    "transcript_date", "financial_date", "fiscal_year", "fiscal_quarter",
    "financial_date_diff_days", "financial_DateDiff",
]

# The validation step also drops these.
LEAK_COLUMNS_VALIDATION = LEAK_COLUMNS + ["financial_match_type"]
LEAK_PARTS_VALIDATION = ["price_after", "price_before", "match_type"]

# Name parts that mark a leaking column in feature discovery.
LEAK_PARTS_DISCOVERY = [
    "DateDiff", "financial_DateDiff", "price_after", "price_before", "stock_return",
    "alignment_timestamp", "label_binary", "label_median", "label_tertile",
    "abnormal_return", "is_temporally_valid", "ticker", "company_name", "quarter",
    "transcript_date", "financial_date",
]

# Name parts that mark a leaking column in the model search.
LEAK_PARTS_SEARCH = [
    "price_after", "price_before", "stock_return", "abnormal_return", "label_binary",
    "label_median", "label_tertile", "sp500_return", "alignment_timestamp", "ticker",
    "company_name", "quarter", "transcript_date", "financial_date", "DateDiff",
    "date_diff", "financial_match_type", "match_type",
]

# Prefixes of sentiment features, short list (fitting) and long list (validation).
SENTIMENT_PREFIXES = [
    "sentiment_", "mgmt_sentiment_", "analyst_sentiment_", "lm_", "mgmt_lm_", "analyst_lm_",
    "word_count", "question_count", "lexical_diversity", "mgmt_word_count",
    "analyst_word_count", "lm_sentiment_divergence", "uncertainty_divergence",
    "mgmt_avg_word_length", "avg_word_length", "unique_words",
]
SENTIMENT_PREFIXES_VALIDATION = SENTIMENT_PREFIXES + [
    "avg_sentence_length", "analyst_avg_word_length", "char_count", "sentence_count",
]

# Keywords that sort statement columns into groups; groups may overlap.
STATEMENT_GROUPS = {
    "income_features": ["Revenue", "Income", "Profit", "EBIT", "EPS", "Tax"],
    "balance_features": ["Assets", "Liabilities", "Equity", "Debt", "Cash", "Working"],
    "cashflow_features": ["Cash_Flow", "Capital", "Dividend", "Repurchase"],
}

# Columns of the fused table that describe a row.
METADATA_COLUMNS = [
    "ticker", "company_name", "quarter", "transcript_date", "financial_date",
    "market_date_before", "market_date_after", "date", "fiscal_year", "fiscal_quarter",
    "alignment_timestamp", "is_temporally_valid", "financial_date_diff_days", "financial_match_type",
]

# Text statistics among the features of the fused table.
TEXT_STATISTICS = [
    "word_count", "sentence_count", "lexical_diversity", "question_count",
    "avg_word_length", "avg_sentence_length", "unique_words", "char_count",
]
ROLE_COUNTS = ["total_management_words", "total_analyst_words", "management_analyst_ratio"]

# Measures taken from each statement, target name to source name.
INCOME_MEASURES = {
    "Total_Revenue": "Total Revenue", "Gross_Profit": "Gross Profit",
    "Operating_Income": "Operating Income", "Net_Income": "Net Income", "EBIT": "EBIT",
    "EBITDA": "EBITDA", "Operating_Expense": "Operating Expense",
    "Interest_Expense": "Interest Expense", "Tax_Provision": "Tax Provision",
    "Diluted_EPS": "Diluted EPS",
}
BALANCE_MEASURES = {
    "Total_Assets": "Total Assets",
    "Total_Liabilities": "Total Liabilities Net Minority Interest",
    "Total_Equity": "Total Equity Gross Minority Interest",
    "Current_Assets": "Current Assets", "Current_Liabilities": "Current Liabilities",
    "Cash_And_Equivalents": "Cash And Cash Equivalents", "Total_Debt": "Total Debt",
    "Retained_Earnings": "Retained Earnings", "Working_Capital": "Working Capital",
    "Inventories": "Inventory",
}
CASHFLOW_MEASURES = {
    "Operating_Cash_Flow": "Operating Cash Flow", "Investing_Cash_Flow": "Investing Cash Flow",
    "Financing_Cash_Flow": "Financing Cash Flow", "Free_Cash_Flow": "Free Cash Flow",
    "Capital_Expenditure": "Capital Expenditure", "Dividend_Paid": "Cash Dividends Paid",
    "Repurchase_Of_Stock": "Repurchase Of Capital Stock", "Change_In_Cash": "Changes In Cash",
}

# Statement ratios, name to (numerator, denominator).
STATEMENT_RATIOS = {
    "Profit_Margin": ("Net_Income", "Total_Revenue"),
    "Current_Ratio": ("Current_Assets", "Current_Liabilities"),
    "Debt_to_Equity": ("Total_Debt", "Total_Equity"),
    "Asset_Turnover": ("Total_Revenue", "Total_Assets"),
    "ROA": ("Net_Income", "Total_Assets"),
    "ROE": ("Net_Income", "Total_Equity"),
}

# Columns of a ticker list, source name to target name.
TICKER_COLUMNS = {
    "Symbol": "Ticker", "Security": "Company_Name", "GICS Sector": "Sector",
    "GICS Sub-Industry": "Sub_Industry", "Headquarters Location": "Headquarters",
    "Date added": "Date_Added", "Founded": "Founded",
}

# Display names of a result table.
RESULT_NAMES = {
    "ticker": "Company", "quarter": "Quarter", "abnormal_return": "Gain vs Market",
    "stock_return_3day": "3-Day Return", "label_binary": "Beat Market (1=Yes)",
}

# Columns of a price bar.
BAR_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Volume", "Dividends", "Stock Splits", "Ticker"]

# Limits of the gates.
TIGHT_DAYS = 120
FALLBACK_DAYS = 180
PARSE_RATE = 0.80
BASELINE_AUC = 0.55
IMPROVEMENT = 0.02
MIN_ROWS = 1000
EMBEDDING_SIZE = 768
MIN_FEATURES = 700
TRAIN_SHARE = (0.65, 0.75)
SHARE_OF_INPUT = 0.752
