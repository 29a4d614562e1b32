"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from callgauge.functions.calendar import call_date_month_end, quarter_of_month_abbr
from callgauge.functions.fixed import BALANCE_MEASURES, CASHFLOW_MEASURES, INCOME_MEASURES
from callgauge.functions.text import word_count

_d, _s = T.DoubleType(), T.StringType()

TICKERS = "Ticker string, Company_Name string, Sector string, Sub_Industry string, Headquarters string, Date_Added string, Founded string, Collection_Date date"
PRICES = "Date timestamp, Open double, High double, Low double, Close double, Volume long, Dividends double, `Stock Splits` double, Ticker string"
FINANCIALS = T.StructType(
    [T.StructField("Ticker", _s), T.StructField("Date", T.DateType())]
    + [T.StructField(c, _d) for c in (*INCOME_MEASURES, *BALANCE_MEASURES, *CASHFLOW_MEASURES)]
)
TRANSCRIPTS = (
    "ticker string, company_name string, quarter string, date date, fiscal_year int, fiscal_quarter int, "
    "prepared_remarks string, qa_section string, full_text string, word_count int, speaker_count int, "
    "source string, collection_date date"
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """CSV with header or parquet; the format follows the name unless given."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.load(path)


def read_transcripts_json(spark: SparkSession, path: str, schema: T.StructType | str = TRANSCRIPTS, lines: bool = False) -> DataFrame:
    """Call records: JSON arrays (one file = one task), or JSON lines, which split."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_lexicon(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Word lists by category from a CSV with ``category,word``; a lexicon is a few thousand words."""
    table = read_table(spark, path, "category string, word string", "csv")
    rows = table.groupBy("category").agg(F.sort_array(F.collect_set(F.lower(F.trim("word")))).alias("words")).collect()
    return {r["category"]: r["words"] for r in rows}


def read_transcript_files(spark: SparkSession, folder: str, min_bytes: int = 20_000, form: str = "underscore", last_date: str | None = None) -> DataFrame:
    """One record per ``.txt`` file, identity from its name: ``T_Q1_2025.txt`` or ``T/2016-Apr-26-T.txt``.

    Small files are left out, bytes that are no UTF-8 are dropped, and files whose name maps
    to no quarter (or, with ``last_date``, to a call after it) are left out.
    """
    raw = (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
        .select(F.col("value"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
        .filter(F.col("bytes") >= min_bytes)
    )
    stem = F.regexp_replace("file", r"\.txt\z", "")
    if form == "underscore":
        parts = F.split(stem, "_")
        ticker, label = F.get(parts, 0), F.concat_ws(" ", F.get(parts, 1), F.get(parts, 2))
    else:
        parts = F.split(stem, "-")
        ticker = F.try_element_at(F.split("path", "/"), F.lit(-2))
        label = F.concat_ws(" ", quarter_of_month_abbr(F.get(parts, 1)), F.get(parts, 0))
    text = F.translate(F.make_valid_utf8("value"), "�", "")
    out = raw.filter(F.size(parts) >= 3).select(
        ticker.alias("ticker"), F.concat(ticker, F.lit(" Inc.")).alias("company_name"), label.alias("quarter"),
        call_date_month_end(label).alias("date"),
        F.regexp_extract(label, r"(\d{4})\z", 1).try_cast("int").alias("fiscal_year"),
        F.regexp_extract(label, r"^Q(\d)", 1).try_cast("int").alias("fiscal_quarter"),
        text.alias("prepared_remarks"), F.lit("").alias("qa_section"), text.alias("full_text"),
        word_count(text).cast("int").alias("word_count"), F.lit(2).alias("speaker_count"), F.lit("REAL").alias("source"),
        F.current_date().alias("collection_date"),
    )
    out = out.filter("date is not null")
    return out.filter(F.col("date") <= F.lit(last_date).cast("date")) if last_date else out


def flatten_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested result JSON (run -> model -> metrics) as rows (run, feature_set, model, metric, value)."""
    raw = spark.read.text(path, wholetext=True)
    runs = raw.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("run", "body"))
    models = runs.select("run", F.col("body")["feature_set"].alias("feature_set"), F.explode("body").alias("model", "metrics"))
    models = models.filter(F.col("metrics").startswith("{"))
    return models.select(
        "run", "feature_set", "model", F.explode(F.from_json("metrics", "map<string,string>")).alias("metric", "text")
    ).select("run", "feature_set", "model", "metric", F.col("text").try_cast("double").alias("value")).filter("value is not null")
