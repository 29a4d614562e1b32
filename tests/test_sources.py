"""Readers, shaping and sinks on small files."""

import datetime as dt
import json


from callgauge.sources import readers, shaping, sinks


def test_transcript_files(spark, tmp_path):
    flat, nested = tmp_path / "flat", tmp_path / "nested" / "AMZN"
    flat.mkdir(), nested.mkdir(parents=True)
    (flat / "AAPL_Q1_2024.txt").write_bytes(b"good words \xff\xfe here\nline two" + b"x" * 100)
    (flat / "MSFT_Q2_2024.txt").write_text("short")
    (flat / "NVDA_Q9_2024.txt").write_text("y" * 200)
    (flat / "LATE_Q4_2025.txt").write_text("y" * 200)
    (flat / "notes.txt").write_text("y" * 200)
    (nested / "2016-Apr-26-AMZN.txt").write_text("z" * 200)
    (nested / "2016-Foo-26-AMZN.txt").write_text("z" * 200)
    got = readers.read_transcript_files(spark, str(flat), 50, last_date="2025-12-31").collect()
    assert [(r.ticker, r.quarter, r.date, r.fiscal_year, r.fiscal_quarter) for r in got] == [("AAPL", "Q1 2024", dt.date(2024, 4, 30), 2024, 1)]
    assert got[0].full_text.startswith("good words  here\nline two") and got[0].source == "REAL"
    other = readers.read_transcript_files(spark, str(tmp_path / "nested"), 50, "dash").collect()
    assert [(r.ticker, r.quarter, r.date) for r in other] == [("AMZN", "Q2 2016", dt.date(2016, 7, 31))]


def test_json_array_and_lines(spark, tmp_path):
    rows = [{"ticker": "A", "quarter": "Q1 2023", "date": "2023-04-30", "fiscal_year": 2023, "full_text": "one\ntwo"}, {"ticker": "B", "quarter": "Q2 2023"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    got = readers.read_transcripts_json(spark, str(tmp_path / "a.json")).orderBy("ticker").collect()
    assert got[0].full_text == "one\ntwo" and got[0].date == dt.date(2023, 4, 30) and got[1].full_text is None
    path = sinks.write_records_json(spark.createDataFrame(got, readers.read_transcripts_json(spark, str(tmp_path / "a.json")).schema), str(tmp_path / "lines"))
    assert readers.read_transcripts_json(spark, path, lines=True).count() == 2


def test_csv_with_zoned_dates(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume,Dividends,Stock Splits,Ticker\n2018-01-02 00:00:00-05:00,1,2,0.5,1.5,10,0,0,MMM\n")
    r = readers.read_table(spark, str(tmp_path / "p.csv"), readers.PRICES).first()
    assert r.Date == dt.datetime(2018, 1, 2, 5) and r.Volume == 10


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("category,word\nnegative,Loss\nnegative,loss\npositive,gain\n")
    assert readers.read_lexicon(spark, str(tmp_path / "w.csv")) == {"negative": ["loss"], "positive": ["gain"]}


def test_text_files_by_key(spark, tmp_path):
    df = spark.createDataFrame([("A", "Q1 2023", "A Inc.", "2023-04-30", "hello\nthere")], "ticker string, quarter string, company_name string, date string, full_text string")
    path = sinks.write_text_by_key(df, str(tmp_path / "t"))
    r = spark.read.text(path, wholetext=True).first()
    assert r.value.rstrip("\n") == "Company: A Inc.\nTicker: A\nQuarter: Q1 2023\nDate: 2023-04-30\n" + "=" * 60 + "\n\nhello\nthere"


def test_nested_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"6A": {"feature_set": "fin", "n_features": 28, "logistic_regression": {"roc_auc": 0.5, "confusion_matrix": [[1, 2], [3, 4]]}, "random_forest": {"roc_auc": 0.6}}}))
    got = {(r.run, r.feature_set, r.model, r.metric): r.value for r in readers.flatten_results(spark, str(tmp_path / "r.json")).collect()}
    assert got == {("6A", "fin", "logistic_regression", "roc_auc"): 0.5, ("6A", "fin", "random_forest", "roc_auc"): 0.6}


def test_wide_statement(spark):
    df = spark.createDataFrame([("A", "Revenue", 1.0, None), ("A", "Cost", 3.0, 4.0)], "Ticker string, item string, `2024-03-31` double, `2024-06-30` double")
    got = {r.Date: (r.Revenue, r.Cost) for r in shaping.statements_to_long(df, "item", ["2024-03-31", "2024-06-30"], ["Revenue", "Cost"]).collect()}
    assert got == {dt.date(2024, 3, 31): (1.0, 3.0), dt.date(2024, 6, 30): (None, 4.0)}


def test_collection_and_tickers(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("y",)], "k string")
    assert shaping.collection_rate(shaping.collection_log(a, b, "k")).first().asDict() == {"succeeded": 1, "failed": 1, "success_rate": 0.5}
    raw = spark.createDataFrame([("BRK.B", "B", "S", "SI", "HQ", "N/A", "1900")], "Symbol string, Security string, `GICS Sector` string, `GICS Sub-Industry` string, `Headquarters Location` string, `Date added` string, Founded string")
    assert shaping.shape_tickers(raw, "2026-02-08").first().Ticker == "BRK-B"
