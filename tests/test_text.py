"""Text operators on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from callgauge.functions import text as tx
from callgauge.operators import texts as tt

NBSP = " "


def run(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def python_boilerplate(text):
    from callgauge.functions.fixed import BOILERPLATE

    for p in BOILERPLATE:
        p = p.replace(r"\z", r"\Z")
        p = re.sub(r"^\(\?([a-z]+)\)", lambda m: "(?" + m[1].replace("d", "") + ")", p)
        text = re.sub(p, " ", text)
    return re.sub("  +", " ", text).strip()


def test_normalize(spark):
    got = run(spark, tx.normalize_text, "a\r\n b\t[music] <b>c</b>..  d!!? ??", f" x{NBSP}y – z—w -  v ", "50% & $3 `q` ^~*#@", None, "", " \n ", "wait... what?? Yes!!!No")
    assert got == ["a b  c. d!? ?", "x y - z-w - v", "50  3 q", "", "", "", "wait. what? Yes!No"]


BOILERPLATE_CASES = [
    "This call contains forward-looking statements. They are uncertain.\n\nRevenue grew. " + "x " * 400,
    "This call contains forward-looking statements. They are uncertain.\n\nRevenue grew.",
    "Good morning everyone, and hello to all.\nRevenue grew.",
    "Hi there.\nThank you for standing by and welcome.\nRevenue grew.",
    "Revenue grew.\nThis concludes our call today. Bye.\nEnd.",
    "Revenue grew.\nOperator: please press *1 to ask.\nEnd.",
    "Actual results may differ materially.",
    "Actual results may differ " + "x" * 500,
    "Actual results may vary a\nb\n\nkept" + " y" * 300,
    "Please see our annual report on Form 10 for risks.\n\n" + "z " * 200,
    "A cautionary note on forward and looking things.\n",
    "Nothing here\n\n",
    "",
]


@pytest.mark.parametrize("text", BOILERPLATE_CASES)
def test_boilerplate(spark, text):
    assert run(spark, tx.remove_boilerplate, text) == [python_boilerplate(text)]


def test_marker_by_list_order_and_position(spark):
    texts = ["Analyst Questions here. Q&A follows", "Q&A first thing", "no marker", "intro Questions and Answers then Q&A", "Q&A at start but Analyst Questions later"]
    got = run(spark, tx.qa_start, *texts)
    assert got == [texts[0].index("Q&A") + 1, None, None, texts[3].index("Questions") + 1, None]


def test_questions(spark):
    for s in ["Hi. what? no? ok! a?b.c", "?x?y", "no q", "", "a?", "???", "a.b?c!d?e?f"]:
        assert run(spark, tx.question_sentences, s)[0] == re.findall(r"[^.!?]*\?[^.!?]*", s)


def test_long_text_without_marks_is_fast(spark):
    assert run(spark, tx.question_sentences, "word " * 200_000 + "? end")[0] == ["word " * 200_000 + "? end"]


def test_speakers_carry_over_lines(spark):
    s = "Hello\nJane Doe - Analyst\nfirst\nsecond\n\nOperator: next\nthird\nQ: why\nfourth"
    x = run(spark, tx.speaker_parts, s)[0]
    assert x.management == "Hello Operator: next third" and x.analyst == "Jane Doe - Analyst first second Q: why fourth"


def test_segment_three_ways(spark):
    marked = "We did well. Q&A Session begins. How are margins? Fine. And costs? Down."
    few = "We did well. Why so? Because."
    many = "We did well. Why so? Because. How long? Years. What next? More. Also why so? Done."
    df = spark.createDataFrame([(1, marked), (2, few), (3, many)], "i int, full_text_cleaned string")
    got = {r.i: r for r in tt.segment(df).collect()}
    assert not got[1].fallback_used and got[1].management_text == "We did well. " and "How are margins?" in got[1].analyst_text
    assert got[2].fallback_used and got[2].analyst_text == "" and got[2].management_text == few
    qs = re.findall(r"[^.!?]*\?[^.!?]*", many)
    rest = many
    for q in qs:
        rest = rest.replace(q, "", 1)
    assert got[3].analyst_text == " ".join(qs) and got[3].management_text == rest


def test_analyst_after_intro_lines(spark):
    s = "Q&A\nOperator: Our next question is from Ann.\nQ: how?\nthanks"
    x = run(spark, tx.extract_analyst, s)[0]
    assert "how?" in x and x.count("thanks") >= 1


def test_lines_survive_when_asked_for(spark):
    df = spark.createDataFrame([("CEO talk\nJane Doe - Analyst\nwhy",)], "full_text string")
    flat = tt.clean_transcripts(df).first().full_text_cleaned
    kept = tt.clean_transcripts(df, keep_newlines=True).first().full_text_cleaned
    assert "\n" not in flat and kept.count("\n") == 2


def python_stats(text):
    toks = re.sub(r"[^\w\s]", " ", text.lower()).split()
    n, s = len(toks), len([p for p in text.split(".") if p.strip()])
    return (n, len(text), s, len(set(toks)), text.count("?"), sum(map(len, toks)) / n if n else 0, n / s if s else 0, len(set(toks)) / n if n else 0)


@pytest.mark.parametrize("text", ["", "...", " ? ! ", "One two. Two three? Ça va_bien 42.", f"a{NBSP}b. . c", "write-down of debt"])
def test_text_statistics(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("k", tx.tokenize(F.col("t")))
    r = tt.text_statistics(df, "t", "k").first()
    got = (r.word_count, r.char_count, r.sentence_count, r.unique_words, r.question_count, r.avg_word_length, r.avg_sentence_length, r.lexical_diversity)
    assert got == pytest.approx(python_stats(text))


def test_lexicon_and_dead_words(spark):
    lex = {"negative": ["loss", "write-down", "risk"], "positive": ["gain"], "uncertainty": ["risk"], "litigious": [], "constraining": ["must"]}
    df = spark.createDataFrame([("Loss, loss and a write-down; risk GAIN must",), ("",)], "t string").withColumn("k", tx.tokenize(F.col("t")))
    a, b = tt.lexicon_scores(df, "k", lex).collect()
    assert (a.lm_negative_count, a.lm_positive_count, a.lm_uncertainty_count) == (3, 1, 1)
    assert a.lm_negative == pytest.approx(3 / 9) and a.lm_net_sentiment == pytest.approx(-2 / 9) and a.lm_litigious == 0
    assert b.lm_negative == 0 and b.lm_net_sentiment == 0
    assert tt.dead_words(lex)["negative"] == ["write-down"]


def test_nlp_features_fall_back_to_full_text(spark):
    df = spark.createDataFrame([("A", "Q1 2020", "d", "", "", "we gain. Q&A we lose")], "ticker string, quarter string, date string, management_text string, analyst_text string, full_text string")
    r = tt.nlp_features(df, {"positive": ["gain"], "negative": ["lose"]}).first()
    assert r.mgmt_word_count == 2 and r.analyst_word_count == 4 and r.lm_sentiment_divergence == pytest.approx(0.5 + 0.25)


def test_token_window(spark):
    toks = [f"w{i}" for i in range(700)]
    got = run(spark, tx.token_window, " ".join(toks), " ".join(toks[:120]), " ".join(toks[:121]), "", None)
    assert got == [" ".join(toks[60:570]), " ".join(toks[:120]), " ".join(toks[60:121]), " ", " "]


def test_file_names(spark):
    names = ["AAPL_Q3_2024.txt", "msft-q2-2021.docx", "nvda q4 2024.txt", "Earnings_Call_FY_CSCO_Q1.pdf", "2016-Apr-26-AMZN.txt", "x.txt", "BRK-B_Q1_2020.txt", "TRANSCRIPT.txt"]
    got = [tuple(x) for x in run(spark, tx.identity_from_filename, *names)]
    assert got == [("AAPL", "Q3", 2024), ("MSFT", "Q2", 2021), ("NVDA", "Q4", 2024), ("CSCO", "Q1", 2025), ("APR", "Q1", 2016), ("X", "Q1", 2025), ("BRK", "Q1", 2020), ("AAPL", "Q1", 2025)]


def test_header_checks(spark):
    rows = [("Apple (AAPL) Q2 2023 Earnings", "AAPL", "Q2", 2023), ("Apple third quarter 2022", "AAPL", "Q2", 2023), ("nothing", "X", "Q1", 2020), ("ANNUAL report Q1 2020 of AAPLE", "AAPL", "Q1", 2020)]
    df = spark.createDataFrame(rows, "t string, k string, q string, y int")
    got = [tuple(r)[4:] for r in tt.identity_mismatch(df, "t", "k", "q", "y").collect()]
    assert got == [
        (False, "ok", "", False, ""), (True, "other", "Q3", True, "2022"), (True, "unclear", "", True, ""), (True, "ok", "", False, ""),
    ]


def test_symbols_signals_and_bands(spark):
    assert run(spark, tx.valid_symbol, "AAPL", "BRK-B", "TOOLONG", "aapl", "A-BC", "") == [True, True, False, False, False, False]
    df = spark.createDataFrame([(0.7,), (0.58,), (0.5,), (0.44,), (0.3,)], "p double")
    got = [(r.s, r.c) for r in df.select(tx.signal(F.col("p")).alias("s"), tx.conviction(F.col("p")).alias("c")).collect()]
    assert got == [("BUY", "High"), ("HOLD", "Medium"), ("HOLD", "Low"), ("SELL", "Low"), ("SELL", "High")]


def test_bad_quarter_labels(spark):
    from callgauge.functions.calendar import quarter_end

    got = run(spark, quarter_end, "Q2 2023", "Q5 2023", "2023 Q1", "", None, "Q4 1999")
    assert [str(g) if g else None for g in got] == ["2023-06-30", None, None, None, None, "1999-12-31"]
