"""Text expressions; all stay in the JVM and none needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from callgauge.functions import fixed
from callgauge.functions.fixed import NOT_SPACE, SPACE, SPACE_CHARS


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(NOT_SPACE)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(rf"{NOT_SPACE}+")), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"{NOT_SPACE}+"), F.lit(0))


def remove_boilerplate(c: Column, patterns: Sequence[str] = tuple(fixed.BOILERPLATE)) -> Column:
    """Standard phrases to one blank each, in list order; then squeeze blanks and trim."""
    out = reduce(lambda acc, p: _sub(acc, p, " "), patterns, c)
    return strip(_sub(out, "  +", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _where_contains(c: Column, needles: Sequence[str], change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` only where a plain search finds one of the needles: a search costs a
    fraction of a pattern."""
    return let(c, lambda v: F.when(reduce(lambda a, b: a | b, [v.contains(n) for n in needles]), change(v)).otherwise(v))


def normalize_text(c: Column) -> Column:
    """Whitespace, stage directions, tags, repeated marks, symbols and dashes."""
    out = _sub(F.coalesce(c, F.lit("")), rf"{SPACE}+", " ")
    out = _where_contains(out, ["["], lambda v: _sub(v, r"\[[^\]]*\]", ""))
    out = _where_contains(out, ["<"], lambda v: _sub(v, r"<[^>]+>", ""))
    out = _where_contains(out, ["..", "!!", "??"], lambda v: _sub(v, r"([.!?])\1+", "$1"))
    out = _sub(out, r"[@#$%^&*~`]", "")
    out = F.replace(F.replace(out, F.lit("—"), F.lit("-")), F.lit("–"), F.lit("-"))
    out = _where_contains(out, [" -"], lambda v: _sub(v, r" +- +", " - "))
    out = _where_contains(out, ["  "], lambda v: _sub(v, r"([.!?]) {2,}", "$1 "))
    return F.trim(out)


def normalize_keeping_lines(c: Column) -> Column:
    """As :func:`normalize_text`, line by line, so that speaker lines stay visible."""
    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), normalize_text), "\n")


LINE_START = r"(?:^|\n)"


def any_of(patterns: Sequence[str]) -> str:
    """One pattern for all; those bound to a line start share a single test for it."""
    bound = [p[len(LINE_START):] for p in patterns if p.startswith(LINE_START)]
    free = [f"(?:{p})" for p in patterns if not p.startswith(LINE_START)]
    if bound:
        free.append(LINE_START + "(?:" + "|".join(f"(?:{p})" for p in bound) + ")")
    return "(?i)" + "|".join(free)


def qa_start(c: Column, markers: Sequence[str] = tuple(fixed.QA_MARKERS)) -> Column:
    """1-based start of the question part, null if there is none.

    The first marker of the list that matches decides; a match at the very start is none.
    """
    at = F.coalesce(*[F.nullif(F.regexp_instr(c, F.lit("(?i)" + m)), F.lit(0)) for m in markers])
    return F.when(at > 1, at)


# pieces around a question mark; starts only where a piece can start, so the scan stays linear
QUESTION = r"(?:\G|(?<![^.!?]))[^.!?]*+\?[^.!?]*+"


def question_sentences(c: Column) -> Column:
    """All pieces around a question mark, up to the neighbouring sentence ends."""
    found = F.regexp_extract_all(c, F.lit(QUESTION), F.lit(0))
    return F.when(c.contains("?"), found).otherwise(F.array().cast("array<string>"))


def extract_analyst(c: Column, intros: Sequence[str] = tuple(fixed.ANALYST_INTROS)) -> Column:
    """Text after each analyst intro, pattern by pattern; question sentences if no intro occurs."""
    parts = [F.split(c, "(?i)" + p) for p in intros]
    after = F.concat(*[F.slice(p, F.lit(2), F.size(p)) for p in parts])
    return F.array_join(F.when(F.size(after) > 0, after).otherwise(question_sentences(c)), " ")


def speaker_codes(
    lines: Column,
    management: Sequence[str] = tuple(fixed.MANAGEMENT_LINES),
    analyst: Sequence[str] = tuple(fixed.ANALYST_LINES),
) -> Column:
    """One letter per line: A for analyst, anything else for management, carried downwards."""
    m, a, either = any_of(management), any_of(analyst), any_of([*management, *analyst])

    def code(line: Column) -> Column:
        is_m, is_a = line.rlike(m), line.rlike(a)
        return F.when(~line.rlike(either), "-").when(is_m & ~is_a, "M").when(is_a & ~is_m, "A").otherwise("-")

    marks = F.array_join(F.transform(lines, code), "")
    return F.split(_sub(marks, r"(?<=A)-|\G(?!^)-", "A"), "")


def speaker_parts(c: Column, management=tuple(fixed.MANAGEMENT_LINES), analyst=tuple(fixed.ANALYST_LINES)) -> Column:
    """Struct (management, analyst): the lines of each role joined by blanks."""

    def of(lines: Column, codes: Column, analyst_role: bool) -> Column:
        chosen = F.zip_with(lines, codes, lambda x, k: F.when((k == "A") == F.lit(analyst_role), x))
        return F.array_join(F.array_compact(chosen), " ")

    def parts(lines: Column) -> Column:
        return let(
            speaker_codes(lines, management, analyst),
            lambda codes: F.struct(of(lines, codes, False).alias("management"), of(lines, codes, True).alias("analyst")),
        )

    return let(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), parts)


def remove_each_once(c: Column, pieces: Column) -> Column:
    """Cut the first occurrence of every piece, one after the other."""

    def cut(acc: Column, piece: Column) -> Column:
        at = F.position(piece, acc)
        return F.when(
            at > 0,
            F.concat(F.substring(acc, F.lit(1), at - 1), F.substring(acc, at + F.length(piece), F.length(acc))),
        ).otherwise(acc)

    return F.aggregate(pieces, c, cut)


def remove_questions(c: Column, source: Column) -> Column:
    """``remove_each_once(c, question_sentences(source))``, in one scan where both texts are the same.

    Every question mark belongs to one piece, and with the earlier ones gone the first place a
    piece can occur is its own, so cutting all pieces of a text out of itself is one replacement.
    """
    each = remove_each_once(c, F.filter(question_sentences(source), lambda q: ~q.contains("\n")))
    return F.when(c == source, _sub(c, QUESTION, "")).when(c.contains("\n"), remove_each_once(c, question_sentences(source))).otherwise(each)


def tokenize(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def lexicon_counts(tokens: Column, lexicon: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Tokens per category; the literal list becomes a hash-set test in the JVM."""

    def count(words_of: Sequence[str]) -> Column:
        chosen = sorted(set(words_of))
        return F.size(F.filter(tokens, lambda t: t.isin(*chosen))) if chosen else F.lit(0)

    return {cat: count(ws) for cat, ws in lexicon.items()}


def split_marker_start(c: Column, markers: Sequence[str] = tuple(fixed.SPLIT_MARKERS)) -> Column:
    """1-based start of the earliest plain marker (any case), null if none occurs."""
    upper = F.upper(c)
    hits = [F.nullif(F.instr(upper, m.upper()), F.lit(0)) for m in markers]
    return F.least(*hits) if len(hits) > 1 else hits[0]


def token_window(c: Column, skip: int = 60, size: int = 510, longer_than: int = 120) -> Column:
    """The tokens a model gets to see: a long text loses its opening."""
    toks = words(F.coalesce(c, F.lit("")))
    window = F.when(F.size(toks) > longer_than, F.slice(toks, skip + 1, size)).otherwise(F.slice(toks, 1, size))
    return F.coalesce(F.nullif(F.array_join(window, " "), F.lit("")), F.lit(" "))


def identity_from_filename(c: Column, ticker: str = "AAPL", quarter: str = "Q1", year: int = 2025) -> Column:
    """Struct (ticker, quarter, year) read from a file name, with defaults."""
    stem = _sub(c, r"\.[^.]+\z", "")
    parts = F.split(F.upper(stem), r"[_\-\.\s]+")
    quarters = F.filter(parts, lambda p: p.rlike(r"^Q[1-4]\z"))
    years = F.filter(parts, lambda p: p.rlike(r"^20[0-9]{2}\z"))
    symbols = F.filter(parts, lambda p: p.rlike(r"^[A-Z]{1,5}\z") & ~p.isin(*fixed.NAME_STOP_WORDS))
    return F.struct(
        F.coalesce(F.try_element_at(symbols, F.lit(1)), F.lit(ticker)).alias("ticker"),
        F.coalesce(F.try_element_at(quarters, F.lit(-1)), F.lit(quarter)).alias("quarter"),
        F.coalesce(F.try_element_at(years, F.lit(-1)).cast("int"), F.lit(year)).alias("year"),
    )


def valid_symbol(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{1,5}(-[A-Z])?\z")


def header_mismatch(text: Column, ticker: Column, quarter: Column, year: Column, head: int = 1500) -> Column:
    """Struct of doubts whether the opening of a text belongs to (ticker, quarter, year)."""
    top = F.upper(F.substring(text, 1, head))
    seen = {q: reduce(lambda a, b: a | b, [top.contains(w) for w in ws]) for q, ws in fixed.QUARTER_WORDS.items()}
    own = F.coalesce(reduce(lambda a, b: a | b, [(quarter == q) & hit for q, hit in seen.items()]), F.lit(False))
    others = F.array_compact(F.array(*[F.when(hit & (quarter != q), F.lit(q)) for q, hit in seen.items()]))
    other_text = F.array_join(others, " / ")
    year_text = year.cast("string")
    named = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), ticker, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.struct(
        (F.coalesce(ticker != "", F.lit(False)) & ~F.regexp_like(top, named)).alias("ticker_absent"),
        F.when(own, "ok").when(other_text != "", "other").otherwise("unclear").alias("quarter_status"),
        F.when(~own, other_text).otherwise("").alias("other_quarters"),
        (~top.contains(year_text)).alias("year_absent"),
        F.when(~top.contains(year_text), F.regexp_extract(top, "20[1-9][0-9]", 0)).otherwise("").alias("other_year"),
    )


def section_delta(exec_pos: Column, exec_neg: Column, qa_pos: Column, qa_neg: Column, margin: float = 0.05) -> Column:
    return (
        F.when(qa_pos - exec_pos > margin, "more positive")
        .when(qa_neg - exec_neg > margin, "more negative")
        .otherwise("similar")
    )


def tone_band(c: Column, role: str = "management") -> Column:
    labels = ("Positive", "Cautious", "Negative") if role == "management" else ("Receptive", "Neutral", "Skeptical")
    return F.when(c > 0.6, labels[0]).when(c > 0.45, labels[1]).otherwise(labels[2])


def signal(prob: Column, buy: float = 0.58, sell: float = 0.45) -> Column:
    return F.when(prob > buy, "BUY").when(prob < sell, "SELL").otherwise("HOLD")


def conviction(prob: Column) -> Column:
    gap = F.abs(prob - 0.5)
    return F.when(gap > 0.15, "High").when(gap > 0.07, "Medium").otherwise("Low")
