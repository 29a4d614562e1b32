"""Text operators on tables: one row in, one row out, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions import fixed, text as tx

SECTIONS = ("prepared_remarks", "qa_section", "full_text")
Lexicon = Mapping[str, Sequence[str]]


def with_defaults(df: DataFrame) -> DataFrame:
    """Metadata of a call with defaults for what is absent."""
    defaults = {
        "ticker": F.lit(""), "company_name": F.lit(""), "quarter": F.lit(""), "date": F.lit(None).cast("date"),
        "fiscal_year": F.lit(0), "fiscal_quarter": F.lit(0), "source": F.lit("UNKNOWN"),
    }
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})


def clean_transcripts(
    df: DataFrame,
    sections: Sequence[str] = SECTIONS,
    boilerplate: Sequence[str] = tuple(fixed.BOILERPLATE),
    keep_newlines: bool = False,
) -> DataFrame:
    """Boilerplate out, text normalised; lengths before (after boilerplate) and after."""
    normal = tx.normalize_keeping_lines if keep_newlines else tx.normalize_text
    out = df.withColumns({
        c: tx.remove_boilerplate(F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(""), boilerplate)
        for c in sections
    })
    out = out.withColumns({f"{c}_cleaned": normal(F.col(c)) for c in sections})
    lengths: dict[str, Column] = {}
    for c in sections:
        lengths[f"{c}_original_length"] = F.length(c)
        lengths[f"{c}_cleaned_length"] = F.length(f"{c}_cleaned")
    out = out.withColumns(lengths)
    removed = [F.col(f"{c}_original_length") - F.col(f"{c}_cleaned_length") for c in sections if c != "full_text"]
    total = sum(removed[1:], removed[0]) if removed else F.lit(0)
    return out.withColumn("total_chars_removed", total)


def drop_empty_text(df: DataFrame, col: str = "full_text_cleaned") -> DataFrame:
    return df.filter(F.length(col) > 0)


def segment(
    df: DataFrame,
    col: str = "full_text_cleaned",
    markers: Sequence[str] = tuple(fixed.QA_MARKERS),
    intros: Sequence[str] = tuple(fixed.ANALYST_INTROS),
    management: Sequence[str] = tuple(fixed.MANAGEMENT_LINES),
    analyst: Sequence[str] = tuple(fixed.ANALYST_LINES),
) -> DataFrame:
    """Management and analyst text of each call.

    With a question part: what stands before it, and what follows analyst intros in it.
    Without one: speaker lines, rescued by question sentences where they give little.
    """
    text = F.col(col)

    def role(value: Column, name: str) -> Column:
        return value.cast("string").alias(name)

    def by_questions(at: Column) -> Column:
        whole = F.substring(text, at, F.length(text))
        return F.struct(role(F.substring(text, F.lit(1), at - 1), "management"), role(tx.extract_analyst(whole, intros), "analyst"))

    def by_speakers(parts: Column) -> Column:
        questions = F.when(tx.word_count(parts["analyst"]) < 20, tx.question_sentences(text))
        return tx.let(questions, lambda q: F.when(
            F.coalesce(F.size(q) >= 3, F.lit(False)),
            F.struct(role(tx.remove_questions(parts["management"], text), "management"), role(F.array_join(q, " "), "analyst")),
        ).otherwise(F.struct(role(parts["management"], "management"), role(parts["analyst"], "analyst"))))

    # every search runs once a row: each later step is given the value an earlier one found
    roles = F.when(F.col("__at").isNotNull(), by_questions(F.col("__at"))).otherwise(tx.let(tx.speaker_parts(text, management, analyst), by_speakers))
    staged = df.withColumn("__at", tx.qa_start(text, markers)).withColumn("__roles", roles)
    return staged.withColumns({
        "management_text": F.col("__roles.management"), "analyst_text": F.col("__roles.analyst"), "fallback_used": F.col("__at").isNull(),
    }).drop("__at", "__roles")


def segment_counts(df: DataFrame) -> DataFrame:
    """Words and utterances by role, and their ratio (0 without analyst words)."""
    ends = F.lit(r"[.!?]+")
    out = df.withColumns({
        "management_word_count": tx.word_count(F.col("management_text")),
        "analyst_word_count": tx.word_count(F.col("analyst_text")),
        "management_utterances": F.regexp_count("management_text", ends),
        "analyst_utterances": F.regexp_count("analyst_text", ends),
    })
    return out.withColumn(
        "management_analyst_ratio",
        F.when(F.col("analyst_word_count") > 0, F.col("management_word_count") / F.col("analyst_word_count")).otherwise(0.0),
    )


def coalesce_text(df: DataFrame, markers: Sequence[str] = tuple(fixed.SPLIT_MARKERS)) -> DataFrame:
    """``management_text``, ``analyst_text`` and ``text`` of a call, whatever names it came with.

    Without any role text the best full text is split at its earliest plain marker.
    """

    def first_of(*names: str) -> Column:
        have = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(""))

    staged = df.withColumns({
        "__m": first_of("management_text", "total_management_text"),
        "__a": first_of("analyst_text", "total_analyst_text"),
        "__f": first_of("full_text_cleaned", "full_text", "prepared_remarks_cleaned", "prepared_remarks"),
    })
    bare = tx.is_blank(F.col("__m")) & tx.is_blank(F.col("__a"))
    at = F.coalesce(tx.split_marker_start(F.col("__f"), markers), F.length("__f") + 1)
    return staged.withColumns({
        "management_text": F.when(bare, F.substring(F.col("__f"), F.lit(1), at - 1)).otherwise(F.col("__m")),
        "analyst_text": F.when(bare, F.substring(F.col("__f"), at, F.length("__f"))).otherwise(F.col("__a")),
        "text": F.when(bare, F.col("__f")).otherwise(F.concat_ws(" ", "__m", "__a")),
    }).drop("__m", "__a", "__f")


def model_text(df: DataFrame, name: str = "model_text") -> DataFrame:
    """The text handed to a scoring model: role texts, else full text, never empty."""
    have = [c for c in ("management_text", "total_management_text") if c in df.columns]
    have_a = [c for c in ("analyst_text", "total_analyst_text") if c in df.columns]
    have_f = [c for c in ("full_text_cleaned", "full_text") if c in df.columns]
    pick = lambda names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    roles = F.concat_ws(" ", pick(have), pick(have_a))
    best = F.when(tx.is_blank(pick(have)) & tx.is_blank(pick(have_a)), pick(have_f)).otherwise(roles)
    return df.withColumn(name, F.coalesce(F.nullif(tx.strip(best), F.lit("")), F.lit(" ")))


def lexicon_scores(df: DataFrame, tokens: str, lexicon: Lexicon, prefix: str = "", total: Column | None = None) -> DataFrame:
    """Five shares, three counts and the net share of a token column; zeros without tokens."""
    n = F.size(tokens)
    staged = df.withColumns({
        f"__{c}": k for c, k in tx.lexicon_counts(F.col(tokens), {c: lexicon.get(c, ()) for c in fixed.LEXICON_CATEGORIES}).items()
    })
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    out = {f"{prefix}lm_{c}": share(F.col(f"__{c}")) for c in fixed.LEXICON_CATEGORIES}
    out |= {f"{prefix}lm_{c}_count": F.col(f"__{c}") for c in ("negative", "positive", "uncertainty")}
    out[f"{prefix}lm_net_sentiment"] = share(F.col("__positive") - F.col("__negative"))
    return staged.withColumns(out).drop(*[f"__{c}" for c in fixed.LEXICON_CATEGORIES])


def dead_words(lexicon: Lexicon) -> dict[str, list[str]]:
    """Lexicon words the tokenizer can never produce, such as hyphenated ones."""
    return {c: [w for w in ws if not w.replace("_", "").isalnum() or w != w.lower()] for c, ws in lexicon.items()}


def text_statistics(df: DataFrame, text: str, tokens: str, prefix: str = "") -> DataFrame:
    n = F.size(tokens)
    sentences = F.size(F.filter(F.split(F.col(text), r"\."), lambda s: s.rlike(fixed.NOT_SPACE)))
    out = df.withColumns({
        f"{prefix}word_count": n,
        f"{prefix}char_count": F.length(text),
        f"{prefix}sentence_count": sentences,
        f"{prefix}unique_words": F.size(F.array_distinct(tokens)),
        f"{prefix}question_count": F.length(text) - F.length(F.replace(F.col(text), F.lit("?"), F.lit(""))),
        f"{prefix}avg_word_length": F.when(n > 0, F.length(F.array_join(tokens, "")) / n).otherwise(0.0),
    })
    wc, sc = F.col(f"{prefix}word_count"), F.col(f"{prefix}sentence_count")
    return out.withColumns({
        f"{prefix}avg_sentence_length": F.when(sc > 0, wc / sc).otherwise(0.0),
        f"{prefix}lexical_diversity": F.when(wc > 0, F.col(f"{prefix}unique_words") / wc).otherwise(0.0),
    })


def nlp_features(df: DataFrame, lexicon: Lexicon, keys: Sequence[str] = ("ticker", "quarter", "date")) -> DataFrame:
    """Lexicon scores and text statistics of a call, whole and by role, with divergences."""
    staged = coalesce_text(df)
    for prefix, col in (("", "text"), ("mgmt_", "management_text"), ("analyst_", "analyst_text")):
        staged = staged.withColumn(f"__{prefix}tok", tx.tokenize(F.col(col)))
        staged = lexicon_scores(staged, f"__{prefix}tok", lexicon, prefix)
        staged = text_statistics(staged, col, f"__{prefix}tok", prefix)
    names = [f"lm_{c}" for c in fixed.LEXICON_CATEGORIES]
    names += ["lm_negative_count", "lm_positive_count", "lm_uncertainty_count", "lm_net_sentiment"]
    chosen = [*names, *[f"mgmt_{n}" for n in names], *[f"analyst_{n}" for n in names]]
    chosen += ["word_count", "char_count", "sentence_count", "avg_word_length", "avg_sentence_length",
               "unique_words", "lexical_diversity", "question_count"]
    chosen += [f"{r}_{n}" for r in ("mgmt", "analyst") for n in ("word_count", "sentence_count", "avg_word_length")]
    return staged.select(
        *keys, *chosen,
        (F.col("mgmt_lm_net_sentiment") - F.col("analyst_lm_net_sentiment")).alias("lm_sentiment_divergence"),
        (F.col("mgmt_lm_uncertainty") - F.col("analyst_lm_uncertainty")).alias("uncertainty_divergence"),
    )


def term_frequency(
    df: DataFrame, text: str, terms: Sequence[str] = tuple(fixed.WATCH_TERMS), risk: Sequence[str] = tuple(fixed.RISK_TERMS)
) -> DataFrame:
    """Mentions of each watched term over all texts, with its class, most frequent first."""
    low = F.lower(F.col(text))
    sums = df.agg(*[F.sum(F.regexp_count(low, F.lit(r"(?<![\p{L}\p{N}_])" + t + r"(?![\p{L}\p{N}_])"))).alias(t) for t in terms])
    return (
        sums.unpivot([], [F.col(f"`{t}`") for t in terms], "term", "mentions")
        .withColumn("class", F.when(F.col("term").isin(*risk), "risk").otherwise("growth"))
        .orderBy(F.desc("mentions"), "term")
    )


def identity_mismatch(df: DataFrame, text: str, ticker: str, quarter: str, year: str) -> DataFrame:
    hit = tx.header_mismatch(F.col(text), F.col(ticker), F.col(quarter), F.col(year))
    return df.withColumn("__h", hit).select("*", "__h.*").drop("__h")


def covered_symbols(df: DataFrame, col: str, coverage: DataFrame, coverage_col: str) -> DataFrame:
    """``symbol_valid`` by form, ``symbol_covered`` by membership in a coverage table."""
    known = coverage.select(F.col(coverage_col).alias(col)).filter(F.col(col).isNotNull()).distinct()
    return df.join(known.withColumn("symbol_covered", F.lit(True)), col, "left").withColumns({
        "symbol_valid": tx.valid_symbol(F.col(col)),
        "symbol_covered": F.coalesce("symbol_covered", F.lit(False)),
    })
