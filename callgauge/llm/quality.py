"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at counts of one text and says good (1), bad (-1) or nothing (0). No rule can
reject a text alone. How far each rule is to be trusted is estimated without labels: the votes of
all documents are counted by pattern (at most 3 to the power of the number of rules, whatever the
corpus), and expectation-maximisation over those counts fits, for each rule, how often it says good
on good texts and bad on bad ones, and the share of good texts. The posterior probability of being
good decides.

Everything here is DataFrame expressions. A text is read once: its counts and votes are written as
a narrow stage table, from which both the fit and the verdicts read.

Defined cases: null text counts as empty; an empty text has zero counts, fails the base rules and is
not kept; repeated ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.registry import query, table
from callgauge.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
ITERATIONS = 15

#: Each kind of poor text offends two rules at least, else the fit could not tell it from noise.
#: Rule -> (good if, bad if), over the counts of ``text_counts``; both engines read these.
RULES: dict[str, tuple[str, str]] = {
    "enough_words": ("n_words >= 50", "n_words < 10"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "few_symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "fresh_lines": ("n_lines > 1 AND n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    "fresh_windows": ("20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "calm_case": ("5 * n_upper <= n_alnum", "5 * n_upper > 3 * n_alnum"),
    "prose_ends": ("10 * n_stops >= n_words / 4 AND 2 * n_stops <= n_words", "50 * n_stops < n_words OR 10 * n_stops > 9 * n_words"),
    "mostly_letters": ("100 * n_alnum >= 93 * word_chars", "100 * n_alnum < 88 * word_chars"),
}
#: Where the fit starts: the share of good texts, and how often a rule is right on good and on bad ones.
START = (0.85, 0.98, 0.3)
#: Accuracies on good and on bad texts stay within these limits. A bad text need not offend every rule, so
#: the second may be low: then saying good means little, and saying bad still means much.
LIMITS = ((0.5, 0.999), (0.1, 0.999))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first included.

    Windows are compared by hash; only where two agree are the windows themselves compared.
    """
    n = F.size(words)
    starts = F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))

    def repeated(pairs: Column) -> Column:
        def twin(p, i, ordered):
            before, after = F.get(ordered, i - 1)["key"], F.get(ordered, i + 1)["key"]
            return F.coalesce(before == p["key"], F.lit(False)) | F.coalesce(after == p["key"], F.lit(False))

        return bound(F.sort_array(pairs), lambda ordered: F.filter(ordered, lambda p, i: twin(p, i, ordered)))

    def covered(hashed: Column) -> Column:
        maybe = repeated(F.transform(hashed, lambda h, i: F.struct(h.alias("key"), i.alias("at"))))
        sure = repeated(F.transform(maybe, lambda p: F.struct(F.concat_ws(" ", F.slice(words, p["at"] + 1, WINDOW)).alias("key"), p["at"].alias("at"))))
        return F.aggregate(
            F.sort_array(F.transform(sure, lambda p: p["at"])),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"].cast("long"),
        )

    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each text that the rules use, beside the columns in ``keep``."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
    parts = docs.select(*keep, t.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    joined = F.array_join("__words", "")
    return parts.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__text", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_alnum"),
        F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("__text", r"[^.!?]+", "")).cast("long").alias("n_stops"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def votes(rules: Mapping[str, tuple[str, str]] = RULES) -> list[Column]:
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"vote_{name}") for name, (good, bad) in rules.items()]


def log_odds(prior: float, right: Mapping[str, tuple[float, float]]) -> Column:
    """Log odds of being good, given the votes: the prior's plus one term per vote cast."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name, (on_good, on_bad) in right.items():
        vote = F.col(f"vote_{name}")
        total = total + F.when(vote == 1, math.log(on_good / (1 - on_bad))).when(vote == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return total


def posterior(prior: float, right: Mapping[str, tuple[float, float]]) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(prior, right)))


def fit_votes(voted: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES, iterations: int = ITERATIONS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good texts and accuracies of each rule, by expectation-maximisation.

    All documents are counted by their votes in one aggregate. There are at most 3 to the power of the number
    of rules such patterns, whatever the corpus; the steps run over those counts.
    """
    names = list(rules)
    patterns = [tuple(row) for row in voted.groupBy(*(f"vote_{r}" for r in names)).count().collect()]
    prior, right = START[0], {r: START[1:] for r in rules}
    total = sum(row[-1] for row in patterns)

    def within(x: float, limits: tuple[float, float]) -> float:
        return min(max(x, limits[0]), limits[1])

    for _ in range(iterations if total else 0):
        gains = [{1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0.0} for g, b in (right[r] for r in names)]
        start = math.log(prior / (1 - prior))
        weights = [(row, row[-1] / (1 + math.exp(-start - sum(gain[v] for gain, v in zip(gains, row))))) for row in patterns]
        prior = within(math.fsum(good for _, good in weights) / total, (0.01, 0.99))
        for i, r in enumerate(names):
            cast = [(row[i], good, row[-1] - good) for row, good in weights if row[i]]
            said_good, good_all = (math.fsum(g for v, g, _ in cast if v in kinds) for kinds in ((1,), (1, -1)))
            said_bad, bad_all = (math.fsum(b for v, _, b in cast if v in kinds) for kinds in ((-1,), (1, -1)))
            right[r] = within((said_good + 1) / (good_all + 2), LIMITS[0]), within((said_bad + 1) / (bad_all + 2), LIMITS[1])
    return prior, right


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose ``text`` passes, all columns as they are.

    The texts are counted once: rows and votes are written, and read for the fit and for the verdict.
    """
    counted = text_counts(docs.select(F.struct("*").alias("__row"), "text"), "text", ("__row",))
    voted = materialize(counted.select("__row", base_failed().alias("base_failed"), *votes()), "votes")
    prior, right = fit_votes(voted)
    return voted.filter(~F.col("base_failed") & (posterior(prior, right) >= threshold)).select("__row.*")


def judge_quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior ``quality`` and verdict ``kept`` of every document."""
    counted = text_counts(docs, text, keep)
    voted = materialize(counted.select("*", base_failed().alias("base_failed"), *votes()), "votes")
    prior, right = fit_votes(voted)
    quality = posterior(prior, right)
    return voted.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (quality >= threshold)).alias("kept"), F.round(quality, 4).alias("quality"),
    )


def oracle(iterations: int = ITERATIONS) -> str:
    """The same in SQL: windows as rows, the fit as a recursive query."""
    names = list(RULES)
    vote_cols = ",\n".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{r}" for r, (good, bad) in RULES.items())
    terms = " + ".join(
        f"CASE vote_{r} WHEN 1 THEN ln(e.s[{i}] / (1 - e.t[{i}])) WHEN -1 THEN ln((1 - e.s[{i}]) / e.t[{i}]) ELSE 0 END" for i, r in enumerate(names, 1)
    )
    p = f"1 / (1 + exp(-(ln(e.prior / (1 - e.prior)) + {terms})))"
    rate = "least(greatest((coalesce(sum({w}) FILTER (vote_{r} = {v}), 0) + 1) / (coalesce(sum({w}) FILTER (vote_{r} <> 0), 0) + 2), {lo}), {hi})"
    s = ", ".join(rate.format(w="n * p", r=r, v=1, lo=LIMITS[0][0], hi=LIMITS[0][1]) for r in names)
    t = ", ".join(rate.format(w="n * (1 - p)", r=r, v=-1, lo=LIMITS[1][0], hi=LIMITS[1][1]) for r in names)
    start = f"SELECT 0 AS it, {START[0]}::DOUBLE AS prior, [{', '.join([str(START[1])] * len(names))}]::DOUBLE[] AS s, [{', '.join([str(START[2])] * len(names))}]::DOUBLE[] AS t"
    groups = ", ".join(f"vote_{r}" for r in names)
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM parts WHERE len(words) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS pos FROM twice) GROUP BY doc_id),
counts AS (SELECT p.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines))) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS n_alnum,
  length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^.!?]', '', 'g')) AS n_stops
  FROM parts p LEFT JOIN repeats r USING (doc_id)),
voted AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {vote_cols} FROM counts),
patterns AS (SELECT {groups}, count(*) AS n FROM voted GROUP BY ALL),
em AS ({start} UNION ALL
  SELECT it + 1, least(greatest(sum(n * p) / sum(n), 0.01), 0.99), [{s}], [{t}]
  FROM (SELECT e.it, g.*, {p} AS p FROM patterns g, em e WHERE e.it < {iterations}) GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {p} >= 0.5) AS kept, round({p}, 4) AS quality
FROM voted, em e WHERE e.it = {iterations}
"""


@query("op2_quality_rules", oracle())
def op2_quality_rules(spark, sf_dir):
    """Verdict of the voted rules on every document."""
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
