"""What each filter of a chain does in every order of the chain, by count-weighted decision diagrams.

Each document has a mask: one bit for each filter it fails. An aggregate counts documents by part and
mask, so whatever the corpus, a part is 2**k counts for k filters. From these a part's decision diagram
is built: a level for each filter, a node with a branch for passing and one for failing, equal
sub-diagrams held once, and at the ends the counts (documents, good ones, toxic ones). The weight of a
node is the sum of what hangs below it.

Every order of the filters is visited by swapping two adjacent levels at a time (plain changes), which
touches only the nodes of those two levels. In each order the path on which all filters so far pass
gives the chain's steps: what the passing branch weighs is kept, what the failing branch weighs is
removed here. Orders in which a filter comes first show all its failures, and those in which it comes
last show the failures that are its alone.

Copies are found by an aggregate of the smallest id per text (128-bit hash) and an equality join on
text and id, which spreads the members of one large group of copies over all tasks.

Defined cases: null text counts as empty, null part as the empty string; a row without an id is not
taken for a copy and has no labels, but counts; rows that repeat id and text are no copies of each
other, as neither id is smaller; of several labels of one id any 1 counts; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.quality import SPACE
from callgauge.llm.registry import query, table
from callgauge.llm.stages import Stage

#: Weights at the ends of a diagram.
WEIGHTS = ("n", "good", "toxic")
COPY = "E"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Diagram:
    """Decision diagram over failure masks; 0 is the diagram without documents.

    ``levels[i]`` holds the nodes that test ``order[i]`` as {(passing child, failing child): node}.
    """

    def __init__(self, counts: Mapping[int, tuple[int, ...]], filters: Sequence[str]):
        self.order = list(filters)
        self.children: dict[int, tuple[int, int]] = {}
        self.weight: dict[int, tuple[int, ...]] = {0: (0,) * len(WEIGHTS)}
        self.levels: list[dict] = [{} for _ in range(len(self.order) + 1)]
        self.root = self._build(0, dict(counts))

    def _build(self, level: int, counts: dict[int, tuple[int, ...]]) -> int:
        if not counts:
            return 0
        if level == len(self.order):
            (weight,) = counts.values()
            node = self.levels[level].setdefault(weight, len(self.weight))
            self.weight[node] = weight
            return node
        sides = [{m: w for m, w in counts.items() if (m >> level & 1) == side} for side in (0, 1)]
        return self._node(level, *(self._build(level + 1, s) for s in sides))

    def _node(self, level: int, passing: int, failing: int) -> int:
        if not passing and not failing:
            return 0
        node = self.levels[level].get((passing, failing))
        if node is None:
            node = len(self.weight)
            self.levels[level][passing, failing] = node
            self.children[node] = passing, failing
            self.weight[node] = tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing]))
        return node

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes above keep their place and meaning."""
        upper = self.levels[level]
        self.levels[level], self.levels[level + 1] = {}, {}
        for (passing, failing), node in upper.items():
            both, second = self.children.get(passing, (0, 0))
            first, none = self.children.get(failing, (0, 0))
            pair = self._node(level + 1, both, first), self._node(level + 1, second, none)
            self.levels[level][pair] = node
            self.children[node] = pair
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights kept, weights removed) along the path on which all pass."""
        out, node = [], self.root
        for name in self.order:
            passing, failing = self.children.get(node, (0, 0))
            out.append((name, self.weight[passing], self.weight[failing]))
            node = passing
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Adjacent swaps (place of the left one) that visit all orders of ``n`` things once."""
    down, inner = True, plain_changes(n - 1) if n > 2 else iter(())
    while n > 1:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + down
        down = not down


def audit_counts(counts: Mapping[int, tuple[int, ...]], filters: Sequence[str]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order."""
    diagram = Diagram(counts, filters)
    paths = [("".join(diagram.order), diagram.steps())]
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        paths.append(("".join(diagram.order), diagram.steps()))
    fails = {path[0][0]: path[0][2][0] for _, path in paths}
    alone = {path[-1][0]: path[-1][2][0] for _, path in paths}
    shapley = dict.fromkeys(filters, 0)
    for _, path in paths:
        for name, _, removed in path:
            shapley[name] += removed[0]
    return [
        (order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for order, path in paths for step, (name, kept, removed) in enumerate(path, 1)
    ]


def text_failures(text: Column) -> tuple[Column, dict[str, Column]]:
    """An array of words to be computed first (as ``__words``), and the conditions A to D over it and ``__text``."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    return words, {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count("__text", F.lit("[A-Z]")).cast("long") > 10 * F.length("__text").cast("long"),
        "D": F.col("__text").rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, stage: Stage, part: str = "lang") -> tuple[DataFrame, list[str]]:
    """(part, mask, n, good, toxic) and the filters by bit: the texts are read once, then narrow rows travel."""
    words, failures = text_failures(F.col("__text"))
    names = [*failures, COPY]
    bits = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(failures.values())), F.lit(0))
    texts = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = texts.select("doc_id", "part", F.unhex(F.md5("__text")).alias("key"), "__text", words.alias("__words"))
    rows = stage.write(rows.select("doc_id", "part", "key", bits.alias("mask")), "masks")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    whole = rows.join(marks, "doc_id", "left").join(first, ["doc_id", "key"], "left").select(
        "part", F.when(copy, F.col("mask") + (1 << names.index(COPY))).otherwise(F.col("mask")).alias("mask"), "good", "toxic")
    sums = [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic"))]
    counts = stage.write(whole.groupBy("part", "mask").agg(*sums), "mask-counts")
    stage.drop(rows)
    return counts, names


def audit_orders(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """All orders and steps of every part of ``counts`` (part, mask, n, good, toxic)."""
    names = list(filters)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        held = {int(r.mask): tuple(int(getattr(r, w)) for w in WEIGHTS) for r in group.itertuples()}
        return pd.DataFrame([(group["part"].iloc[0], *row) for row in audit_counts(held, names)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return counts.groupBy("part").applyInPandas(work, SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Audit of the five filters over ``docs`` (doc_id, text and ``part``)."""
    counts, names = mask_counts(docs, labels, Stage(docs.sparkSession), part)
    return audit_orders(counts, names)


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS l FROM orders, range(1, 6) r(step)),
bits AS (SELECT filter_order, step, l, 1 << (ascii(l) - 65) AS bit, coalesce(sum(1 << (ascii(l) - 65)) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS before FROM steps),
audit AS (SELECT part, filter_order, step, l,
  sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, bits GROUP BY part, filter_order, step, l)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM audit
"""


@query("op11_filter_audit", ORACLE)
def op11_filter_audit(spark, sf_dir):
    """What five filters keep and remove in each of their 120 orders, for each language."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
