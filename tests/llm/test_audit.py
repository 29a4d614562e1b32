"""The filter audit: diagrams against counting masks, and the whole query against plain Python at the edges."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from callgauge.llm import audit

NAMES = "ABCDE"


def by_masks(counts, names):
    """The same figures by looking at every mask for every order and step."""
    out, shapley = {}, defaultdict(int)
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            kept = sum(w[0] for m, w in counts.items() if not m & (before | bit))
            gone = [sum(w[k] for m, w in counts.items() if m & bit and not m & before) for k in range(3)]
            redundant = sum(w[0] for m, w in counts.items() if m & bit and m & before)
            out["".join(order), step] = [kept, gone[0], redundant, sum(w[0] for m, w in counts.items() if m == bit), gone[1], gone[2]]
            shapley[name] += gone[0]
            before |= bit
    return {key: [*row, shapley[key[0][key[1] - 1]]] for key, row in out.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_every_order_once(n):
    order = list(NAMES[:n])
    seen = [tuple(order)]
    for at in audit.plain_changes(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) and set(seen) == set(permutations(NAMES[:n]))


@pytest.mark.parametrize("seed, masks", [(1, 32), (2, 9), (3, 1), (4, 0)])
def test_diagrams_agree_with_masks(seed, masks):
    rng = random.Random(seed)
    counts = {m: (n := rng.randint(1, 9), rng.randint(0, n), rng.randint(0, n)) for m in rng.sample(range(32), masks)}
    got = {(order, step): list(rest) for order, step, *rest in audit.audit_counts(counts, NAMES)}
    assert got == by_masks(counts, NAMES)


def test_swaps_keep_the_weights_and_share_nodes():
    counts = {m: (1, 0, 0) for m in range(32)}
    diagram = audit.Diagram(counts, NAMES)
    # all sub-diagrams of a level are alike, so each level is one node
    assert [len(level) for level in diagram.levels] == [1] * 6
    for at in audit.plain_changes(5):
        diagram.swap(at)
        assert diagram.weight[diagram.root] == (32, 0, 0) and [len(level) for level in diagram.levels] == [1] * 6


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return sum(b << i for i, b in enumerate([
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))]))


def test_query_at_the_edges(spark):
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(1, None, None), (2, "", "en"), (3, "", None), (4, "ÄÖ É", "en"), (5, "AB cd|", "en"), (6, long, "de"), (7, long, "en"), (7, long, "en"), (None, long, "en"), (8, "x " * 5000, "de"),
            (9, "AB cd|", ""), (9, "other", "en"), (10, long + " $", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS part", "2 AS mask", "3 AS key", "4 AS good", "5 AS first")
    labels = spark.createDataFrame([(1, 1, 0), (5, None, 1), (7, 0, 0), (7, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    good, toxic = {1, 7}, {5}
    parts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for i, text, lang in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        w = parts[lang or ""][plain_mask(text or "") | copy << 4]
        for k, hit in enumerate((True, i in good, i in toxic)):
            w[k] += hit
    want = sorted((p, order, step, *row) for p, counts in parts.items() for (order, step), row in by_masks(counts, NAMES).items())
    got = audit.audit_filters(docs, labels)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert audit.audit_filters(docs.filter("false"), labels).count() == 0
    assert audit.audit_filters(docs, labels.filter("false")).selectExpr("sum(good_lost + toxic_lost) AS s").first().s == 0
