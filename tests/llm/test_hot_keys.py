"""Equal rows and repeated ids, however many, neither fill one group nor pass the bound of a fit."""

import collections

import numpy as np

from callgauge.llm import packing, search, toxicity


def test_equal_pieces_spread_over_all_groups(spark, tmp_path):
    rows = [(None, None)] * 900 + [(7, "the same words")] * 300 + [(i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    packed = packing.pack_documents(docs, group_pieces=130).collect()
    assert len(packed) == len(rows)
    sizes = collections.Counter(r.sequence_id >> 32 for r in packed)
    assert len(sizes) == 10 and max(sizes.values()) < 250
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 2048


def test_repeated_ids_are_learnt_once(spark, monkeypatch):
    rows = [(i, f"good plain words {i}") for i in range(20)] + [(i, f"vile awful words {i}") for i in range(20, 40)] + [(5, "good plain")] * 500
    labels = [(i, int(i >= 20)) for i in range(40)] + [(5, 0)] * 50
    learnt = []
    fit = toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda r, y, *a, **k: (learnt.append(len(r)), fit(r, y, *a, **k))[1])
    weights = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), rows=30)
    assert learnt == [30]
    assert weights.score("vile awful words") > 0.5 > weights.score("good plain words")


def test_vectors_go_to_the_nearest_pivot_of_their_length(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-50, 50, 3 if i % 3 else 5).tolist()) for i in range(60)] + [(99, []), (100, [1])]
    pivots = [v for _, v in vectors[:6]]
    got = search.in_blocks(spark.createDataFrame(vectors, "vec_id bigint, v array<bigint>"), pivots, rows=8).collect()
    assert len(got) == len(vectors)
    for r in got:
        known = [np.array(p) for p in pivots if len(p) == len(r.v)]
        want = int(np.argmin([((p - np.array(r.v)) ** 2).sum() for p in known])) if known else -1
        assert (r.dim, r.cell) == (len(r.v), want)
