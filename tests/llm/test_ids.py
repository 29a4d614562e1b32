"""Ids that repeat with different texts, and rows without an id, in the near-copy join and the suffix removal."""

import pytest

from callgauge.llm import jaccard, packing, suffixes


def text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("turn", [1, -1])
def test_each_text_of_an_id_is_compared(spark, turn):
    a, b = text("a"), text("b")
    rows = [(4, a), (4, b), (7, a + " x"), (9, b + " y"), (10, text("c"))][::turn]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {4: 4, 7: 4, 9: 4, 10: 10}
    kept = {(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()}
    assert kept == {(4, a), (4, b), (10, text("c"))}


def test_one_id_in_one_small_cell(spark):
    # the texts of id 1 are near copies of each other, so both come to one region
    a = text("a")
    rows = [(1, a), (1, a + " x"), (2, a + " y z"), (2, text("q"))]
    assert {(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()} in ({(1, a), (2, text("q"))}, {(1, a + " x"), (2, text("q"))})


def test_rows_without_id_are_kept_and_compared(spark):
    a, b = text("a"), text("b")
    rows = [(None, a), (None, a), (None, b), (5, b + " x"), (None, text("c")), (None, ""), (6, None)]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(None, a), (5, b + " x"), (None, text("c")), (None, ""), (6, None)], key=repr)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, None)] * 4 + [(None, 5), (5, 5), (6, 6)], key=repr)


def test_repeats_in_rows_without_id(spark):
    shared, own = text("s", 120) + ".", " And more of it here."
    big = 2**60 + 1
    rows = [(None, shared + own), (None, shared + " Other."), (big, shared + " Third."), (None, "alone")]
    got = sorted(((r.doc_id, r.text) for r in suffixes.without_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, own[1:]), (None, "Other."), (big, "Third."), (None, "alone")], key=repr)


def test_packing_keeps_rows_without_id(spark):
    got = packing.pack_documents(frame(spark, [(None, "alone"), (5, "other")])).collect()
    assert {r.doc_id for r in got} == {None, 5}
