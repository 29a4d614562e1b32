"""Defined results at the edges: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest

from callgauge.llm import jaccard, licences, packing, pages, pieces, quality, search, sharding, suffixes, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = " ".join(f"word{i}" for i in range(60)) + "."
ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, WORDS, "en", "s", None), (4, WORDS, "en", "s", None), (5, "a b c", None, "s", 5),
        (6, WORDS + " And more of it here.", "en", "s", 1), (7, "x" * 3000, "en", "s", 3000), (8, "ß漢🙂 " * 700, "de", "s", 2800)]
CLASHES = ["score", "kept", "h", "owner", "cell", "spans", "a", "b", "quality", "n_words", "component_id", "start", "length", "shard", "slot", "family", "ids", "mark", "fp"]


def docs(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, DOC)
    for c in CLASHES if clash else []:
        df = df.selectExpr("*", f"doc_id AS `{c}`")
    return df


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, None, 0), (5, 1, 1), (6, 0, None), (7, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity(table, nothing, labels):
    got = toxicity.score_toxicity(table, toxicity.fit_toxicity(table, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert set(toxicity.filter_toxicity(table, labels).columns) == set(table.columns)
    assert toxicity.filter_toxicity(nothing, labels).count() == 0
    none = toxicity.fit_toxicity(table, labels.filter("false"))
    assert none.score("anything") < 0.01


def test_quality(table, nothing):
    got = {r.doc_id: r for r in quality.judge_quality(table).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 5)] == [0, 0, 0, 3] and all(got[i].base_failed and not got[i].kept for i in (1, 2, 3, 5))
    kept = quality.filter_quality(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge_quality(nothing).count() == 0 and quality.filter_quality(nothing).count() == 0


def test_pieces(table, nothing):
    got = pieces.digests(table).collect()
    assert len(got) == len(ROWS) and all(r.exact for r in got)
    assert {r.n_ids for r in got if r.doc_id in (1, 2)} == {0}
    assert pieces.digests(nothing).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(table)).collect()}
    assert back == {r[0]: r[1] or "" for r in ROWS}


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>One"), (3, "u", "<article><p>One"), (4, "u", "plain " * 300), (5, "u", "<script>x"), (None, "u", "<!-- <p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [(r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "", 0), (2, "", 0), (3, "One", 3), (3, "One", 3), (4, ("plain " * 300).strip(), 1799), (5, "", 0), (None, "", 0)], key=repr)
    assert pages.extract(df.filter("false")).count() == 0


def test_packing(table, nothing):
    got = packing.pack_documents(table, group_pieces=4).collect()
    assert {(r.doc_id, r.doc_tokens, r.length) for r in got if r.doc_id in (1, 2, 3)} == {(1, 1, 1), (2, 1, 1), (3, 1, 1)}
    assert sum(r.doc_id == 4 for r in got) == 2
    assert packing.pack_documents(nothing).count() == 0


def test_suffixes(table, nothing):
    got = suffixes.remove_repeats(table).drop("kept").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and (by[1].n_bytes, by[1].n_removed, by[1].n_spans, by[1].kept_sha256) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    # both copies go, and what a longer text shares with them; a text of one letter repeats itself
    assert by[4].n_removed == len(WORDS) and by[6].n_removed == len(WORDS) and by[7].n_removed == 3000
    out = suffixes.without_repeats(table)
    assert out.columns == table.columns and {r.text for r in out.filter("doc_id = 6").collect()} == {" And more of it here."}
    assert suffixes.without_repeats(nothing).count() == 0


def test_sharding(table, nothing):
    got = sharding.place(table, shards=("a", "b"), slots=7)
    assert got.count() == len(ROWS) and got.filter("shard IS NULL").count() == 0
    assert sharding.place(nothing).count() == 0
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill_table(("a",), 8)


def test_licences(spark, nothing):
    rows = [(1, None), (2, ""), (3, "Text.\nReleased under the MIT License.\nReleased under the MIT License."), (4, "He lost his driving licence after the accident last year."), (5, "no such thing")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS paragraph", "1 AS family", "1 AS prediction", "1 AS probability")).collect()
    assert sorted((r.doc_id, r.paragraph_no, r.family, r.confirmed) for r in got) == [(3, 1, "MIT", True), (3, 2, "MIT", True)]
    assert licences.scan(nothing).count() == 0


def test_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (50, [1.0, 0.0]), (51, [1.0, 0.0]), (52, [1.0, 0.0]), (53, [None, 1.0]), (54, [nan, 1.0]), (55, [inf, 1.0]), (56, [1.0]), (57, []), (100, [-1.0, 0.5]), (58, [0.004, 0.0])]
    data = search.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "1 AS dim"))
    got = search.top_k(data, data.filter("vec_id % 50 = 0"), rows=4)
    assert [(r.rank, r.vec_id, r.score) for r in got.filter("query_id = 50").orderBy("rank").collect()] == [(1, 51, 65536), (2, 52, 65536), (3, 58, 256), (4, 100, -65536)]
    assert search.top_k(data.filter("false"), data.filter("false")).count() == 0


def test_jaccard(table, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (56, 4), 5: (1, 5), 6: (61, 4), 7: (1, 7), 8: (1, 8)}
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8]
    assert jaccard.jaccard_components(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0
