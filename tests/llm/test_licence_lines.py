"""Licence texts with hard line ends, statements without the usual stems, and paragraphs that state nothing."""

import textwrap

import numpy as np
from pyspark.sql import functions as F

from callgauge.llm import licences

MIT = licences.TEMPLATES["MIT"][4]
APACHE = licences.TEMPLATES["Apache"][3]


def test_wrapped_and_unusual_statements(spark):
    rows = [
        (1, "A title\n\n" + textwrap.fill(MIT, 70) + "\n\nAn end"), (2, textwrap.indent(textwrap.fill(APACHE, 60), "# ")),
        (3, "free software under the GNU GPL v2 or later"), (4, "Distributed under GPLv3"), (5, "CC-BY-SA 4.0"), (6, "The train was late.\nSo were we.\n\nIt rained on the software.")]
    got = {}
    for r in licences.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph_no, r.family, r.confirmed))
    print(got)
    assert (2, "MIT", True) in got[1] and (0, "Apache", True) in got[2]
    assert [x[1] for k in (3, 4, 5) for x in got[k]] == ["GPL", "GPL", "Creative Commons"] and 6 not in got


def test_words_left_out_cannot_pass(spark):
    vocabulary, model, threshold = licences.fit_licences(spark)
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    telling = licences.telling_words(vocabulary.vocabulary, weights, start, threshold)
    print(len(vocabulary.vocabulary), threshold, start.round(2), telling and (len(telling), telling[:60]))
    if telling is not None:
        rest = np.array([not set(g.split(" ")) & set(telling) for g in vocabulary.vocabulary])
        lead = np.maximum(weights[1:] - weights[0], 0)[:, rest].sum(1) + start[1:] - start[0]
        assert (lead < np.log(threshold / (1 - threshold))).all()


def test_only_known_grams_are_formed(spark):
    """No gram of the vocabulary is lost, and none with a word that it does not have is put together."""
    texts = [(1, "the gnu license of the train the gnu"), (2, "nothing here"), (3, ""), (4, "gnu"), (5, "the gnu license")]
    vocabulary = ["the", "gnu", "license", "of", "the gnu", "gnu license", "the gnu license", "license of the"]
    df = licences.worded(spark.createDataFrame(texts, "i int, paragraph string"))
    for r in df.select("i", licences.grams(F.col("__words"), (1, 2, 3)).alias("every"), licences.known_grams(F.col("__words"), vocabulary).alias("known")).collect():
        print(r.i, r.known)
        words = {w for g in r.known for w in g.split(" ")}
        assert words <= set(vocabulary) and set(r.known) <= set(r.every) and set(r.known) & set(vocabulary) == set(r.every) & set(vocabulary)


def test_words_of_a_run_are_those_of_its_lines(spark):
    text = "Copyright-\n2.0 of ΟΔΟΣ.\nIt's free+open\r\n\n--\nA single ΣΑΣ line\n"
    rows = licences.paragraphs(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"), ("doc_id",)).collect()
    joined = [(0, "Copyright- 2.0 of ΟΔΟΣ. It's free+open\r", True)] + [(i, t, False) for i, t in enumerate(text.split("\n")) if i in (0, 1, 2, 5)]
    asked = spark.createDataFrame(joined, "no int, paragraph string, whole boolean")
    assert {(r.paragraph_no, r["__whole"]): r["__words"] for r in rows} == {(r.no, r.whole): r["__words"] for r in licences.worded(asked).collect()}
    assert len(rows) == 5 and {r.doc_id for r in rows} == {1}
