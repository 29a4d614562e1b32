"""From raw documents to packed training sequences, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgauge.llm import jaccard, packing, quality, suffixes, toxicity
from callgauge.llm.registry import table
from callgauge.llm.stages import Stage
from callgauge.session import new_path, stage_tables

#: Bytes of a passage that is removed: 50 words of four letters with their blanks are 250, less some for the words cut at
#: its edges. An anchor is looked for among the first ``PASSAGE_SPAN`` places; the rest of the string is the prefix to sort by.
PASSAGE_BYTES = 240
PASSAGE_SPAN = 160


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules take for good."""
    return quality.filter_quality(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learnt from the labelled ones that are still there and not held out."""
    return toxicity.filter_toxicity(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of about 50 words or more that occur elsewhere too."""
    return suffixes.without_repeats(docs, length=PASSAGE_BYTES, span=PASSAGE_SPAN)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack_sequences),
]

#: A trained classifier, an exact join of shingle sets and a packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input."""
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with stage_tables(spark):
            done = stage.write(work(spark, docs, sf_dir), path=path)
        stage.drop(docs)
        docs = done
    return docs
