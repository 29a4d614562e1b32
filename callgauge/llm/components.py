"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.stages import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (a, b).

    Each round hangs larger neighbours on the smallest one (large star), then a node's smaller
    neighbours on the smallest of them (small star). Tables of links only shrink, a node's minimum is
    found by an aggregate, and rounds are written, so lost executors cost one round at most. The
    number of rounds grows with the logarithm of the longest path.
    """
    edges = stage.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = (state["n"], state["h"])
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage.write(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        fresh = stage.write(small, "small-star")
        stage.drop(edges, large)
        edges = fresh
