"""SimHash near-duplicates by joining a binary trie of fingerprints with itself.

A fingerprint has 64 bits; bit i is 1 if more than half of the hashes of a text's 3-word shingles have
it set. Fingerprints link if at most ``budget`` bits differ; the result is the component of each
document.

The distinct fingerprints form a binary trie, which is joined with itself: pairs of nodes of one depth
are followed down together, each pair with the number of bits in which its two prefixes differ, and a
pair that differs in more bits than the budget allows is left. The first levels are walked by Spark: a
cell is a pair of nodes, a fingerprint of one side goes to the children of the pair that it can be in,
and cells without rows on either side end there. How deep depends on the number of fingerprints, and
cells that are still too large walk on by themselves, so dense parts of the trie are split further.
Below, a task walks a cell's two tries as ranges of sorted numbers, in blocks of bounded size, until
few pairs are left under a pair of nodes, which are compared outright.

Equal fingerprints are one row throughout, so a group of copies costs nothing. A fingerprint has at
most 2,080 others within two bits, so links grow with the rows; a task passes on a forest with the
same components.

Defined cases: null texts and texts without words have the fingerprint zero and link like others; fewer
than three words are one shingle; the rows of one id are one document, linked with what any of its texts
is linked with; a component without any id has no name; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.components import components
from callgauge.llm.registry import query, table
from callgauge.llm.stages import Stage

BITS = 64
WORDS = 3
SEED = 42
BUDGET = 2
#: Hashes of a text held at once.
SLICE = 1 << 15
#: Fingerprints of a side that a task walks.
CELL = 1 << 13
#: Bits that cells beyond that are split by in one round.
STRIDE = 4
#: Pairs of nodes a task holds at once, and pairs of fingerprints under a pair of nodes that are compared outright.
BLOCK = 1 << 17
OUTRIGHT = 16
#: Links a task holds before it makes a forest of them.
HELD_LINKS = 1 << 20


def shingle_bounds(data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``data`` in lower case, joined by one space, and where each shingle begins and ends in them."""
    upper = (data >= 65) & (data <= 90)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    after = np.append(False, word[:-1])
    # of the white space behind a word one character stays, as a space
    kept = word | after
    joined = np.where(word, data + 32 * upper, 32).astype(np.uint8)[kept]
    gaps = np.flatnonzero(joined == 32)
    ends = np.append(gaps, len(joined)) if len(joined) and joined[-1] != 32 else gaps
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    most = min(WORDS, len(ends))
    return joined.tobytes(), starts[: len(ends) - most + 1], ends[most - 1:] if most else ends


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text, as an unsigned number; its hashes are taken some ten thousand at a time."""
    joined, starts, ends = shingle_bounds(np.frombuffer((text or "").encode(), np.uint8))
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for low in range(0, len(starts), SLICE):
        at = zip(starts[low:low + SLICE].tolist(), ends[low:low + SLICE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in at], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with ``fp`` the fingerprint as a signed number, for every row of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (number, root of its component) that join what the links (a, b) join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for end in (x, y):
            np.minimum.at(root, before[end], low)
            np.minimum.at(root, end, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def walk(left: np.ndarray, right: np.ndarray, same: bool, depth: int, rest: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``left`` and ``right`` (sorted unsigned numbers, each below one node of ``depth``) that differ in ``budget`` bits at most.

    The nodes leave ``rest`` bits of the budget. ``same``: both sides are one node, and pairs come once. A
    node is a range of the sorted numbers; blocks of node pairs are taken from a stack, so that little is held.
    """
    # a row for a pair of nodes: left range, right range, bits left, whether both are one node
    stack = [(depth, np.array([[0, len(left), 0, len(right), rest, int(same)]], np.int64))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > BLOCK:
            stack += [(level, pairs[low:low + BLOCK]) for low in range(0, len(pairs), BLOCK)]
            continue
        few = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= OUTRIGHT) | (level == BITS)
        yield compare(left, right, pairs[few], budget)
        pairs = pairs[~few]
        if not len(pairs):
            continue
        l0, l1, r0, r1, rest_of, one = pairs.T
        lm, rm = (middle(side, low, high, level) for side, low, high in ((left, l0, l1), (right, r0, r1)))
        apart = np.zeros_like(one)
        children = [(l0, lm, r0, rm, rest_of, one), (lm, l1, rm, r1, rest_of, one), (l0, lm, rm, r1, rest_of - 1, apart)]
        below = [np.stack(c, axis=1) for c in children]
        # the two halves of one node meet once
        below.append(np.stack((lm, l1, r0, rm, rest_of - 1, apart), axis=1)[one == 0])
        below = np.concatenate(below)
        below = below[(below[:, 4] >= 0) & (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2])]
        if len(below):
            stack.append((level + 1, below))


def middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where in each range of ``values``, whose numbers share the first ``level`` bits, the next bit turns to 1."""
    shift = np.uint64(BITS - 1 - level)
    return np.clip(np.searchsorted(values, (values[low] >> shift | np.uint64(1)) << shift), low, high)


def compare(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under pairs of nodes that differ in ``budget`` bits at most."""
    wide, counts = pairs[:, 3] - pairs[:, 2], (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    of = np.repeat(np.arange(len(pairs)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    i, j = pairs[of, 0] + nth // wide[of], pairs[of, 2] + nth % wide[of]
    near = np.flatnonzero((np.bitwise_count(left[i] ^ right[j]) <= budget) & ((pairs[of, 5] == 0) | (i < j)))
    return left[i[near]], right[j[near]]


def masks(depth: int, budget: int) -> list[int]:
    """Numbers of ``depth`` bits with ``budget`` ones at most."""
    return [sum(1 << i for i in chosen) for k in range(budget + 1) for chosen in combinations(range(depth), k)]


def deeper(rows: DataFrame, depth: int, stride: int, budget: int) -> DataFrame:
    """Rows (fp, x) of node pairs of ``depth`` for every pair ``stride`` levels below; ``x`` is what the prefixes differ in."""
    choices = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("k")) for m in masks(stride, budget)])
    left = budget - F.bit_count("x")
    chosen = rows.select("fp", "x", F.explode(F.filter(choices, lambda c: c["k"] <= left)).alias("c"))
    return chosen.select("fp", F.shiftleft("x", stride).bitwiseOR(F.col("c.m")).alias("x"))


def with_cells(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (fp, x) with ``low``, the smaller prefix of their pair of nodes, and on which ``side`` they are."""
    own = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    other = own.bitwiseXOR(F.col("x"))
    return rows.select("fp", "x", F.least(own, other).alias("low"), (own > other).cast("int").alias("side"))


def join_cells(cells: DataFrame, depth: int, budget: int) -> DataFrame:
    """Links (a, b) within each cell of ``cells`` (fp, x, low, side), as a forest."""

    def links(x: int, sides: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        left, right = (np.sort(s.view(np.uint64)) for s in sides)
        if x and not (len(left) and len(right)):
            return
        pairs = walk(left, right if x else left, not x, depth, budget - x.bit_count(), budget)
        held, n = [], 0
        for a, b in pairs:
            held.append((a, b))
            n += len(a)
            if n > HELD_LINKS:
                held = [forest(*map(np.concatenate, zip(*held)))]
                n = len(held[0][0])
        if n:
            a, b = forest(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []

        def finish():
            if here is not None:
                fp, side = (np.concatenate(p) for p in zip(*parts))
                yield from links(here[0], (fp[side == 0], fp[side == 1]))

        for batch in batches:
            x, low, fp, side = (batch.column(c).to_numpy() for c in ("x", "low", "fp", "side"))
            if not len(x):
                continue
            borders = np.flatnonzero((x[1:] != x[:-1]) | (low[1:] != low[:-1])) + 1
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(x)]):
                cell = int(x[a]), int(low[a])
                if cell != here:
                    yield from finish()
                    here, parts = cell, []
                parts.append((fp[a:b], side[a:b]))
        yield from finish()

    return cells.repartition("x", "low").sortWithinPartitions("x", "low").mapInArrow(search, "a long, b long")


def trie_links(points: DataFrame, n: int, stage: Stage, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """Links (a, b) with the components of all pairs of the ``n`` distinct ``fp`` of ``points`` within ``budget`` bits."""
    depth = max(0, (2 * n // cell).bit_length())
    rows = deeper(points.select("fp", F.lit(0).cast("long").alias("x")), 0, depth, budget)
    found = None
    while True:
        cells = with_cells(rows, depth)
        sizes = cells.groupBy("x", "low").agg(F.sum(1 - F.col("side")).alias("left"), F.sum("side").alias("right"))
        large = stage.write(sizes.filter((F.greatest("left", "right") > cell) & ((F.col("x") == 0) | (F.least("left", "right") > 0))).select("x", "low"), "large-cells")
        again = depth < BITS and not large.isEmpty()
        links = join_cells(cells.join(large, ["x", "low"], "left_anti") if again else cells, depth, budget)
        found = links if found is None else found.unionByName(links)
        if not again:
            return found
        stride = min(STRIDE, BITS - depth)
        rows = stage.write(deeper(cells.join(large, ["x", "low"], "left_semi").select("fp", "x"), depth, stride, budget), "cells")
        depth += stride


def simhash_components(docs: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    stage = Stage(docs.sparkSession)
    rows = stage.write(fingerprints(docs), "fingerprints")
    points = stage.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = trie_links(points, points.count(), stage, budget, cell)
    # one id may have several texts, which then belong together
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    links = links.unionByName(rows.join(several, "doc_id").select(F.col("fp").alias("a"), F.col("low").alias("b")))
    found = components(links, stage).withColumnRenamed("node", "fp")
    whole = points.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = whole.join(names, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op13_simhash")
def op13_simhash(spark, sf_dir):
    """Fingerprint of every document and its component under links of two bits or fewer."""
    return simhash_components(table(spark, sf_dir, "documents"))
