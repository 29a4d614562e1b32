"""SimHash fingerprints and the trie join against brute force."""

import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from callgauge.llm import simhash

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"
TEXTS = [None, "", " \n", "a", "A b", "a  B\tc\n d", "É x Ü y é", "  lead word here tail  ", "a b c d e f g " * 50, "x\x0by\x0cz q r s", "x" * 5000, "tail space \x1f is a word ", "ß漢🙂 " * 70]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(rows, points):
    """Smallest id reachable from each row: all pairs are compared; rows of one id are one document."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        near[i] = np.bitwise_count(points[i] ^ points) <= 2
        near[i] |= np.array([r[0] is not None and r[0] == rows[i][0] for r in rows])
    names, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            fresh = set(np.flatnonzero(near[todo.pop()]).tolist()) - group
            group |= fresh
            todo += fresh
        seen |= group
        name = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            names[j] = name
    return names


def near_numbers(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64) for _ in range(2)]
    return np.unique(np.concatenate([base, base[: n // 2] ^ flips[0] ^ flips[1], base[:9] ^ np.uint64(7), np.arange(40, dtype=np.uint64)]))


@pytest.mark.parametrize("slice_", [simhash.SLICE, 3])
def test_fingerprint(monkeypatch, slice_):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("block, outright", [(simhash.BLOCK, simhash.OUTRIGHT), (50, 1), (7, 5)])
def test_walk_finds_each_pair_once(monkeypatch, block, outright):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "OUTRIGHT", outright)
    points = near_numbers(1, 800)
    got = [tuple(sorted(p)) for a, b in simhash.walk(points, points, True, 0, 2) for p in zip(a.tolist(), b.tolist())]
    want = {(int(x), int(y)) for i, x in enumerate(points) for y in points[i + 1:][np.bitwise_count(x ^ points[i + 1:]) <= 2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_walk_of_two_nodes():
    points = near_numbers(2, 500)
    left, right = points[points < 2**63], points[points >= 2**63]
    got = {(x, y) for a, b in simhash.walk(left, right, False, 1, 1) for x, y in zip(a.tolist(), b.tolist())}
    assert got == {(int(x), int(y)) for x in left for y in right[np.bitwise_count(x ^ right) <= 2]}


@pytest.mark.parametrize("cell", [5, simhash.CELL])
def test_links_at_every_depth(spark, cell):
    # dense below one prefix, so small cells have to walk on for several rounds
    points = np.unique(np.concatenate([near_numbers(3, 60), np.arange(0, 400, 3, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in points.view(np.int64)], "fp bigint")
    found = simhash.trie_links(df, len(points), simhash.Stage(spark), cell=cell)
    got = np.array([(r.a, r.b) for r in found.collect()], np.int64).reshape(-1, 2).view(np.uint64)
    assert (np.bitwise_count(got[:, 0] ^ got[:, 1]) > 0).all()
    want = [(x, y) for i, x in enumerate(points) for y in points[i + 1:][np.bitwise_count(x ^ points[i + 1:]) <= 2]]
    roots = []
    for links in (got, np.array(want, np.uint64)):
        child, root = simhash.forest(links[:, 0], links[:, 1])
        roots.append(dict(zip(child.tolist(), root.tolist())))
    assert roots[0] == roots[1]


def test_components(spark):
    common = " ".join(f"w{i}" for i in range(400))
    rows = list(enumerate(TEXTS)) + [(50, common), (51, common + " end"), (None, common), (20, common), (60, "other text of its own"), (60, "and one more text"), (None, "no id at all here"), (7, "and one more text")]
    df = spark.createDataFrame(rows, DOC).select("*", F.lit(1).alias("fp"), F.lit(2).alias("a"), F.lit("c").alias("component"), F.lit("f").alias("fingerprint"))
    points = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    want = sorted(((i, f"{int(p):016x}", c) for (i, _), p, c in zip(rows, points, plain_components(rows, points))), key=repr)
    got = simhash.simhash_components(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert simhash.simhash_components(df.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    points = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    want = {i: (f"{int(p):016x}", c) for (i, _), p, c in zip(rows, points, plain_components(rows, points))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op13_simhash(spark, SF).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
