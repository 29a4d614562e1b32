"""Repeated passages, exactly, by a logarithmic family of sparse suffix indexes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Of all suffixes
only those at anchors are indexed: the anchor of a string of ``LENGTH`` bytes is the place of the
smallest hash of 16 bytes among its first ``SPAN`` places, so equal strings have equal anchors at equal
places, and about one place in ``SPAN / 2`` is an anchor. An entry of the index is one anchor with the
run of string starts that share it. It carries two fingerprints: of the bytes behind the anchor that
all these strings have in common (the prefix by which suffixes are sorted), and of the whole stretch
its strings cover.

Entries come in batches. A new batch is sorted into an index of its own and merge-scanned against
the existing levels: entries with equal prefix meet, and either their whole stretches are equal
(then every string in them is repeated) or they differ somewhere (then their strings are compared
one by one later). Levels of equal size are merged into one of double size, so there are only
logarithmically many, and an entry is rewritten as often. Equal stretches are one entry with a count
in every level, so thousands of copies weigh as one.

What remains are the edges of repeats: for each prefix that occurs in different stretches, the
strings of one copy of each stretch are fingerprinted, 128 bits each, and those that occur twice are
repeated. A prefix with very many stretches is dealt to several tasks by fingerprint of the string.

Suffixes are sorted by the fingerprint of their prefix, not by its letters: all that the scan asks
is that equal prefixes stand together, and 8 bytes then do for hundreds. Prefix fingerprints (64
bits) only propose; strings and stretches are equal if their 128-bit fingerprints are.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` keep everything; rows with one id
and different texts are told apart by a fingerprint of the text; an equal row counts as another
place; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.bytescan import POWERS, mix, text_slices
from callgauge.llm.registry import query, table
from callgauge.llm.stages import Stage

LENGTH = 400
SPAN = 256
GRAM = 16
BATCHES = 4
_PLACE = np.uint64((1 << 24) - 1)


def anchored(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of every run of string starts with one anchor, over the texts of a slice."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none
    up, down = POWERS.upto(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        low = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # the place in the low bits: the smallest hash, and of equal ones the first
    low = (low & ~_PLACE) | (np.arange(len(low), dtype=np.uint64) & _PLACE)
    step, reached = 1, 1
    while reached < span:
        step = min(reached, span - reached)
        low = np.minimum(low[:-step], low[step:])
        reached += step
    starts = np.zeros(n + 1, np.int32)
    begins, ends = offsets[:-1], offsets[1:] - length + 1
    long = ends > begins
    np.add.at(starts, begins[long], 1)
    np.add.at(starts, ends[long], -1)
    valid = np.flatnonzero(np.cumsum(starts[:n]) > 0)
    if not len(valid):
        return none, none, none
    place = (low[valid] & _PLACE).astype(np.int64)
    anchor = valid + ((place - valid) & int(_PLACE))
    fresh = np.ones(len(valid), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(valid)) - 1
    return anchor[first], valid[first], valid[last]


# ---- the index -------------------------------------------------------------------------------------------------------

ENTRY = "fp bigint, stretch binary, doc_id bigint, mark bigint, first int, last int"


def place_of(text: F.Column) -> tuple[F.Column, F.Column]:
    """Id and mark of a text: the mark tells texts of one id apart, and texts without an id (which go by a hash) from those with one."""
    own = F.xxhash64(text)
    return F.coalesce("doc_id", own), F.when(F.col("doc_id").isNull(), F.xxhash64(text, F.lit("no id"))).otherwise(own)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): places as ``place_of`` gives them."""
    text = F.coalesce("text", F.lit(""))
    doc, mark = place_of(text)
    return docs.select(doc.alias("doc_id"), mark.alias("mark"), text.alias("text"))


def entries(texts: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """Index entries of all texts: prefix fingerprint, fingerprint of the stretch, and where its strings start."""
    common = length - span + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for row, data, offsets in text_slices(batch.column("text")):
                anchors, first, last = anchored(data, offsets, length, span)
                view = memoryview(np.ascontiguousarray(data))
                prefixes = np.array([xxhash.xxh3_64_intdigest(view[a:a + common]) for a in anchors.tolist()], np.uint64).view(np.int64)
                stretches = [xxhash.xxh3_128_digest(view[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
                of = np.searchsorted(offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefixes), pa.array(stretches, pa.binary()), pa.array(ids[row + of]), pa.array(marks[row + of]),
                     pa.array((first - offsets[of]).astype(np.int32)), pa.array((last - offsets[of]).astype(np.int32))],
                    ["fp", "stretch", "doc_id", "mark", "first", "last"])

    return texts.mapInArrow(index, ENTRY)


class SuffixFamily:
    """Levels of sorted entries; a level of rank k holds 2**k batches."""

    def __init__(self, stage: Stage):
        self.stage = stage
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []

    @staticmethod
    def folded(rows: DataFrame) -> DataFrame:
        """One row per prefix and stretch, with how often it occurs and one of its places."""
        return rows.groupBy("fp", "stretch").agg(F.sum("n").alias("n"), F.min("place").alias("place"))

    def scan(self, rows: DataFrame) -> None:
        """Note the stretches of ``rows`` that occur twice, and the prefixes that occur in different stretches."""
        met = self.folded(rows)
        twice = met.filter("n > 1").select(F.lit(None).cast("bigint").alias("fp"), "stretch")
        parted = met.groupBy("fp").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).filter("a < b")
        self.matches.append(self.stage.write(twice.unionByName(parted.select("fp", F.lit(None).cast("binary").alias("stretch"))), "matches"))

    def add(self, found: DataFrame) -> None:
        """Index a batch of entries, scan it against itself and every level, then merge levels of equal rank."""
        place = F.struct("doc_id", "mark", "first", "last").alias("place")
        batch = self.stage.write(self.folded(found.select("fp", "stretch", F.lit(1).cast("bigint").alias("n"), place)).sortWithinPartitions("fp"), "level")
        self.scan(batch)
        for _, level in self.levels:
            self.scan(batch.unionByName(level))
        self.levels.append((0, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self.stage.write(self.folded(a.unionByName(b)).sortWithinPartitions("fp"), "level")))
            self.stage.drop(a, b)

    def everything(self) -> DataFrame:
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        return self.folded(rows) if len(self.levels) > 1 else rows

    def repeated(self) -> tuple[DataFrame, DataFrame]:
        """(stretch) of stretches that occur twice, (fp) of prefixes in different stretches."""
        rows = self.matches[0]
        for m in self.matches[1:]:
            rows = rows.unionByName(m)
        return rows.filter("stretch IS NOT NULL").select("stretch").distinct(), rows.filter("fp IS NOT NULL").select("fp").distinct()


# ---- edges of repeats ------------------------------------------------------------------------------------------------

#: Different stretches of one prefix that a task compares whole; of more, each task compares a share of the strings.
GROUP_STRETCHES = 1000


def runs(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings at ascending starts."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + length)
        else:
            out.append((s, s + length))
    return out


def stretch_bytes(texts: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """(fp, classes, doc_id, mark, first, bytes) of the given stretches (fp, classes, doc_id, mark, first, last), cut from the texts."""
    wanted = copies.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("fp", "classes", "first", "last")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, mark, text, cuts in zip(*(batch.column(c) for c in ("doc_id", "mark", "text", "cuts"))):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for c in cuts.as_py():
                    for column, value in zip(out, (c["fp"], c["classes"], doc.as_py(), mark.as_py(), c["first"], data[c["first"]:c["last"] + length])):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["fp", "classes", "doc_id", "mark", "first", "bytes"])

    return texts.join(wanted, ["doc_id", "mark"]).mapInArrow(cut, "fp bigint, classes int, doc_id bigint, mark bigint, first int, bytes binary")


SPANS = "doc_id bigint, mark bigint, a int, b int"
#: Fingerprint and start of a string, as they travel.
STRING = np.dtype([("digest", "V16"), ("start", "<i4")])


def strings_of(first: int, data: bytes, length: int) -> np.ndarray:
    """Fingerprint and start of every string of a stretch."""
    view, n = memoryview(data), len(data) - length + 1
    found = np.zeros(n, STRING)
    found["digest"] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s:s + length]) for s in range(n)]), "V16")
    found["start"] = np.arange(first, first + n)
    return found


def halves(strings: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(strings["digest"]).view(np.uint64).reshape(-1, 2)


def shared_ranges(rows: list[tuple[int, int, np.ndarray]], length: int) -> list[tuple[int, int, int, int]]:
    """(document, mark, from, to) of the bytes under strings that two of the rows (document, mark, strings) hold."""
    flat = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    two = halves(flat)
    order = np.lexsort((two[:, 1], two[:, 0]))
    same = (two[order[1:]] == two[order[:-1]]).all(1)
    hit = np.zeros(len(flat), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(owner[at])) + 1) if len(at) else []:
        out += [(*rows[owner[part[0]]][:2], a, b) for a, b in runs(np.sort(flat["start"][part]).tolist(), length)]
    return out


def in_runs(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], read, length: int) -> DataFrame:
    """Shared ranges among the rows of equal keys, which come one after the other in sorted partitions."""

    def ranges(run: list) -> list:
        return shared_ranges([read(r) for r in run], length) if len(run) > 1 else []

    def batch_of(found: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], ["doc_id", "mark", "a", "b"])

    def search(batches):
        here, run = None, []
        for batch in batches:
            found: list = []
            for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in columns))):
                if key != here:
                    found += ranges(run)
                    here, run = key, []
                run.append(row)
            yield batch_of(found)
        yield batch_of(ranges(run))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, SPANS)


def compare_groups(stretches: DataFrame, length: int) -> DataFrame:
    """Ranges that stretches of one prefix share; whole stretches travel."""
    return in_runs(stretches, ("fp",), ("doc_id", "mark", "first", "bytes"), lambda r: (r[0], r[1], strings_of(r[2], r[3], length)), length)


def compare_classes(stretches: DataFrame, length: int) -> DataFrame:
    """The same for prefixes with very many stretches: their strings are compared in ``classes`` parts, by fingerprint.

    A stretch sends a row to each class it has strings in, so a task's share of a prefix stays bounded.
    """

    def strings(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for fp, classes, doc, mark, first, data in zip(*(batch.column(c).to_pylist() for c in ("fp", "classes", "doc_id", "mark", "first", "bytes"))):
                found = strings_of(first, data, length)
                of = halves(found)[:, 0] % np.uint64(classes)
                for c in np.unique(of).tolist():
                    for column, value in zip(out, (fp, c, doc, mark, found[of == c].tobytes())):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["fp", "class", "doc_id", "mark", "strings"])

    sent = stretches.mapInArrow(strings, "fp bigint, class bigint, doc_id bigint, mark bigint, strings binary")
    return in_runs(sent, ("fp", "class"), ("doc_id", "mark", "strings"), lambda r: (r[0], r[1], np.frombuffer(r[2], STRING)), length)


def repeated_spans(docs: DataFrame, stage: Stage, length: int = LENGTH, span: int = SPAN, batches: int = BATCHES) -> DataFrame:
    """(doc_id, mark, spans) of every text with a repeated string; spans are byte ranges, in no order, and may overlap."""
    texts = texts_of(docs)
    family = SuffixFamily(stage)
    for k in range(batches):
        family.add(entries(texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(batches)) == k), length, span))
    twice, parted = (stage.write(t, name) for t, name in zip(family.repeated(), ("repeated-stretches", "parted-prefixes")))
    whole = entries(texts, length, span).join(twice, "stretch", "left_semi").select("doc_id", "mark", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    whole = stage.write(whole, "whole-spans")
    copies = family.everything().join(parted, "fp", "left_semi").select("fp", "stretch", "place.*")
    sizes = copies.groupBy("fp").agg(F.ceil(F.count("*") / GROUP_STRETCHES).cast("int").alias("classes"))
    copies = stage.write(copies.join(sizes, "fp"), "copies")
    cuts = stage.write(stretch_bytes(texts, copies, length), "stretches")
    edges = compare_groups(cuts.filter("classes = 1"), length)
    if copies.filter("classes > 1").limit(1).count():
        edges = edges.unionByName(compare_classes(cuts.filter("classes > 1"), length))
    edges = stage.write(edges, "edge-spans")
    stage.drop(cuts, copies, *family.matches, *[level for _, level in family.levels])
    return whole.unionByName(edges).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def cut_spans(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    merged: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]]), sum(b - a for a, b in merged), len(merged)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, keep..., n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    ``kept`` is the text left; of a character cut in two nothing stays in it, while ``kept_sha256`` is of all bytes left.
    """
    stage = Stage(docs.sparkSession)
    spans = repeated_spans(docs.select("doc_id", "text"), stage, **options)
    text = F.coalesce("text", F.lit(""))
    doc, mark = place_of(text)
    marked = docs.select("doc_id", *keep, doc.alias("__doc"), mark.alias("__mark"), text.alias("__text"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), F.col("spans").alias("__spans"))
    joined = marked.join(spans, (F.col("__doc") == F.col("__id")) & (F.col("__mark") == F.col("__m")), "left").select("doc_id", *keep, "__text", "__spans")

    def cut(batches):
        for batch in batches:
            rows = [cut_spans(t.encode("utf-8", "surrogatepass"), s) for t, s in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist())]
            kept = [r[0] for r in rows]
            columns = [batch.column(c) for c in ("doc_id", *keep)]
            columns += [pa.array([len(k) + r[1] for k, r in zip(kept, rows)], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *keep).schema)
    return joined.mapInArrow(cut, f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``, and ``n_chars`` (if there) counted anew."""
    out = remove_repeats(docs.select("doc_id", "text", F.struct("*").alias("__row")), ("__row",), **options)
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    """What is left of every document without the bytes of 400-byte strings that occur twice."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
