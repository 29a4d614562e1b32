"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document longer than a sequence is cut into full sequences and a rest; each id lies in exactly one
piece. Pieces are dealt to groups by a hash of their place in the written table, so that every group is a fair sample of all lengths, and
each group is packed by itself: pieces in falling length go to the
first open sequence with room. A tournament tree whose leaves are the room left in each sequence
finds that one in logarithmic time. The number of groups follows from the number of pieces.

Ids are formed once, in the pass that cuts; only lengths and checksums move afterwards.

Defined cases: null and empty texts are documents of no ids and the closing id; repeated ids are
separate rows, each piece of which is placed once; an empty table gives an empty result. Ties of length fall by checksum, id and start.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.registry import query, table
from callgauge.session import materialize

CAPACITY = 2048
GROUP_PIECES = 20_000
CLOSING_ID = 1
_LONGEST_KEPT = 48
_KEPT = 400_000
#: The pattern by which the vocabulary splits words, and the printable stand-ins of bytes in it.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Parts in which lower-casing and letters are beyond doubt, so that they need no normaliser.
_LATIN = re.compile("[!-~\u00a1-\u024f]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


class Known(dict):
    """A table that works out what it lacks; it starts anew when full, and does not keep long keys."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= _LONGEST_KEPT:
            if len(self) >= _KEPT:
                self.clear()
            self[key] = found
        return found


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins text across white space.

    Parts between blanks and line ends are looked up in a bounded table of known parts. An unknown
    part of Latin script is lower-cased and split into words by the vocabulary's own pattern, and its
    words go to the merge model (or the table); any other part goes through the whole tokenizer. The
    tests compare with encoding texts whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these are encoded whole: the vocabulary gives them ids of their own, whatever is around them.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.parts = Known(self.part)
        self.words = Known(self.word)

    def word(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(_BYTE_CHARS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def part(self, part: str) -> bytes:
        if not part:
            return b""
        if _LATIN.fullmatch(part):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(part.lower())))
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        parts = text.replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), np.uint32)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
])


def cut_pieces(docs: DataFrame, path: Callable[[], str] = tokenizer_path, capacity: int = CAPACITY, closing: int = CLOSING_ID,
               keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: full sequences from its start and the rest; ids themselves if asked."""
    schema = T.StructType([docs.schema["doc_id"], *PIECES, *([T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else [])])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_tokenizer(path())
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["__text"]):
                ids = np.append(encoder.encode(text), np.uint32(closing)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    rows.append((*row, piece.astype(np.int64)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).mapInPandas(cut, schema)


def first_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order, each into the first bin with room.

    ``tree`` is a tournament over bins: a node holds the largest room below it, so walking down to
    the left wherever the left child has room finds the first bin.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            room = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == room:
                break
            tree[node] = room
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``start``, ``length``, ``ids_crc32``.

    Sequence ids are unique over all groups: group in the high half, sequence in the low one. ``pieces`` is a written
    table: rows are dealt by their place in it, so that equal rows, however many, spread over all groups too.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[schema.names]

    return dealt.groupBy("__group").applyInPandas(fill, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """Ids of each document put together again from packed pieces that carry ``ids``."""
    parts = packed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("__parts"))
    return parts.select("doc_id", F.flatten("__parts.ids").alias("ids"))


def pack_documents(docs: DataFrame, path: Callable[[], str] = tokenizer_path, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Cut, hold the narrow table of pieces, and pack it."""
    return pack(materialize(cut_pieces(docs, path, capacity), "pieces"), capacity, group_pieces)


@query("op5_packing")
def op5_packing(spark, sf_dir):
    """Place of every piece of every document in sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
