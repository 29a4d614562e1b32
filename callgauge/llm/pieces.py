"""Encoding and decoding with a vocabulary of scored pieces: streaming Viterbi.

A text becomes the sequence of pieces with the highest sum of scores; of equal sums the one whose last
piece is longest. Characters that no piece covers become byte pieces, at a price below every piece.

Best scores are kept only for a window as wide as the longest piece. Back pointers are kept from the
last place that every surviving path has in common: whenever the paths that end anywhere in the
window meet in one boundary, what lies before it can no longer change, and its ids are given out.
In this vocabulary no piece continues over the start of a word, so paths always meet there; the parts
between are cached, as most words come again. A long part without such a place is streamed too.

Decoding joins the pieces, bytes included, and takes off the blank that encoding puts in front.
Encoding then decoding gives back every text exactly.

Defined cases: null and empty texts have no ids; a text may hold any characters, also the piece for
a blank itself (which reads as a blank in this vocabulary: ``exact`` compares with the normalised text);
ids outside the vocabulary are an error; repeated rows are rows of their own; an empty table gives
an empty result. Pieces that are control symbols are never matched in a text and decode to nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.registry import query, table

BLANK = "▁"
#: What a character without a piece costs below the cheapest piece.
UNKNOWN_PENALTY = 10.0
_KEPT = 600_000
_LONGEST_KEPT = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


class Pieces:
    """A vocabulary: matching pieces with scores, byte pieces, and the text of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.match = {names[i]: (i, model.get_score(i)) for i in range(size) if not special[i]}
        self.text = {i: names[i].replace(BLANK, " ").encode() for i, _ in self.match.values()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.text |= {i: b"" for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.longest = max(map(len, self.match))
        # a tree of letters: {letter: [following letters, id or -1, score]}
        self.tree: dict = {}
        for piece, (i, score) in self.match.items():
            level = self.tree
            for letter in piece[:-1]:
                level = level.setdefault(letter, [{}, -1, 0.0])[0]
            node = level.setdefault(piece[-1], [{}, -1, 0.0])
            node[1:] = i, score
        self.unknown_score = min(s for _, s in self.match.values()) - UNKNOWN_PENALTY
        # places no piece crosses: before a blank that follows something else
        self.parts = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.match) else None
        self.known: dict[str, bytes] = {}

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a normalised text, given out as soon as they are certain."""
        n, width = len(text), self.longest
        best: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}
        done = 0

        def given(end: int) -> list[int]:
            out = []
            while end > done:
                start, piece = back[end]
                if piece >= 0:
                    out.append(piece)
                else:
                    out += [self.bytes[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass"))]
                end = start
            return out[::-1]

        for i in range(n):
            here = best.pop(i)
            single, level, end = False, self.tree, i
            while end < n:
                node = level.get(text[end])
                if node is None:
                    break
                level, piece, score = node
                end += 1
                if piece >= 0:
                    single |= end == i + 1
                    score += here
                    if end not in best or score > best[end]:
                        best[end], back[end] = score, (i, piece)
            if not single and (i + 1 not in best or here + self.unknown_score > best[i + 1]):
                best[i + 1], back[i + 1] = here + self.unknown_score, (i, -1)
            if i % width == width - 1 and i + 1 - done >= 2 * width:
                ends = set(best)
                while len(ends) > 1:
                    last = max(ends)
                    ends.remove(last)
                    ends.add(back[last][0])
                meet = ends.pop()
                if meet > done:
                    yield given(meet)
                    for k in range(done + 1, meet + 1):
                        back.pop(k, None)
                    done = meet
                    # scores start anew at the common place, so that they never grow with the text
                    low = max(best.values())
                    best = {k: v - low for k, v in best.items()}
        if n > done:
            yield given(n)

    def short(self, text: str) -> list[int]:
        """Ids of a text no longer than the window, where nothing is given out before the end."""
        n = len(text)
        best, back, tree = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1), self.tree
        best[0] = 0.0
        for i in range(n):
            here, single, level, end = best[i], False, tree, i
            while end < n:
                node = level.get(text[end])
                if node is None:
                    break
                level, piece, score = node
                end += 1
                if piece >= 0:
                    single |= end == i + 1
                    if here + score > best[end]:
                        best[end], back[end] = here + score, (i, piece)
            if not single and here + self.unknown_score > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown_score, (i, -1)
        out = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in reversed(text[start:n].encode("utf-8", "surrogatepass"))]
            n = start
        return out[::-1]

    def encode_part(self, part: str) -> bytes:
        ids = self.short(part) if len(part) <= 2 * self.longest else [i for ids in self.stream(part) for i in ids]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        flat = self.normalize(text) if text else ""
        if self.parts is None:
            return np.frombuffer(self.encode_part(flat), "<u4")
        if len(self.known) > _KEPT:
            self.known = {}
        out = []
        for part in self.parts.findall(flat):
            ids = self.known.get(part)
            if ids is None:
                ids = self.encode_part(part)
                if len(part) <= _LONGEST_KEPT:
                    self.known[part] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """Text of ids."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_VOCABULARIES: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One vocabulary per worker process and file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Pieces(path)
    return _VOCABULARIES[path]


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: Callable[[], str] = model_path) -> DataFrame:
    """(keep..., ids) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path())
        for batch in batches:
            ids = [pieces.encode(t).astype(np.int32) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(work, f"{_schema(df, keep)}, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: Callable[[], str] = model_path) -> DataFrame:
    """(keep..., text) of every row; null ids give null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path())
        for batch in batches:
            texts = [None if i is None else pieces.decode(i) for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(work, f"{_schema(df, keep)}, text string")


def _schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)


def digests(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: Callable[[], str] = model_path) -> DataFrame:
    """(keep..., n_ids, ids_crc32, n_chars, exact): every text encoded and decoded again in one pass.

    ``ids_crc32`` is of the ids as little-endian 32-bit numbers, ``n_chars`` of the decoded text, ``exact``
    tells whether it is the text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path())
        for batch in batches:
            rows = []
            for t in batch.column("__text").to_pylist():
                ids = pieces.encode(t)
                again = pieces.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(ids.tobytes()), len(again), again == (t or "").replace(BLANK, " ")))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, "n_ids", "ids_crc32", "n_chars", "exact"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(work, f"{_schema(df, keep)}, n_ids bigint, ids_crc32 bigint, n_chars bigint, exact boolean")


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """Ids of every document, and whether they give the document back."""
    return digests(table(spark, sf_dir, "documents"))
