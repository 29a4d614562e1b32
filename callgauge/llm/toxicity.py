"""Toxicity: a linear classifier over character n-grams, features scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased text, hashed into a fixed number of
buckets. Each bucket's value is its log-count ratio: how much more often texts labelled 1 hold it
than texts labelled 0. A logistic regression over these scaled features gives the score.

Long texts hold many n-grams, and so much chance evidence. A text is therefore scored by passages of
at most ``PASSAGE`` characters, and a text is as toxic as its most toxic passage. Nothing of a text
is left out.

Learning takes a sample of labelled rows whose number is bounded by ``FIT_ROWS`` (the smallest by
hash of the id); counts and gradients are formed over that sample. Scoring is one pass over the
documents without a shuffle; the weights, one number per bucket, travel with the tasks.

Defined cases: null and empty texts get the score of a text without n-grams, the prior; repeated ids
are separate rows; with no labelled rows of one class every score is the share of toxic labels, or
0 without labels; an empty table gives an empty result. Labels with null are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.llm.registry import query, table
from callgauge.session import materialize

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
PASSAGE = 2048
FIT_ROWS = 8_000
#: Counts of a bucket must differ by so many standard errors between the classes.
TELLING = 2.5
STEPS = 200
RIDGE = 1.0
PART_ROWS = 500
#: Toxic labels are few; each counts this many times in the loss, so that 0.5 is where missing one costs as much.
TOXIC_WEIGHT = 4.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def passages(text: str | None, longest: int = PASSAGE) -> list[str]:
    """The text cut into pieces of at most ``longest`` characters that overlap by a quarter."""
    text = text or ""
    if len(text) <= longest:
        return [text]
    step = longest * 3 // 4
    return [text[i:i + longest] for i in range(0, len(text) - longest + step, step)]


def ngram_buckets(text: str, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Distinct buckets of the character n-grams of a text, runs of white space counted as one space."""
    flat = " ".join(text.lower().split())
    if not flat:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {flat} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bits = np.uint64(64 - int(buckets).bit_length() + 1)
    found, rolled = [], np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(sizes)):
            if k >= len(points):
                break
            rolled = (rolled[: len(points) - k] + points[k:]) * _MIX
            rolled ^= rolled >> np.uint64(29)
            if k + 1 in sizes:
                found.append((rolled * _MIX) >> bits)
    if not found:
        return np.zeros(0, np.int64)
    seen = np.zeros(buckets, bool)
    for f in found:
        seen[f.astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class Weights:
    """Weight of each bucket, its log-count ratio already multiplied in, and the intercept."""

    buckets: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        margins = [self.intercept + float(self.buckets[b].sum()) if len(b) else self.intercept
                   for b in (ngram_buckets(p, len(self.buckets)) for p in passages(text))]
        return float(1 / (1 + np.exp(-np.clip(max(margins), -40, 40))))


def log_ratios(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket; 0 where the two counts do not differ beyond chance."""
    negative = total - positive
    ratio = np.log((positive + 1) / (positive.sum() + len(total))) - np.log((negative + 1) / (negative.sum() + len(total)))
    spread = np.sqrt(1 / (positive + 1) + 1 / (negative + 1))
    ratio[(np.abs(ratio) < TELLING * spread) | (total < 3)] = 0
    return ratio


def constant(share: float, buckets: int) -> Weights:
    return Weights(np.zeros(buckets, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, steps: int = STEPS, ridge: float = RIDGE,
             toxic_weight: float = TOXIC_WEIGHT) -> Weights:
    """Ridge-penalised logistic regression over the scaled features, by accelerated gradient steps.

    ``rows`` holds the buckets of each text whose ratio is not 0.
    """
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0, len(ratio))
    used = np.flatnonzero(np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=len(ratio)))
    places = np.zeros(len(ratio), np.int32)
    places[used] = np.arange(len(used))
    scale = ratio[used]
    # a few hundred rows at a time, so that only whole numbers are held for all of them
    parts = []
    for low in range(0, len(rows), PART_ROWS):
        part = rows[low:low + PART_ROWS]
        parts.append((slice(low, low + len(part)), places[np.concatenate(part)], np.repeat(np.arange(len(part), dtype=np.int32), [len(r) for r in part])))
    cost = np.where(y > 0, toxic_weight, 1.0)
    n, share = len(y), float(np.average(y, weights=cost))

    def margins(v: np.ndarray) -> np.ndarray:
        scaled, out = v * scale, np.empty(n)
        for span, flat, owner in parts:
            out[span] = np.bincount(owner, scaled[flat], span.stop - span.start)
        return out

    def back(e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for span, flat, owner in parts:
            out += np.bincount(flat, e[span][owner], len(used))
        return out * scale

    w, intercept, momentum = np.zeros(len(used)), float(np.log(share / (1 - share))), 1.0
    look, look0 = w, intercept
    # the largest eigenvalue of the features' second moment bounds the step
    v, top = np.random.default_rng(0).normal(size=len(used)), 0.0
    for _ in range(12):
        v = back(margins(v))
        top = float(np.linalg.norm(v))
        v = v / (top or 1)
    rate = 1 / (toxic_weight * (top / n + 1) / 4 + ridge / n)
    for _ in range(steps):
        error = cost * (1 / (1 + np.exp(-np.clip(margins(look) + look0, -40, 40))) - y)
        gradient = back(error) / n + ridge / n * look
        w_next, intercept_next = look - rate * gradient, look0 - rate * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / following
        look, look0 = w_next + pull * (w_next - w), intercept_next + pull * (intercept_next - intercept)
        w, intercept, momentum = w_next, intercept_next, following
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = w * scale
    return Weights(weights, intercept)


def learn(texts: list[str | None], labels: np.ndarray, buckets: int = BUCKETS, **options) -> Weights:
    """The same fit over texts at hand, for small tables."""
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0, buckets)
    positive, total = np.zeros(buckets), np.zeros(buckets)
    for text, label in zip(texts, y):
        b = ngram_buckets(text or "", buckets)
        positive[b] += label
        total[b] += 1
    ratio = log_ratios(positive, total)
    rows = [b[ratio[b] != 0].astype(np.int32) for b in (ngram_buckets(t or "", buckets) for t in texts)]
    return fit_rows(rows, y, ratio, **options)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Weights:
    """Learn from at most ``rows`` labelled documents; ``labels`` holds ``doc_id`` and ``toxic``.

    Tasks count and pick features; the driver gets a number per bucket and the telling buckets of
    each chosen row. A repeated id is learnt once, by its largest text, so that the bound holds for documents too. Texts are learnt whole: nobody says which passage of a toxic text is the toxic one.
    """
    chosen = labels.filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("double").alias("__label"))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(rows)
    # at most ``rows`` pairs of numbers: small enough to broadcast whatever the corpus
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = labelled.groupBy("doc_id", "__label").agg(F.max("text").alias("text"))
    sample = materialize(one.repartition(24, "doc_id"), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        positive, total = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            for text, label in zip(batch["text"], batch["__label"]):
                b = ngram_buckets(text or "", buckets)
                positive[b] += label
                total[b] += 1
        b = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": b, "positive": positive[b], "total": total[b]})

    counted = sample.mapInPandas(count, "bucket int, positive double, total double")
    sums = counted.groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total")).toArrow().to_pandas()
    positive, total = np.zeros(buckets), np.zeros(buckets)
    positive[sums["bucket"]], total[sums["bucket"]] = sums["positive"], sums["total"]
    ratio = log_ratios(positive, total)
    telling = ratio != 0

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ngram_buckets(t or "", buckets) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["__label"], "b": [f[telling[f]].astype(np.int32).tobytes() for f in found]})

    picked = sample.mapInPandas(pick, "doc_id bigint, label double, b binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return fit_rows([np.frombuffer(b.as_buffer(), np.int32) for b in picked.column("b")], picked.column("label").to_numpy(), ratio)


def score_toxicity(docs: DataFrame, weights: Weights, keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``score`` from 0 to 1 for every row, beside the columns in ``keep``."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(score, T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [weights.score(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64())], schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(add, schema)


def filter_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns as they are."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), tuple(docs.columns), "__score")
    return scored.filter(F.col("__score") < threshold).drop("__score")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Score of every document, learnt from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic")
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
