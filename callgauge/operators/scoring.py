"""Model scores and embeddings of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callgauge.functions.numeric import softmax

# texts -> (logits n x 3 in the order negative, neutral, positive; embeddings n x dim)
ModelFn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def score_batches(df: DataFrame, text: str, make_model: Callable[[], ModelFn], dim: int, batch: int = 32) -> DataFrame:
    """Adds ``probs`` (negative, neutral, positive), ``embedding`` and ``score_failed``.

    ``make_model`` runs once per Python worker; only the text column is read there, the others pass
    through as Arrow columns. A batch the model fails on gets even shares, a zero vector and the
    mark ``score_failed``; the rest goes on.
    """
    schema = T.StructType([
        *df.schema.fields,
        T.StructField("probs", T.ArrayType(T.DoubleType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("score_failed", T.BooleanType()),
    ])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for frame in frames:
            texts = [" " if t is None else t for t in frame.column(frame.schema.get_field_index(text)).to_pylist()]
            probs, vectors, failed = [], [], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                bad = False
                try:
                    logits, emb = model(part)
                    e = np.exp(logits - logits.max(axis=1, keepdims=True))
                    p = e / e.sum(axis=1, keepdims=True)
                    v = np.asarray(emb, dtype=np.float32)
                    if p.shape != (len(part), 3) or v.shape != (len(part), dim):
                        raise ValueError("model returned an unexpected shape")
                except Exception:
                    p, v, bad = np.full((len(part), 3), 1 / 3), np.zeros((len(part), dim), dtype=np.float32), True
                probs.extend(p.tolist())
                vectors.extend(v.tolist())
                failed.extend([bad] * len(part))
            fresh = [pa.array(probs, pa.list_(pa.float64())), pa.array(vectors, pa.list_(pa.float32())), pa.array(failed, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*frame.columns, *fresh], schema.names)

    return df.mapInArrow(run, schema)


def lexicon_model(positive: Sequence[str], negative: Sequence[str], dim: int = 16) -> Callable[[], ModelFn]:
    """A small default model: word counts as logits, hashed word shares as the vector."""

    def make() -> ModelFn:
        from zlib import crc32

        pos, neg = set(positive), set(negative)

        buckets: dict[str, int] = {}

        def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            toks = [t.lower().split() for t in texts]
            sizes = np.array([len(t) for t in toks])
            owner = np.repeat(np.arange(len(texts)), sizes)
            flat = [w for t in toks for w in t]
            if len(buckets) > 100_000:
                buckets.clear()
            buckets.update((w, crc32(w.encode()) % dim) for w in set(flat) if w not in buckets)
            n = np.maximum(1, sizes)
            counts = np.bincount(owner * dim + np.array([buckets[w] for w in flat], np.int64), minlength=len(texts) * dim)
            share = [np.bincount(owner, [w in words for w in flat], len(texts)) / n for words in (neg, pos)]
            logits = np.stack([10.0 * share[0], np.ones(len(texts)), 10.0 * share[1]], axis=1)
            return logits, counts.reshape(len(texts), dim) / n[:, None]

        return score

    return make


def softmax_scores(df: DataFrame, logits: str) -> DataFrame:
    """Shares from logits in the order negative, neutral, positive; score = positive - negative."""
    out = df.withColumn("__p", softmax(F.col(logits)))
    return out.select(
        *df.columns,
        F.col("__p")[0].alias("sentiment_negative"), F.col("__p")[1].alias("sentiment_neutral"),
        F.col("__p")[2].alias("sentiment_positive"), (F.col("__p")[2] - F.col("__p")[0]).alias("sentiment_score"),
    )


def masked_mean_pool(df: DataFrame, key: Sequence[str], vector: str, mask: str, name: str = "embedding") -> DataFrame:
    """Mean of the token vectors of each key, weighted by the mask; weight sum at least 1e-9.

    Vector positions are part of the grouping, so a key with very many tokens sums up
    on the map side to one row per position.
    """
    key = list(key)
    long = df.select(*key, F.col(mask).cast("double").alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    sums = long.groupBy(*key, "__i").agg(F.sum(F.col("__x") * F.col("__w")).alias("__s"), F.sum("__w").alias("__n"))
    pooled = sums.withColumn("__m", F.col("__s") / F.greatest(F.col("__n"), F.lit(1e-9)))
    out = pooled.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__i", "__m"))).alias("__v"))
    return out.select(*key, F.transform("__v", lambda v: v["__m"]).alias(name))


def sentiment_features(df: DataFrame, probs: str = "probs", keep: Sequence[str] = ()) -> DataFrame:
    """13 sentiment columns of a whole-text score; the role copies equal it and do not diverge."""
    p = F.col(probs)
    parts = {"negative": p[0], "neutral": p[1], "positive": p[2], "score": p[2] - p[0]}
    cols = [c.alias(f"{role}sentiment_{n}") for role in ("", "mgmt_", "analyst_") for n, c in parts.items()]
    return df.select(*keep, *cols, F.lit(0.0).alias("sentiment_divergence"))


def embedding_to_columns(df: DataFrame, embedding: str, dim: int, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.get(F.col(embedding), i).alias(f"embedding_{i:03d}") for i in range(dim)])


def embedding_size(df: DataFrame, embedding: str) -> DataFrame:
    return df.agg(F.min(F.size(embedding)).alias("min_size"), F.max(F.size(embedding)).alias("max_size"))


def incremental_score(new: DataFrame, done: DataFrame, key: Sequence[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score only rows whose key the feature table lacks, and put both together."""
    fresh = score(new.join(done.select(*key).distinct(), list(key), "left_anti"))
    return done.unionByName(fresh.select(*done.columns))
