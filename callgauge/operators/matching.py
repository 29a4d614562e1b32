"""Matched comparison of treated and untreated rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callgauge.operators.ordering import asof, even_range


def propensity(df: DataFrame, treat: str, covariates: Sequence[str], name: str = "propensity") -> DataFrame:
    """Probability of treatment given the covariates (logistic model on standardised columns)."""
    from callgauge.operators.modeling import assemble, fit_logistic, prepare, scored

    train, _, cols = prepare(df, df, covariates)
    data = assemble(train.withColumn("__y", F.col(treat).cast("double")), cols, "__x")
    return scored(fit_logistic(data, "__y", "__x", balanced=False, c=1.0), data, name).drop("__x", "__y")


def matched_pairs(
    df: DataFrame, treat: str, key: str, score: str, value: str, caliper: float | None = None
) -> DataFrame:
    """Nearest control of every treated row by score, on either side, with replacement.

    Two as-of lookups along the score axis instead of pairing rows within score bands, so the
    work is one sort of both groups however dense a band is.
    """
    treated = df.filter(F.col(treat) == 1)
    control = df.filter(F.col(treat) == 0).select(
        F.col(score).alias("__s"), F.col(key).alias("control_key"), F.col(value).alias("control_value")
    )
    ranges = even_range(df, score)
    below = asof(treated, control, [], score, "__s", ["control_key", "control_value"], name="__lo", range_of=ranges)
    both = asof(below, control, [], score, "__s", ["control_key", "control_value"], name="__hi", forward=True, range_of=ranges)
    far_lo, far_hi = F.col(score) - F.col("__lo.__s"), F.col("__hi.__s") - F.col(score)
    near = F.when(F.col("__hi").isNull() | (far_lo <= far_hi), F.col("__lo")).otherwise(F.col("__hi"))
    out = both.withColumn("__c", near).filter("__c is not null").select(
        *treated.columns, F.col("__c.control_key"), F.col("__c.control_value"),
        F.abs(F.col(score) - F.col("__c.__s")).alias("distance"),
    )
    return out.filter(F.col("distance") <= caliper) if caliper is not None else out


def pair_effect(pairs: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference of matched pairs with standard error, t, Cohen's d and the pair count."""
    d = F.col(value) - F.col("control_value")
    pooled = F.sqrt((F.var_samp(value) + F.var_samp("control_value")) / 2)
    se = F.stddev_samp(d) / F.sqrt(F.count(d))
    out = pairs.groupBy(*by).agg(
        F.avg(d).alias("effect"), se.alias("standard_error"), F.try_divide(F.avg(d), se).alias("t_statistic"),
        F.try_divide(F.avg(d), pooled).alias("cohens_d"), F.count(d).alias("pairs"),
    )
    from callgauge.operators.evaluation import _normal_tail

    p = _normal_tail(F.col("t_statistic"))
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


#: A prime below 2**31 and multipliers, so that draws are formed in 64-bit numbers by any engine.
PRIME = 2_147_483_647
STEPS = (48_271, 69_621, 16_807, 40_692)


def poisson_cuts() -> list[int]:
    """Draws from which on a Poisson(1) count is at least 1, 2, ..."""
    shares = [math.exp(-1.0) / math.factorial(k) for k in range(10)]
    return [int(PRIME * sum(shares[: k + 1])) for k in range(10)]


def poisson_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) count of each key (row) in each replicate (column), from the key alone."""
    a, b, c, d = STEPS
    first = (keys[:, None] % PRIME * a + np.arange(1, replicates + 1) * b + seed) % PRIME
    second = first * first % PRIME
    third = (second * c + first * d) % PRIME
    return np.searchsorted(poisson_cuts(), (third * third + second) % PRIME, "right")


def replicate_sums(rows: DataFrame, replicates: int, seed: int, held: int = 4096) -> DataFrame:
    """(replicate, weight, total) over ``rows`` (k, d): a task adds up all replicates of its rows in two arrays."""

    def work(batches):
        weight, total = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            k, d = batch.column("k").to_numpy(), batch.column("d").to_numpy()
            for low in range(0, len(k), held):
                w = poisson_weights(k[low:low + held], replicates, seed)
                weight += w.sum(axis=0)
                total += d[low:low + held] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(weight), pa.array(total)], ["replicate", "weight", "total"])

    return rows.mapInArrow(work, "replicate int, weight double, total double")


def bootstrap_interval(pairs: DataFrame, value: str, key: str, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean difference.

    Each pair draws a Poisson weight per replicate from its key, so a rerun of a task gives the same weights.
    The pairs are read once and stay where they are: a task keeps the sums of all replicates, and one row per
    task and replicate is shuffled. Pairs without a difference take no part.
    """
    number = F.col(key).cast("long") if isinstance(pairs.schema[key].dataType, T.IntegralType) else F.xxhash64(key)
    rows = pairs.select(F.coalesce(number, F.lit(0)).alias("k"), (F.col(value) - F.col("control_value")).cast("double").alias("d")).filter("d IS NOT NULL")
    sums = replicate_sums(rows, replicates, seed).groupBy("replicate").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("effect"))
    tail = (1 - level) / 2
    return sums.agg(
        F.percentile("effect", F.lit(tail)).alias("ci_lower"), F.percentile("effect", F.lit(1 - tail)).alias("ci_upper"),
        F.count("effect").alias("replicates"),
    )


def treatment_effect(pairs: DataFrame, value: str, key: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    # two tables of one row each
    out = pair_effect(pairs, value).join(bootstrap_interval(pairs, value, key, replicates, seed))
    return out.withColumn("direction", F.when(F.col("effect") > 0, "POSITIVE").otherwise("NEGATIVE"))
