"""Quality gates, decisions and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions import fixed
from callgauge.operators import aggregates as A


def lookahead_violations(df: DataFrame, event: str = "transcript_date") -> DataFrame:
    e = F.col(event)
    out = df.agg(
        F.count_if(F.col("financial_date") > e).alias("financial_after_event"),
        F.count_if(F.col("market_date_before") > e).alias("before_after_event"),
        F.count_if(F.col("market_date_after") <= e).alias("after_not_after_event"),
    )
    total = F.col("financial_after_event") + F.col("before_after_event") + F.col("after_not_after_event")
    return out.withColumn("passed", total == 0)


def target_violations(df: DataFrame, event: str = "transcript_date") -> DataFrame:
    e = F.col(event)
    flag = F.count_if(~F.col("is_temporally_valid")) if "is_temporally_valid" in df.columns else F.lit(0).cast("long")
    out = df.agg(
        F.count_if(F.col("market_date_after") < e).alias("after_before_event"),
        F.count_if(F.col("market_date_before") > e).alias("before_after_event"),
        flag.alias("flagged_invalid"),
    )
    return out.withColumn("passed", (F.col("after_before_event") + F.col("before_after_event") + F.col("flagged_invalid")) == 0)


GATE = ["phase", "agent", "gate", "measured", "threshold", "passed", "critical", "decision", "rationale"]


def gate_row(
    row: DataFrame, phase: str, agent: str, gate: str, measured: Column, threshold: float, ok: Column,
    good: str, bad: str, critical: bool = False,
) -> DataFrame:
    """One decision row from a one-row table."""
    value = measured.cast("double")
    return row.select(
        F.lit(phase).alias("phase"), F.lit(agent).alias("agent"), F.lit(gate).alias("gate"),
        value.alias("measured"), F.lit(float(threshold)).alias("threshold"),
        F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(critical).alias("critical"),
        F.when(F.coalesce(ok, F.lit(False)), good).otherwise(bad).alias("decision"),
        F.concat(F.lit("measured "), F.coalesce(F.round(value, 4).cast("string"), F.lit("nothing")), F.lit(f" against {threshold}")).alias("rationale"),
    )


def data_volume_gate(df: DataFrame, need: int = fixed.MIN_ROWS) -> DataFrame:
    n = F.col("n")
    return gate_row(df.agg(F.count(F.lit(1)).alias("n")), "data_ingestion", "ingestion", "data_volume", n, need, n >= need,
                    "use existing data", "ingest again")


def parse_rate_gate(df: DataFrame, processed: Column, need: float = fixed.PARSE_RATE) -> DataFrame:
    rate = F.col("ok") / F.greatest(F.col("n"), F.lit(1))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(processed).alias("ok"))
    return gate_row(row, "preprocessing", "preprocessing", "parse_rate", rate, need, rate >= need,
                    "parsing confirmed", "use fallback rules")


def alignment_gate(df: DataFrame, event: str = "transcript_date") -> DataFrame:
    bad = F.col("after_before_event") + F.col("flagged_invalid")
    return gate_row(target_violations(df, event), "preprocessing", "preprocessing", "temporal_alignment", bad, 0, bad == 0,
                    "windows follow their events", "look-ahead found", critical=True)


def feature_gate(sentiment: DataFrame | None, nlp: DataFrame | None, need: int = fixed.EMBEDDING_SIZE) -> DataFrame:
    """Which feature set can be used: full, lexicon only, or none."""
    have_nlp = nlp is not None
    dims = len([c for c in sentiment.columns if c.startswith("embedding_")]) if sentiment is not None and have_nlp else 0
    chosen = "full_with_finbert" if dims >= need else "lm_only" if have_nlp else "none"
    base = nlp if nlp is not None else sentiment
    row = base.agg(F.count(F.lit(1)).alias("n"))
    return gate_row(row, "feature_extraction", "features", "feature_set", F.lit(dims), need, F.lit(dims >= need),
                    chosen, chosen, critical=not have_nlp)


def integration_gate(full: DataFrame, is_train: Column, need: int = fixed.MIN_FEATURES, share: tuple[float, float] = fixed.TRAIN_SHARE) -> DataFrame:
    features = len([c for c in full.columns if c not in fixed.LEAK_COLUMNS])
    row = full.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_train).alias("train"))
    ratio = F.col("train") / F.greatest(F.col("n"), F.lit(1))
    wide = gate_row(row, "integration", "integration", "feature_count", F.lit(features), need, F.lit(features >= need),
                    "dimensionality acceptable", "low feature count")
    split = gate_row(row, "integration", "integration", "train_share", ratio, share[0], (ratio >= share[0]) & (ratio <= share[1]),
                     "split valid", "non-standard split")
    return wide.unionByName(split)


def model_gate(metrics: DataFrame, baseline: float = fixed.BASELINE_AUC, gain: float = fixed.IMPROVEMENT) -> DataFrame:
    """Best baseline, improvement over it, and which source is best; ``metrics`` has (source, roc_auc)."""
    row = metrics.agg(
        F.coalesce(F.max(F.when(F.col("source") == "baseline", F.col("roc_auc"))), F.lit(0.0)).alias("base"),
        F.max("roc_auc").alias("best"),
        F.max_by("source", F.struct("roc_auc", F.col("source") == "baseline")).alias("winner"),
    )
    up = F.col("best") - F.col("base")
    parts = [
        gate_row(row, "modeling", "modeling", "baseline_auc", F.col("base"), baseline, F.col("base") >= baseline,
                 "baseline established", "weak baseline"),
        gate_row(row, "modeling", "modeling", "improvement", up, gain, up >= gain, "target achieved", "marginal improvement"),
        gate_row(row, "modeling", "modeling", "architecture", F.col("best"), 0, F.lit(True), "", "").withColumn(
            "decision", F.lit("selected")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def best_source(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max_by("source", F.struct("roc_auc", F.col("source") == "baseline")).alias("best_model"), F.max("roc_auc").alias("best_auc"))


def run_status(gates: DataFrame) -> DataFrame:
    """Status of a run from its gate rows; a failed critical gate stops it."""
    return gates.agg(
        F.when(F.bool_and("passed"), "success").otherwise("completed_with_warnings").alias("status"),
        F.count(F.lit(1)).alias("decisions"), F.count_if(~F.col("passed")).alias("warnings"),
        F.coalesce(F.bool_or(F.col("critical") & ~F.col("passed")), F.lit(False)).alias("stop"),
    )


def decision_log(gates: Sequence[DataFrame]) -> DataFrame:
    both = reduce(lambda a, b: a.unionByName(b), [g.select(*GATE) for g in gates])
    return both.select(F.current_timestamp().alias("ts"), *GATE)


def decision_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("agent", "phase").agg(F.count(F.lit(1)).alias("decisions"), F.count_if("passed").alias("passed"))


def phase_metric(log: DataFrame) -> DataFrame:
    """The headline number of every phase."""
    return log.select("phase", "gate", "measured", F.concat_ws(" ", F.round("measured", 3).cast("string"), "gate").alias("headline"))


def stage_assertions(checks: Sequence[tuple[str, DataFrame, Column, str, float]]) -> DataFrame:
    """Rows (check, measured, comparison, threshold, passed) from one-row tables."""
    test = {">=": lambda m, t: m >= t, ">": lambda m, t: m > t, "=": lambda m, t: m == t, "<=": lambda m, t: m <= t}
    rows = [
        df.select(
            F.lit(name).alias("check"), m.cast("double").alias("measured"), F.lit(op).alias("comparison"),
            F.lit(float(t)).alias("threshold"), F.coalesce(test[op](m.cast("double"), F.lit(float(t))), F.lit(False)).alias("passed"),
        )
        for name, df, m, op, t in checks
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def quality_report(aligned: DataFrame, stages: Sequence[DataFrame] = ()) -> DataFrame:
    """Summary, missing values, outliers, gaps, look-ahead, returns and stages as (section, metric, value)."""

    def rows(df: DataFrame, section: str) -> DataFrame:
        cols = [f.name for f in df.schema if f.dataType.simpleString() not in ("string", "date", "timestamp")]
        return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value").select(
            F.lit(section).alias("section"), "metric", "value")

    def named(df: DataFrame, section: str, key: str, value: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(key).alias("metric"), F.col(value).cast("double").alias("value"))

    financial = [c for c in aligned.columns if c.startswith("financial_") and dict(aligned.dtypes)[c] == "double"][:5]
    parts = [
        rows(A.dataset_summary(aligned), "summary"),
        rows(A.overall_completeness(aligned), "summary"),
        named(A.completeness(aligned), "completeness", "column", "completeness"),
        rows(A.missing_totals(aligned), "missing_values"),
        named(A.iqr_outliers(aligned, financial), "outliers", "column", "outliers"),
        rows(lookahead_violations(aligned), "temporal_integrity"),
        rows(A.gap_stats(aligned), "temporal_integrity"),
        rows(A.distribution_stats(aligned, "stock_return_3day"), "returns"),
        *([named(A.stage_funnel(stages), "stages", "stage", "success_rate")] if stages else []),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
