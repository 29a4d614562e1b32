"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "beat_the_market", "asof_tiered", "asof_orders", "event_window_prices", "align", "benchmark_window_return", "nth_bar_after",
    "fill_forward", "fuse_features", "first_source_wins", "normalize_text", "clean_transcripts", "segment_cleaned", "lexicon_scores",
    "text_statistics", "nlp_features", "score_batches", "describe", "zscore_outliers", "winsorize", "robust_scale", "normalize_financials",
    "generated_features", "mutual_information", "chronological_index_orders", "roc_auc_by_group", "pairwise_significance",
    "group_agg", "join_statements", "masked_mean_pool", "quality_report", "matched_pairs", "fit_logistic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    from callgauge.plans import catalog  # noqa: F401
    from callgauge.plans.registry import QUERIES
    from callgauge.session import get_spark

    spark = get_spark(
        "callgauge-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
