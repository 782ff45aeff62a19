"""Time the headline queries: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
Each query is read, computed and written to a sink that discards rows. An untimed pass over the
smallest tables compiles the code paths first; no result or input is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import spark_query  # noqa: E402
from tonecast.session import build_session  # noqa: E402

HEADLINE = [
    "nss_by_aspect_filtered", "kpis", "nss_cuts_grouping_sets", "nss_aspect_month", "trend_by_aspect", "exec_summary",
    "insight_cards", "source_breakdown", "seasonality_wide", "class_report", "class_report_by_aspect", "calibration",
    "error_samples", "threshold_tune", "rule_aspect", "group_split", "stratified_folds", "cache_upsert", "tokens_vocab",
    "bigrams_by_sentiment", "aspect_deep_dive", "aspect_context", "tfidf_weights", "cosine_topk", "score_reviews",
    "predict_view", "token_attribution", "oversample", "retrieved_chunks", "context_text", "lda_topics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    run = {}
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir
    for name in names:
        spark_query(name)(spark, warm).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        spark_query(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        run[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(run.values()), 3), "unit": "sec",
                      "queries": run, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
                      "warmup": os.path.basename(warm)}))


if __name__ == "__main__":
    main()
