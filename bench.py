"""Headline queries, warm, as one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ("award_verdict", "award_score", "score_topk", "training_verdict", "threshold_funnel", "topk_per_company", "prior_wins", "dedup_keep_first", "asof_first_8k", "asof_last_dilutive", "anti_recent_8k", "pr_band_join", "ledger_anti_join", "ohlc_horizon_pivot", "bracket_sim", "backtest_summary", "grid_search", "position_transition", "bm25", "hybrid_score", "cosine_topk", "token_f1", "knee", "line_select", "content_hash_dedup", "html_text", "stream_dedup")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from bidsmith import catalog

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.checkpoint.dir", "/tmp/bidsmith-bench").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2 if name.startswith("stream") else 3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "median warm seconds, summed over headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
