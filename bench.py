"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "eval_flagship_reversal_ic", "label_forward_return", "transform_neutralize",
    "transform_ema_ratio", "eval_ic_summary", "eval_quantile_summary", "eval_turnover_summary",
    "eval_decay", "screen_correlation_pairs", "screen_orthogonalize_two",
    "feature_daily_all_coverage", "mask_build", "adjust_cumulative", "weight_constraints",
    "cost_apply", "account_gross", "account_costed", "cov_sample", "metric_performance",
    "tick_sequence_gaps", "flow_slot_panel", "feature_flow", "book_snapshots",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from longpanel.plans.catalog import load

    queries = load().queries
    only = sys.argv[1:] or HEADLINE
    # one untimed query starts the JVM, the Python workers and the table statistics
    queries["screen_correlation_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    out = {}
    for name in only:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t0, 3)
        print(f"{name}: {out[name]}", file=sys.stderr)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
