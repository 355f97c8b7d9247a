"""Seconds per headline query, as one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_SECONDS (no long query starts after this many).
The total is that of the headline queries without the long ones.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberscope.plans.catalog import QUERIES  # noqa: E402
from emberscope.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_flare_up_table",
    "a1_post_counts_10m",
    "a2_resolution_summary",
    "a3_lexicon_series",
    "a9_dictionary_series_1h",
    "a10_scoring_series",
    "a17_dedupe_ids",
    "a18_dedupe_content",
    "a21_top_terms",
    "j1_outer_join_features",
    "j5_interval_labels",
    "j6_substring_score",
    "j7_token_join",
    "w4_suggested_periods",
    "m9_stratified_split",
    "m13_roc_auc",
    "m14_best_f1_threshold",
    "m5_logistic",
    "m4_random_forest",
    "m19_model_leaderboard",
    "r1_streaming_features",
    "raw_files_to_labelled",
    "m10_cross_validation",
]
#: Long ones, timed after the others and only while the time set aside for them lasts.
LONG = ["unified_training", "m15_hold_out_topic_model", "m18_feature_sets", "m16_model_topic_grid"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for table in ("events", "documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").count()
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not a query's time
    seconds, left_out = {}, []
    began, limit = time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "600"))
    for name in [*HEADLINE, *LONG]:
        start = time.perf_counter()
        if name in LONG and start - began > limit:
            left_out.append(name)
            continue
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(s for n, s in seconds.items() if n not in LONG), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "left_out": left_out,
            }
        )
    )


if __name__ == "__main__":
    main()
