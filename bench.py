"""Headline queries on the driver tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated, optional),
BENCH_RUNS (default 1 measured run after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "triage_overview",
    "rule_cascade",
    "rule_hard_block",
    "rule_direction",
    "rule_direction_ru",
    "join_rules_table",
    "scorer_message",
    "fn_text_hash",
    "fn_word_count",
    "fn_contact_spans",
    "fn_tech_leak_check",
    "dedup_exact_hash",
    "dedup_ttl",
    "dedup_fuzzy_jaccard",
    "dedup_near_clusters",
    "dedup_semantic_window",
    "dedup_semantic_recent",
    "dedup_message_sets",
    "join_embedding_cosine",
    "join_hash_then_prefix",
    "join_asof_cooldown",
    "join_time_range_dup",
    "join_best_case",
    "agg_overview",
    "agg_daily_report",
    "agg_hourly_tier_stats",
    "win_last_n_transcript",
    "win_gap_since_prev",
    "win_daily_cap",
    "session_debounce",
    "token_bucket",
    "circuit_state",
    "circuit_state_of_all",
    "topk_indexed_snippets",
    "sink_upsert",
    "tbl_revalidate",
    "tbl_recover_contacts",
    "al_select_batch",
    "bandit_posterior",
    "log_progress_totals",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from siftline.plans import catalog
    from siftline.session import local_session

    spark = local_session(cpus, app="siftline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
