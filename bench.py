"""Time headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
(optional, comma separated) the queries, ``BENCH_RUNS`` the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storyloom.catalog import QUERIES  # noqa: E402
from storyloom.session import local_session  # noqa: E402

HEADLINE = [
    "story_list", "story_list_active", "story_unread_all_visitors", "story_new_since_visit", "story_details", "search_articles",
    "stats", "feed_list", "recent_titles", "chat_context", "classify_article", "word_count", "html_to_text", "extract_main_content",
    "ingest_articles", "ingest_gate_counts", "feed_verdict", "cleanup_bad", "lifecycle_tick_stories", "apply_moves_articles",
    "apply_removals_articles", "apply_splits_articles", "accept_merge_pairs", "merge_stories_articles", "dedup_by_name", "apply_live_articles",
    "apply_regroup_articles", "group_payload", "summary_payload", "chat_payload", "parse_assignments", "parse_summaries",
    "propose_assignments", "propose_duplicates", "propose_new_clusters", "mark_all_read", "stream_story_sessions", "stream_ingest",
]


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row and column and moves none to the driver.
    QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    run("story_article_counts", spark, sf_dir)  # starts the JVM code paths and Python workers
    run("html_to_text", spark, sf_dir)
    seconds = {name: round(statistics.median(run(name, spark, sf_dir) for _ in range(runs)), 3) for name in chosen}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1], "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
