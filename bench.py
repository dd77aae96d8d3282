"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Each query is built and written to the ``noop`` sink once, after one small
warm-up query for the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from weftlink.session import local_session
from weftlink.workloads.catalog import QUERIES

HEADLINE = [
    "hrefs",
    "page_links",
    "links_with_refresh",
    "link_type_counts",
    "canonical_dups",
    "visible_text",
    "word_counts",
    "fallback_document",
    "page_markdown",
    "markdown_export",
    "export_unchanged",
    "boilerplate_rules",
    "boilerplate_stripped",
    "snapshot_fetch",
    "broken_links",
    "robots_rules",
    "robots_allowed",
    "crawl",
    "crawl_max_pages",
    "crawl_robots",
    "crawl_stats",
    "pages_report",
    "error_report",
    "external_check",
    "page_report_merge",
    "health_per_url",
    "fetch_batches",
    "health_windows",
    "stream_new_urls",
    "stream_boilerplate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    QUERIES["page_titles"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "total seconds of headline queries",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("/sf", 1)[-1],
        "cpus": cpus,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
