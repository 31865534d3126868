"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsmill.session import get_spark  # noqa: E402
from newsmill.suite import QUERIES  # noqa: E402

HEADLINE = [
    "links_by_host",
    "p1_clean_url",
    "p7_rule_filter",
    "p22_headlines",
    "f2_article_text",
    "f8_keywords",
    "f11_support_check",
    "f18_transcript",
    "f21_extractive_summary",
    "j1_new_urls",
    "j3_entity_match",
    "j4_redirects",
    "j13_term_counts",
    "w1_keep_first_text",
    "w3_recent_calls",
    "w4_running_usage",
    "w8_rolling_context",
    "a4_usage_by_month_and_task",
    "a13_digest_lines",
    "a18_entities",
    "c1_harvest_links",
    "c5_harvest_headlines",
    "c6_market_lines",
    "c9_research",
    "c10_append_new",
    "c14_video_gates",
    "t1_append_new",
    "t5_admission",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_spark("newsmill-bench", cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
