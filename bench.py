"""Headline queries over whole tables; prints one JSON line with seconds per query.

Every query is run to its last row (noop sink). Each gets one untimed run over the smallest tables
first, so a figure is the time of the data work and not of JVM warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fitloom.catalog.queries import QUERIES  # noqa: E402
from fitloom.session import local_session  # noqa: E402

HEADLINE = (
    "match_scores", "match_topk", "token_sets", "keyword_top30", "lexicon_hits", "profile_parse", "role_rank8",
    "section_runs", "project_groups", "experience_groups", "collect_postings", "markdown_table_state",
    "dedup_first_blank_kept", "load_new_anti", "stats_bundle", "score_breaks", "topn_documents",
    "discovery_matches",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fitloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for folder in (warm_dir, sf_dir):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
