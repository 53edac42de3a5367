"""Times the headline queries in one warm session and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sluice import catalog
from sluice.session import session

HEADLINE = (
    "source_health", "rolling_upper_median", "rate_window_60s", "session_gap", "breaker_fold", "drift_ewma", "upsert_apply", "canonical_id",
    "clean_html", "block_token_count", "batch_dedupe_best", "tfidf_word", "search_topk", "near_duplicates_blocked", "topk_then_filter",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", cpus=int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)))
    took: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
