"""Times the headline queries on one host and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from alertloom.plans import catalog
from alertloom.session import build_session

HEADLINE = (
    "metrics_overview",
    "metrics_by_source",
    "metrics_timeline",
    "review_pending_topk",
    "latest_state",
    "correction_upsert",
    "split_assign",
    "split_contamination",
    "merge_corrections",
    "message_digests",
    "export_corrections",
    "chat_validate",
    "map_crowdstrike",
    "map_sentinel",
    "label_all",
    "normalize_response",
    "stream_routing",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("alertloom-bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every column of every row is computed; nothing is counted or cut.
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
