"""Time the headline queries and print one JSON line.

Every query is run whole into a sink that asks for all columns, so nothing is pruned away. One untimed run warms up the JVM; the best of three timed runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from turnwise import local_session  # noqa: E402
from turnwise.plans import REGISTRY  # noqa: E402

HEADLINE = (
    "trajectory_messages",
    "trajectory_messages_events",
    "trajectory_messages_split",
    "trajectories_nested",
    "trajectories_nested_segments",
    "trajectory_result",
    "trajectory_role_warnings",
    "row_identity_hash",
    "identity_report",
    "row_table",
    "json_promotion",
    "json_normalised",
    "value_kind_profile",
    "natural_sort_customers",
    "row_numbers",
    "text_preview",
    "timestamp_format",
    "column_classes",
    "text_search",
    "paged_listing_deep",
    "retention_report",
    "retention_survivors_history",
    "query_log_audit",
)
RUNS = 3


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "12g")
    times: dict[str, float] = {}
    for name in HEADLINE:
        spent = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, directory).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = min(spent[1:])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in times.items()},
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
