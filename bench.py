"""Benchmark: prints one JSON line with seconds per query.

``rebuild_projections`` folds the event log from event 0 into every projection table and is timed
from cold.  The read queries then run over those staged tables, warm, median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from checks import registry
from checks.bindings import world
HEADLINE = [
    "board_most_kills", "board_alltime_longest", "survivors_board", "profiles", "standings",
    "player_priors", "life_encounters", "death_verdicts", "life_timeline", "timeline_events",
    "life_track_markers", "shared_positions", "plan_bans", "running_balance", "balances", "wallet",
    "inbox", "scan_terms", "find_mentions", "append_new",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lifelog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    w = world(spark, sf_dir)

    times: dict[str, float] = {}
    start = time.perf_counter()
    w.projections.tables()
    times["rebuild_projections"] = time.perf_counter() - start
    start = time.perf_counter()
    w.dataset.prepare()
    times["life_facts"] = time.perf_counter() - start

    def run(name: str) -> float:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    for name in HEADLINE:
        run(name)
        times[name] = statistics.median(run(name) for _ in range(3))
    print(json.dumps({
        "metric": "lifelog_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
