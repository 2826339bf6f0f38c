"""Time the headline queries; prints one JSON line.

Each query runs twice; the second time counts, the first, which also compiles its plan's code, is
under ``cold``. Results are fetched as the queries give them; no query's output is large.
"""

from __future__ import annotations

import json
import os
import time

from pulse.catalog import inputs
from pulse.catalog.queries import all_queries
from pulse.plans.ingest import ingest
from pulse.session import local_session, shared_dir
from pulse.sinks.event_store import EventStore

HEADLINE = [
    "latency_by_scenario_strategy",
    "ingest_accept_reject",
    "shipping_first_wins",
    "stream_equals_batch",
    "run_stats",
    "shipping_stats",
    "box_stats",
    "latency_histogram",
    "official_metrics",
    "throughput_summary",
    "visibility_timeline",
    "latency_timeseries",
    "backlog_timeline",
    "counter_increase",
    "kruskal_wallis",
    "mann_whitney_u",
    "shipping_rank_tests",
    "quality_rollup",
    "quality_rows",
    "metric_snapshot",
    "bounded_sample_counts",
]


def _timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        # A result is written nowhere: the last stage runs and its rows are dropped.
        run = lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save()  # noqa: E731, B023
        cold[name], warm[name] = _timed(run), _timed(run)

    # As on a topic of 12 partitions.
    source = shared_dir(spark, "bench-log")
    inputs.kafka_log(spark, folder).repartition(12, "partition").write.parquet(source)
    records = spark.read.parquet(source)
    count = records.count()
    stores = iter([EventStore(spark, shared_dir(spark, "bench"), inputs.seen_at()) for _ in range(2)])
    run = lambda: ingest(records, next(stores), "one")
    cold["ingest_into_store"], warm["ingest_into_store"] = _timed(run), _timed(run)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, second run",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "ingest_records_per_s": round(count / warm["ingest_into_store"]),
                "cold": cold,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
