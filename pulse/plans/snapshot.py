"""Metric snapshot of each run, from scraped samples and the run's latency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import ratio_or_zero
from pulse.operators.keys import attach_per_run
from pulse.operators.telemetry import (
    counter_increase,
    first_usable,
    label_match,
    max_over_time,
    with_series,
)
from pulse.schemas import KEY, REAL_LAG_SOURCE

# --- Fixed values: metric names, and the label conditions tried one after the other ----

CPU_METRIC = "container_cpu_usage_seconds_total"
MEMORY_METRIC = "container_memory_rss"
HOST_CPU_METRIC = "node_cpu_seconds_total"
HOST_MEMORY_TOTAL = "node_memory_MemTotal_bytes"
HOST_MEMORY_FREE = "node_memory_MemAvailable_bytes"
PRODUCED_METRIC = "kafka_produced_messages_total"
LAG_METRIC = "kafka_consumergroup_lag"
CONTAINER_JOB = "cadvisor"
HOST_JOB = "node-exporter"
CONTAINER_IDS = r"/docker/.+|/system.slice/docker-.+\.scope"

_BIN_S = 3600


def within_runs(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples scraped between a run's start_ms and end_ms, with the run's key and duration.

    A range join by way of hours: each run is listed under every hour it touches, samples meet the
    runs of their own hour, and the exact bounds decide.
    """
    hours = F.sequence(F.floor(F.col("start_ms") / 1000 / _BIN_S), F.floor(F.col("end_ms") / 1000 / _BIN_S))
    listed = runs.select(*KEY, "start_ms", "end_ms", "duration_s").withColumn("_hour", F.explode(hours))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    timed = samples.withColumn("_at", at).withColumn("_hour", F.floor(F.col("_at") / 1000 / _BIN_S))
    return (
        attach_per_run(timed, listed, ["_hour"])
        .where(F.col("_at").between(F.col("start_ms"), F.col("end_ms")))
        .drop("_hour", "_at", "start_ms", "end_ms")
    )


def metric_snapshot(
    samples: DataFrame,
    runs: DataFrame,
    latency: DataFrame,
    containers: str = ".+",
    projects: str = ".+",
    topic: str | None = None,
) -> DataFrame:
    """Nine metrics of each run in long form.

    ``runs``: run key, start_ms, end_ms, duration_s. ``latency``: run key, latency_rows and the
    three quantiles. ``containers`` and ``projects`` are the label patterns of the containers
    measured. The processor and memory figures take the first source that has a non-zero value:
    containers by name, by project, by id, then the host. ``topic`` keeps the lag of that topic only.
    """
    found = with_series(within_runs(samples, runs))

    def same(name: str) -> Column:
        return F.coalesce(F.try_element_at("labels", F.lit(name)) == F.col(name), F.lit(False))

    def conditions(prefix: str, metric: str, host: str) -> list[tuple[str, Column]]:
        job = {"job": CONTAINER_JOB}
        return [
            (f"{prefix}_name", label_match(metric, job, like={"name": containers})),
            (f"{prefix}_project", label_match(metric, job, like={"container_label_com_docker_compose_project": projects})),
            (f"{prefix}_id", label_match(metric, job, like={"id": CONTAINER_IDS})),
            (f"{prefix}_host", label_match(host, {"job": HOST_JOB}, unequal={"mode": "idle"})),
        ]

    cpu = conditions("cpu", CPU_METRIC, HOST_CPU_METRIC)
    memory = conditions("mem", MEMORY_METRIC, HOST_MEMORY_TOTAL)[:3]
    produced = [
        ("produced", label_match(PRODUCED_METRIC) & same("scenario") & same("run_id") & same("strategy")),
        ("produced_legacy", label_match(PRODUCED_METRIC) & same("scenario")),
    ]

    # Each counter's increase is taken once; the sources then pick among the increases.
    counters = found.where(F.col("metric").isin(CPU_METRIC, HOST_CPU_METRIC, PRODUCED_METRIC))
    labelled = [*KEY, "duration_s", "series"]
    tagged = counters.withColumns({f"_{name}": c for name, c in [*cpu, *produced]})
    flags = [f"_{name}" for name, _ in [*cpu, *produced]]
    rises = counter_increase(tagged, [*labelled, *flags], "ts", "value")
    rates = rises.groupBy(*KEY, "duration_s").agg(
        *[F.sum(F.when(F.col(flag), F.col("increase"))).alias(flag) for flag in flags]
    )
    rates = rates.select(
        *KEY,
        *[ratio_or_zero(flag, "duration_s").alias(flag) for flag in flags],
    )

    gauges = found.where(F.col("metric").isin(MEMORY_METRIC, HOST_MEMORY_TOTAL, HOST_MEMORY_FREE))
    held = [*memory, ("mem_total", label_match(HOST_MEMORY_TOTAL, {"job": HOST_JOB})),
            ("mem_free", label_match(HOST_MEMORY_FREE, {"job": HOST_JOB}))]
    marked = gauges.withColumns({f"_{name}": c for name, c in held})
    means = marked.groupBy(*KEY, "series", *[f"_{name}" for name, _ in held]).agg(F.avg("value").alias("_mean"))
    sums = means.groupBy(*KEY).agg(
        *[F.sum(F.when(F.col(f"_{name}"), F.col("_mean"))).alias(f"_{name}") for name, _ in held]
    )

    lag_of_run = (
        (F.col("metric") == LAG_METRIC)
        & (F.try_element_at("labels", F.lit("consumergroup"))
           == F.concat_ws("-", F.lit("flink-streaming"), "scenario", "run_id"))
        & (F.col("strategy") == "streaming")
    )
    if topic is not None:
        lag_of_run = lag_of_run & (F.try_element_at("labels", F.lit("topic")) == topic)
    lag = max_over_time(found.where(lag_of_run), KEY).withColumnRenamed("maximum", "_lag")

    c = F.col
    wide = (
        runs.select(*KEY, "duration_s")
        .join(rates, KEY, "left")
        .join(sums, KEY, "left")
        .join(lag, KEY, "left")
        .join(latency.select(*KEY, "latency_rows", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms"), KEY, "left")
        .select(
            *KEY,
            first_usable(c("_cpu_name"), c("_cpu_project"), c("_cpu_id"), c("_cpu_host")).alias("cpu"),
            first_usable(
                c("_mem_name"), c("_mem_project"), c("_mem_id"), c("_mem_total") - c("_mem_free")
            ).alias("mem"),
            first_usable(c("_produced"), c("_produced_legacy")).alias("made"),
            ratio_or_zero(F.coalesce("latency_rows", F.lit(0)), "duration_s").alias("sunk"),
            F.coalesce("_lag", F.lit(0.0)).alias("lag"),
            c("_lag").isNotNull().cast("double").alias("lag_real"),
            *[F.coalesce(f"latency_{p}_ms", F.lit(0.0)).alias(p) for p in ("p50", "p95", "p99")],
        )
    )
    return wide.selectExpr(
        *KEY,
        "stack(9, 'cpu_total_cores', cpu, 'cores', 'mem_rss_bytes', mem, 'bytes',"
        " 'tput_produced_eps', made, 'events/s', 'tput_sink_eps', sunk, 'events/s',"
        " 'kafka_consumer_lag', lag, 'messages', 'kafka_consumer_lag_real_present', lag_real, 'bool',"
        " 'latency_p50_ms', p50, 'ms', 'latency_p95_ms', p95, 'ms', 'latency_p99_ms', p99, 'ms')"
        " AS (metric, value, unit)",
    )


def series_of_snapshot(snapshot: DataFrame, at_s: Column) -> tuple[DataFrame, DataFrame]:
    """Lag and resource series of one point per run, out of a pivoted snapshot."""
    lag = snapshot.select(
        at_s.alias("timestamp"),
        *KEY,
        F.col("kafka_consumer_lag").alias("lag"),
        F.when(
            (F.col("strategy") == "streaming") & (F.col("kafka_consumer_lag_real_present") >= 1),
            REAL_LAG_SOURCE,
        ).otherwise("missing").alias("lag_source"),
    )
    resources = snapshot.select(
        at_s.alias("timestamp"), *KEY, F.col("cpu_total_cores").alias("cpu_cores"), "mem_rss_bytes"
    )
    return lag, resources
