"""Run and scenario reports over samples and per-run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.columns import (
    at_least,
    display_label,
    in_scope,
    mib_to_gib,
    ratio_or_null,
    ratio_or_zero,
    to_millions,
)
from pulse.operators import matrix
from pulse.operators.keys import attach_per_run, in_display_order
from pulse.operators.order_stats import (
    LATENCY_QUANTILES,
    MS_WIDTH,
    box_stats,
    exact_quantiles,
    quantiles_of_counts,
)
from pulse.operators.ranks import kruskal_wallis, mann_whitney
from pulse.schemas import (
    KEY,
    OFFICIAL_COLUMNS,
    SCENARIO_LABELS,
    SCENARIO_TARGET_EPS,
    SCENARIOS,
    STRATEGIES,
    STRATEGY_LABELS,
)

# --- latency -----------------------------------------------------------------------


def _latency_stats(samples: DataFrame, keys: Sequence[str], visible: bool = False) -> DataFrame:
    """Latency figures; with ``visible`` also the visible events and the last one's time, out of the same counts."""
    seen = [F.count("visible_at").alias("_visible"), F.max("visible_at").alias("_last")] if visible else []
    measured = samples.where(F.col("latency_ms").isNotNull())
    counts = measured.groupBy(*keys, "latency_ms").agg(F.count("*").alias("n"), *seen)
    x, n = F.col("latency_ms"), F.col("n")
    extra = [
        F.sum(n).alias("latency_rows"),
        F.sum(F.when(x > 0, n).otherwise(0)).alias("latency_positive_count"),
        F.sum(F.when(x <= 0, n).otherwise(0)).alias("latency_non_positive_count"),
        F.min(x).cast("double").alias("latency_min_ms"),
        F.max(x).cast("double").alias("latency_max_ms"),
    ]
    if visible:
        extra += [F.sum("_visible").alias("visible_events_final_latency"), F.max("_last").alias("last_visible_at_ms")]
    carry = ["_visible", "_last"] if visible else []
    return quantiles_of_counts(counts, keys, "latency_ms", LATENCY_QUANTILES, width=MS_WIDTH, extra=extra, carry=carry)


def _visibility(samples: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Visible events of each run and the last one's time; with ``cutoffs`` (run key,
    generation_end_ms) also those visible by the cut-off, unknown where a run has none.

    Samples are counted by millisecond before they meet the cut-offs. A sample without a readable
    latency counts for the cut-off only.
    """
    measured = F.when(F.col("latency_ms").isNotNull(), F.col("visible_at"))
    if cutoffs is None:
        return samples.groupBy(*KEY).agg(
            F.count(measured).alias("visible_events_final_latency"),
            F.max(measured).alias("last_visible_at_ms"),
        )
    counts = samples.where(F.col("visible_at").isNotNull()).groupBy(*KEY, "visible_at").agg(
        F.count("*").alias("n"), F.count("latency_ms").alias("_measured")
    )
    counts = attach_per_run(counts, cutoffs.select(*KEY, "generation_end_ms"), how="left")
    in_time = F.when(F.col("visible_at") <= F.col("generation_end_ms"), F.col("n"))
    late = F.when(F.col("generation_end_ms").isNotNull(), F.lit(0))
    return counts.groupBy(*KEY).agg(
        F.sum("_measured").alias("visible_events_final_latency"),
        F.max(F.when(F.col("_measured") > 0, F.col("visible_at"))).alias("last_visible_at_ms"),
        F.sum(F.coalesce(in_time, late)).alias("visible_events_cutoff"),
    )


def run_stats(samples: DataFrame) -> DataFrame:
    """Exact latency figures of every run, and how many events it made visible, and when last."""
    return _latency_stats(samples, KEY, visible=True)


def scenario_stats(samples: DataFrame) -> DataFrame:
    """Latency figures by strategy and scenario, from all rows: quantiles of runs do not add up."""
    stats = _latency_stats(samples, ["strategy", "scenario"])
    return stats.drop("latency_positive_count", "latency_non_positive_count")


def latency_summary(stats: DataFrame) -> DataFrame:
    """Scenario statistics for print: display labels, two decimals, display order."""
    columns = [f"latency_{name}_ms" for name in ("p50", "p95", "p99", "min", "max")]
    ordered = in_display_order(stats)
    return ordered.select(
        display_label("strategy", STRATEGY_LABELS).alias("strategy_label"),
        display_label("scenario", SCENARIO_LABELS).alias("scenario_label"),
        F.col("latency_rows").alias("visible_events"),
        *[F.round(c, 2).alias(c) for c in columns],
    )


def latency_distribution(samples: DataFrame, by=("scenario", "strategy")) -> DataFrame:
    """Box-plot numbers of the positive latencies."""
    return box_stats(samples.where(F.col("latency_ms") > 0), list(by), "latency_ms", MS_WIDTH)


def statistical_tests(samples: DataFrame) -> DataFrame:
    """One row per scenario: the test over all strategies, and each pair's adjusted p."""
    kept = samples.where(F.col("latency_ms").isNotNull())
    whole = kruskal_wallis(kept)
    pairs = mann_whitney(kept)
    names = ["batch_vs_microbatch", "batch_vs_streaming", "microbatch_vs_streaming"]
    wide = pairs.groupBy("scenario").agg(
        *[F.max(F.when(F.col("pair") == n, F.col("p_adj"))).alias(f"{n}_p_adj") for n in names]
    )
    significant = F.when(F.col("kruskal_p") < 0.05, "si").otherwise("no")
    return (
        whole.where(F.col("groups") >= 2)
        .join(wide, "scenario", "left")
        .select("scenario", "kruskal_h", "kruskal_p", significant.alias("significant"),
                *[f"{n}_p_adj" for n in names])
    )


def reconciled_counts(summaries: DataFrame, exported: DataFrame) -> DataFrame:
    """What each run says was visible beside the rows that were exported of it, and whether the two differ; a run may have no rows.

    ``exported``: run key and ``rows``.
    """
    joined = summaries.select(*KEY, "visible_events").join(exported.select(*KEY, "rows"), KEY, "left")
    return joined.withColumn("differs", ~F.col("visible_events").eqNullSafe(F.col("rows")))


# --- official metrics -----------------------------------------------------------------


def visible_at_cutoff(samples: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Events visible by each run's cut-off (``generation_end_ms``), for runs that have one."""
    figures = _visibility(samples, cutoffs).select(*KEY, "visible_events_cutoff")
    return figures.where(F.col("visible_events_cutoff").isNotNull())


def merge_per_run(*tables: DataFrame) -> DataFrame:
    """Tables of one row per run, side by side; a run is in the result if it is in any table.

    The tables are put under each other and grouped once, which takes one shuffle, where joining
    them one after the other takes one per table. Column names must differ between tables.
    """
    stacked = matrix.union_all(*tables)
    values = [c for c in stacked.columns if c not in KEY]
    return stacked.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in values])


def official_metrics(
    samples: DataFrame,
    metadata: DataFrame,
    summaries: DataFrame,
    generators: DataFrame,
    lag: DataFrame,
    resources: DataFrame,
    scope: str = "official",
    whole_seconds: bool = False,
    fill_zero: bool = False,
    warmup_s: int = 0,
) -> DataFrame:
    """One row per run with its throughput, delivery, backlog, drain, latency and resource figures.

    The cut-off is the generator's end in ms, or the metadata's, which is in seconds, where that is
    missing. ``whole_seconds`` always takes the latter. ``fill_zero`` counts a run without samples
    as having 0 events visible at the cut-off; otherwise that is unknown. ``warmup_s`` leaves out
    events produced in the first seconds of a run.
    """
    tables = [samples, metadata, summaries, generators, lag, resources]
    samples, metadata, summaries, generators, lag, resources = (
        t.where(in_scope("scenario", scope)) for t in tables
    )
    if warmup_s:
        samples = _after_warmup(samples, generators, warmup_s)
    c = F.col
    meta = metadata.select(
        *KEY, "target_eps", c("official_duration_seconds").alias("official_duration_s"), "generation_end_ts"
    )
    summary = summaries.select(
        *KEY,
        c("generated_events").alias("_generated_summary"),
        c("visible_events").alias("_visible_summary"),
        F.coalesce("cpu_cores_avg", "cpu_avg_cores").alias("_cpu_summary"),
        F.coalesce("mem_rss_mb_avg", "memory_rss_avg_mb").alias("_memory_summary"),
    )
    generator = generators.select(
        *KEY,
        F.coalesce("total_events_generated", "generated_events").alias("_generated_generator"),
        "generation_end_epoch_ms",
    )
    ended = c("generation_end_ts") * 1000
    if not whole_seconds:
        ended = F.coalesce(c("generation_end_epoch_ms"), ended)
    ends = merge_per_run(
        meta.select(*KEY, "generation_end_ts"), generator.select(*KEY, "generation_end_epoch_ms")
    ).select(*KEY, ended.alias("generation_end_ms"))
    used = matrix.resources_per_run(resources).select(
        *KEY, c("cpu_avg_cores").alias("_cpu_series"), c("memory_rss_avg_mb").alias("_memory_series")
    )
    joined = merge_per_run(
        meta,
        summary,
        generator,
        exact_quantiles(samples, KEY, "latency_ms", LATENCY_QUANTILES, MS_WIDTH),
        _visibility(samples, ends),
        used,
        matrix.lag_per_run(lag),
    )
    at_cutoff = F.coalesce(c("visible_events_cutoff"), F.lit(0)) if fill_zero else c("visible_events_cutoff")
    # Two steps, not a chain of added columns: each step is analysed anew, over the whole plan.
    merged = joined.withColumns(
        {
            "generation_end_ms": ended,
            "visible_events_cutoff": at_cutoff,
            "generated_events": F.coalesce("_generated_summary", "_generated_generator"),
            "visible_events_final": F.coalesce("_visible_summary", "visible_events_final_latency"),
        }
    )
    derived = {
        "generated_eps_real": ratio_or_null("generated_events", "official_duration_s"),
        "visible_eps_cutoff": ratio_or_null("visible_events_cutoff", "official_duration_s"),
        "delivery_ratio_cutoff_pct": _percent("visible_events_cutoff", "generated_events"),
        "delivery_ratio_final_pct": _percent("visible_events_final", "generated_events"),
        "pending_visibility_events": at_least(c("generated_events") - c("visible_events_cutoff"), 0),
        "time_to_drain_s": at_least((c("last_visible_at_ms") - c("generation_end_ms")) / 1000, 0),
        "cpu_avg_cores": F.coalesce("_cpu_summary", "_cpu_series"),
        "memory_rss_avg_mb": F.coalesce("_memory_summary", "_memory_series"),
        "kafka_lag_real_available": F.coalesce("kafka_lag_real_available", F.lit(False)),
    }
    return merged.select(*[derived[n].alias(n) if n in derived else c(n) for n in OFFICIAL_COLUMNS])


def _percent(n: str, d: str) -> Column:
    return ratio_or_null(n, d) * 100.0


def _after_warmup(samples: DataFrame, generators: DataFrame, warmup_s: int) -> DataFrame:
    starts = generators.select(*KEY, F.col("generation_start_epoch_ms").alias("_start"))
    started = attach_per_run(samples, starts, how="left")
    warm = F.col("_start").isNull() | (F.col("produced_at") >= F.col("_start") + warmup_s * 1000)
    return started.where(warm).drop("_start")


# --- figures' data ------------------------------------------------------------------


def throughput_summary(metrics: DataFrame) -> DataFrame:
    """Generated and visible rates with their errors, beside the scenario's target."""
    columns = ["generated_eps_real", "visible_eps_cutoff", "delivery_ratio_cutoff_pct"]
    targets = F.create_map(*[F.lit(x) for pair in SCENARIO_TARGET_EPS.items() for x in pair])
    means = matrix.mean_sem(metrics, columns)
    return means.withColumn("target_eps", F.try_element_at(targets, F.col("scenario")))


def delivery_summary(metrics: DataFrame) -> DataFrame:
    return matrix.mean_sem(metrics, ["delivery_ratio_cutoff_pct", "delivery_ratio_final_pct"])


def backlog_summary(metrics: DataFrame) -> DataFrame:
    """Pending events at the cut-off, also in millions."""
    means = matrix.mean_sem(metrics, ["pending_visibility_events"])
    return means.withColumn(
        "pending_millions_mean", to_millions("pending_visibility_events_mean")
    ).withColumn("pending_millions_sem", to_millions("pending_visibility_events_sem"))


def drain_summary(metrics: DataFrame) -> DataFrame:
    return matrix.mean_sem(metrics, ["time_to_drain_s"])


def resource_summary(metrics: DataFrame) -> DataFrame:
    """Processor and memory use, memory also in GiB."""
    means = matrix.mean_sem(metrics, ["cpu_avg_cores", "memory_rss_avg_mb"])
    return means.withColumn("memory_rss_avg_gb_mean", mib_to_gib("memory_rss_avg_mb_mean")).withColumn(
        "memory_rss_avg_gb_sem", mib_to_gib("memory_rss_avg_mb_sem")
    )


def lag_summary(metrics: DataFrame, strategies=STRATEGIES, scenarios=SCENARIOS) -> DataFrame:
    """Mean of the runs' highest real lag; empty unless every expected pair has one."""
    pair = ["strategy", "scenario"]
    real = metrics.where(F.col("kafka_lag_max").isNotNull())
    measured = real.groupBy(*pair).agg(
        F.avg("kafka_lag_max").alias("kafka_lag_max"), F.bool_or("kafka_lag_real_available").alias("_real")
    )
    expected = matrix.expected_pairs(metrics.sparkSession, strategies, scenarios).join(measured, pair, "left")
    # One window over the pairs, a short list given by the caller.
    complete = F.bool_and(F.coalesce("_real", F.lit(False))).over(Window.partitionBy(F.lit(1)))
    return expected.withColumn("_complete", complete).where("_complete").select(*pair, "kafka_lag_max")


# --- per-run documents ----------------------------------------------------------------


def production_totals(log: DataFrame, payload: str = "payload") -> DataFrame:
    """Events, bytes, first and last time and rate of each run, counted from the log itself.

    Rates are over the run's own duration, at least one millisecond.
    """
    totals = log.groupBy(*KEY).agg(
        F.count("*").alias("generated_events"),
        F.sum(F.octet_length(payload)).cast("bigint").alias("generated_bytes"),
        F.min("produced_at").alias("generation_start_epoch_ms"),
        F.max("produced_at").alias("generation_end_epoch_ms"),
    )
    span = (F.col("generation_end_epoch_ms") - F.col("generation_start_epoch_ms")) / 1000
    return totals.withColumn("generation_duration_seconds", F.greatest(F.lit(0.001), span)).withColumn(
        "generated_eps_real", F.col("generated_events") / F.col("generation_duration_seconds")
    )


def run_summary(
    generators: DataFrame, visible: DataFrame, snapshot: DataFrame, metadata: DataFrame
) -> DataFrame:
    """Per-run summary document.

    ``visible``: run key and visible_events, counted in the sink. ``snapshot``: one column per
    metric. Both real rates are kept: over the run's own and over the official duration.
    """
    c = F.col
    own = ratio_or_zero("generated_events", "_duration")
    real_lag = F.coalesce(c("kafka_consumer_lag_real_present"), F.lit(0.0)) >= 1
    meta = metadata.select(
        *KEY, "target_eps", "official_duration_seconds", "processing_start_ts", "processing_end_ts"
    )
    joined = (
        generators.select(*KEY, "generated_events", "generation_duration_seconds", "generated_eps_real")
        .join(meta, KEY, "left")
        .join(visible.select(*KEY, "visible_events"), KEY, "left")
        .join(snapshot, KEY, "left")
    )
    official = F.when(c("official_duration_seconds") > 0, c("official_duration_seconds")).otherwise(1.0)
    duration = F.when(c("generation_duration_seconds") > 0, c("generation_duration_seconds"))
    rate = F.when(c("generated_eps_real") > 0, c("generated_eps_real")).otherwise(own)
    metric = lambda name: F.coalesce(c(name), F.lit(0.0)).alias(name)
    return (
        joined.withColumn("visible_events", F.coalesce("visible_events", F.lit(0)))
        .withColumn("official_duration_seconds", official)
        .withColumn("_duration", F.coalesce(duration, c("official_duration_seconds")))
        .select(
            *KEY,
            "target_eps",
            "generated_events",
            "visible_events",
            "official_duration_seconds",
            F.round("_duration", 3).alias("generation_duration_seconds"),
            F.round(rate, 3).alias("generated_eps_real"),
            F.round(own, 3).alias("generated_eps_actual"),
            F.round(ratio_or_zero("generated_events", "official_duration_seconds"), 3).alias(
                "generated_eps_official"
            ),
            F.round(c("visible_events") / c("official_duration_seconds"), 3).alias("visible_eps_equivalent"),
            F.round(ratio_or_zero("visible_events", "generated_events") * 100, 3).alias("delivery_ratio_pct"),
            metric("latency_p50_ms"),
            metric("latency_p95_ms"),
            metric("latency_p99_ms"),
            F.when(real_lag, c("kafka_consumer_lag")).alias("kafka_lag_max"),
            F.when(real_lag, c("kafka_consumer_lag")).alias("kafka_lag_mean"),
            real_lag.alias("kafka_lag_real_present"),
            F.coalesce(c("cpu_total_cores"), F.lit(0.0)).alias("cpu_cores_avg"),
            F.round(F.coalesce(c("mem_rss_bytes"), F.lit(0.0)) / 1048576.0, 3).alias("mem_rss_mb_avg"),
            F.greatest(F.lit(0.0), (c("processing_end_ts") - c("processing_start_ts")).cast("double")).alias(
                "processing_duration_seconds"
            ),
            F.greatest(F.lit(0), c("generated_events") - c("visible_events")).alias("estimated_backlog_events"),
        )
    )
