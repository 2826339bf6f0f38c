"""Per-second timelines of a run: produced, visible, latency, backlog, and when it came to rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions.columns import at_least, bucket, elapsed_s, is_advanced, is_plausible_ms
from pulse.operators.keys import attach_per_run, keep_runs
from pulse.operators.order_stats import MS_WIDTH, quantiles_of_counts
from pulse.operators.scan import BLOCK, block_carry, running, with_block, within
from pulse.schemas import KEY, LOAD_PROFILES, PLAUSIBLE_FROM_MS, PLAUSIBLE_TO_MS, PROFILE_PERIOD_S

_UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


_BLOCK_S = 3600

#: A time further from its run's origin than all plausible times are from one another belongs to no axis.
AXIS_S = (PLAUSIBLE_TO_MS - PLAUSIBLE_FROM_MS) // 1000


def _every_second(runs: DataFrame, last: Column) -> DataFrame:
    """One row per second from 0 to ``last``, by way of hours: no array is longer than an hour,
    even where a wrong clock stretches a run over years."""
    last = last.cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor(last / _BLOCK_S))
    hours = runs.withColumn("_block", F.explode(F.when(last >= 0, blocks)))
    first = F.col("_block") * _BLOCK_S
    seconds = F.sequence(first, F.least(last, first + (_BLOCK_S - 1)))
    return hours.withColumn("elapsed_s", F.explode(seconds)).drop("_block")


# --- load profiles ----------------------------------------------------------------


def profile_segments(spark: SparkSession) -> DataFrame:
    rows = [(name, *segment) for name, segments in LOAD_PROFILES.items() for segment in segments]
    ddl = "profile STRING, start_s INT, end_s INT, start_rate DOUBLE, end_rate DOUBLE"
    return spark.createDataFrame([(p, a, b, float(x), float(y)) for p, a, b, x, y in rows], ddl)


def target_rates(seconds: DataFrame, profile="load_profile", fallback="fallback_rate") -> DataFrame:
    """``target_rate`` of each elapsed second under its run's load profile.

    Ramps interpolate and drop the fraction. A constant or unknown profile, and seconds outside
    every segment, have the fallback rate. The segments are a fixed table of 13 rows, hence the
    broadcast.
    """
    period = F.create_map(*[F.lit(x) for pair in PROFILE_PERIOD_S.items() for x in pair])
    wrap = F.try_element_at(period, F.col(profile))
    at = F.when(wrap.isNotNull(), F.pmod(F.col("elapsed_s"), wrap)).otherwise(F.col("elapsed_s"))
    timed = seconds.withColumn("_at", at)
    segments = F.broadcast(profile_segments(seconds.sparkSession))
    hit = (
        (F.col(profile) == F.col("profile"))
        & (F.col("_at") >= F.col("start_s"))
        & (F.col("_at") < F.col("end_s"))
    )
    progress = (F.col("_at") - F.col("start_s")) / (F.col("end_s") - F.col("start_s"))
    rate = F.floor(F.col("start_rate") + progress * (F.col("end_rate") - F.col("start_rate")))
    joined = timed.join(segments, hit, "left")
    return joined.withColumn(
        "target_rate", F.coalesce(rate.cast("double"), F.col(fallback).cast("double"))
    ).select(*seconds.columns, "target_rate")


def rate_timeline(runs: DataFrame, duration: Column | str = "duration_s") -> DataFrame:
    """One row per second of each run, with its target rate."""
    duration = F.col(duration) if isinstance(duration, str) else duration
    return target_rates(_every_second(runs, duration - 1))


def peak_rates(runs: DataFrame, profile="load_profile", fallback="fallback_rate") -> DataFrame:
    """Highest rate each run's profile can ask for."""
    peaks = profile_segments(runs.sparkSession).groupBy(F.col("profile").alias("_profile")).agg(
        F.max(F.greatest("start_rate", "end_rate")).alias("_peak")
    )
    joined = runs.join(F.broadcast(peaks), F.col(profile) == F.col("_profile"), "left")
    peak = F.coalesce(F.col("_peak"), F.col(fallback).cast("double"))
    return joined.withColumn("peak_rate", peak).drop("_profile", "_peak")


# --- the four series ----------------------------------------------------------------


def profile_runs(generators: DataFrame, metadata: DataFrame, advanced_only: bool = False) -> DataFrame:
    """What the timelines need of each run: whole duration, generated events, profile, fallback rate.

    A run without a duration of its own has the official one. ``advanced_only`` keeps runs of
    scenarios whose rate changes.
    """
    joined = generators.select(
        *KEY, "generation_duration_seconds", "generated_events", "load_profile"
    ).join(metadata.select(*KEY, "official_duration_seconds", "target_eps"), KEY, "left")
    if advanced_only:
        joined = joined.where(is_advanced("scenario"))
    own = F.round("generation_duration_seconds").cast("int")
    official = F.round("official_duration_seconds").cast("int")
    return joined.select(
        *KEY,
        F.when(own > 0, own).otherwise(official).alias("duration_s"),
        "generated_events",
        "load_profile",
        F.coalesce("target_eps", F.lit(0)).alias("fallback_rate"),
    )


def run_timelines(samples: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The four series of runs given as by ``profile_runs``; samples of other runs are left out."""
    own = keep_runs(samples, runs)
    produced, visible = produced_timeline(runs), visibility_timeline(own, runs)
    return {
        "produced": produced,
        "visible": visible,
        "latency": latency_timeseries(own),
        "backlog": backlog_timeline(visible, produced, runs),
    }


def produced_timeline(runs: DataFrame) -> DataFrame:
    """The target curve scaled so that it adds up to the events really generated.

    ``runs``: run key, duration_s, generated_events, load_profile, fallback_rate.
    """
    rates = rate_timeline(runs.select(*KEY, "duration_s", "generated_events", "load_profile", "fallback_rate"))
    blocked = with_block(rates, "elapsed_s", _BLOCK_S)
    carried = block_carry(blocked, KEY, "elapsed_s", {"_asked": F.col("target_rate")})
    scale = F.when(F.col("_asked_total") > 0, F.col("generated_events") / F.col("_asked_total")).otherwise(0.0)
    produced = blocked.join(carried, [*KEY, BLOCK]).withColumn("produced_count_window", F.col("target_rate") * scale)
    here = F.sum("produced_count_window").over(within(KEY, "elapsed_s").rowsBetween(*_UP_TO_NOW))
    return produced.withColumn("cumulative_produced", F.col("_asked") * scale + here).select(
        *KEY,
        "elapsed_s",
        "target_rate",
        "produced_count_window",
        F.col("produced_count_window").alias("produced_eps"),
        "cumulative_produced",
    )


def run_origins(samples: DataFrame) -> DataFrame:
    """First production time of each run. Times that no right clock gives count only in a run that has no others."""
    at = F.col("produced_at")
    first = F.coalesce(F.min(F.when(is_plausible_ms(at), at)), F.min(at))
    return samples.groupBy(*KEY).agg(first.alias("start_ms"))


def elapsed_counts(samples: DataFrame, at: str = "visible_at", origins: DataFrame | None = None) -> DataFrame:
    """Events by second since the run's origin. Rows are counted by millisecond before the join."""
    origins = origins if origins is not None else run_origins(samples)
    by_ms = samples.where(F.col(at).isNotNull()).groupBy(*KEY, at).agg(F.count("*").alias("_n"))
    timed = attach_per_run(by_ms, origins).withColumn("elapsed_s", elapsed_s(at, "start_ms"))
    return timed.groupBy(*KEY, "elapsed_s").agg(F.sum("_n").alias("events"))


def off_axis(counts: DataFrame) -> DataFrame:
    """Events by run that no axis has a place for: visible before the run's origin, and later than any plausible time could be."""
    early, late = F.col("elapsed_s") < 0, F.col("elapsed_s") > AXIS_S
    return counts.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(early, F.col("events"))), F.lit(0)).alias("before_origin"),
        F.coalesce(F.sum(F.when(late, F.col("events"))), F.lit(0)).alias("beyond_axis"),
        F.coalesce(F.sum(F.when(~early & ~late, F.col("events"))), F.lit(0)).alias("on_axis"),
    )


def visible_intervals(counts: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The visibility timeline with its gaps as intervals: ``visible_count_window`` events at ``elapsed_s``, none from the next second
    to ``until_s``, and their running total. A run has a row for each second with events, whatever lies between them.

    ``counts`` as by ``elapsed_counts``; times that ``off_axis`` counts are left out. ``runs`` extends as in ``visibility_timeline``.
    """
    seen = counts.where(F.col("elapsed_s").between(0, AXIS_S)).select(*KEY, "elapsed_s", "events")
    # The axis begins at 0, and a run with events off it alone still has its origin.
    origins = counts.select(*KEY).distinct().select(*KEY, F.lit(0).cast("bigint").alias("elapsed_s"), F.lit(0).cast("bigint").alias("events"))
    steps = seen.unionAll(origins).groupBy(*KEY, "elapsed_s").agg(F.sum("events").alias("visible_count_window"))
    blocked = with_block(steps, "elapsed_s", _BLOCK_S)
    carried = block_carry(
        blocked, KEY, "elapsed_s", {"_seen": F.col("visible_count_window")}, nexts={"_next": F.col("elapsed_s")}
    )
    order = within(KEY, "elapsed_s")
    inside = {
        "_here": F.sum("visible_count_window").over(order.rowsBetween(*_UP_TO_NOW)),
        "_after": F.lead("elapsed_s").over(order),
    }
    joined = blocked.withColumns(inside).join(carried, [*KEY, BLOCK])
    until = F.coalesce("_after", "_next") - 1
    if runs is None:
        until = F.coalesce(until, F.col("elapsed_s"))
    else:
        joined = joined.join(runs.select(*KEY, "duration_s"), KEY, "left")
        until = F.coalesce(until, F.greatest("elapsed_s", F.col("duration_s").cast("bigint")))
    total = F.col("_seen") + F.col("_here")
    return joined.select(*KEY, "elapsed_s", until.alias("until_s"), "visible_count_window", total.alias("cumulative_visible"))


def every_second(intervals: DataFrame) -> DataFrame:
    """Intervals written out: a row for each second. Long ones go by hours, so that no array is longer than an hour."""
    first, last = F.col("elapsed_s"), F.col("until_s")
    hours = intervals.withColumn("_from", F.explode(F.sequence(first, last, F.lit(_BLOCK_S).cast("bigint"))))
    seconds = F.sequence("_from", F.least(last, F.col("_from") + (_BLOCK_S - 1)))
    each = hours.withColumn("_second", F.explode(seconds))
    window = F.when(F.col("_second") == first, F.col("visible_count_window")).otherwise(F.lit(0))
    return each.select(*KEY, F.col("_second").alias("elapsed_s"), window.alias("visible_count_window"), "cumulative_visible")


def visibility_timeline(samples: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Visible events of every second up to the last one, none left out, and their running total.

    ``runs`` (run key, duration_s) extends each timeline to at least the run's duration. Seconds before the origin and
    implausibly far after it, which a wrong clock can give, do not belong to the axis; ``off_axis`` counts them.
    """
    dense = every_second(visible_intervals(elapsed_counts(samples), runs))
    return dense.select(
        *KEY, "elapsed_s", "visible_count_window", F.col("visible_count_window").alias("visible_eps"), "cumulative_visible"
    )


def latency_timeseries(samples: DataFrame, width_s: int = 10) -> DataFrame:
    """p50, p95 and p99 by bucket of production time."""
    alike = samples.where(F.col("latency_ms").isNotNull()).groupBy(*KEY, "produced_at", "latency_ms")
    timed = attach_per_run(alike.agg(F.count("*").alias("_n")), run_origins(samples))
    second = elapsed_s("produced_at", "start_ms")
    counts = (
        timed.withColumn("bucket_start_s", bucket(second, width_s))
        .groupBy(*KEY, "bucket_start_s", "latency_ms")
        .agg(F.sum("_n").alias("n"))
    )
    probs = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
    series = quantiles_of_counts(counts, [*KEY, "bucket_start_s"], "latency_ms", probs, width=MS_WIDTH)
    return series.withColumn("bucket_end_s", F.col("bucket_start_s") + width_s)


def backlog_timeline(visible: DataFrame, produced: DataFrame, runs: DataFrame) -> DataFrame:
    """Events produced so far but not visible yet, at every second of the visibility timeline.

    After the last produced second the produced total stays; before the first it is 0. It is never
    above the run's generated events, and the backlog never below 0.
    """
    steps = visible.select(*KEY, "elapsed_s", "cumulative_visible").join(
        produced.select(*KEY, "elapsed_s", "cumulative_produced"), [*KEY, "elapsed_s"], "left"
    )
    filled = running(steps, KEY, "elapsed_s", _BLOCK_S, fills={"cumulative_produced": "cumulative_produced"})
    limited = filled.withColumn("cumulative_produced", F.coalesce("cumulative_produced", F.lit(0.0))).join(
        runs.select(*KEY, "generated_events"), KEY, "left"
    )
    return limited.withColumn(
        "cumulative_produced", F.least("cumulative_produced", F.col("generated_events").cast("double"))
    ).select(
        *KEY,
        "elapsed_s",
        "cumulative_produced",
        "cumulative_visible",
        at_least(F.col("cumulative_produced") - F.col("cumulative_visible"), 0).alias(
            "observable_backlog"
        ),
    )


def window_means(df: DataFrame, columns: Sequence[str], width_s: int = 5) -> DataFrame:
    """Mean of rate columns in fixed windows of elapsed time."""
    start = bucket("elapsed_s", width_s)
    return (
        df.withColumn("_start", start)
        .groupBy(*KEY, "_start")
        .agg(*[F.avg(c).alias(c) for c in columns])
        .withColumnRenamed("_start", "elapsed_s")
    )


def response_series(produced: DataFrame, visible: DataFrame, width_s: int = 5) -> DataFrame:
    """Target, produced and visible rates side by side, by window."""
    asked = window_means(produced, ["target_rate", "produced_eps"], width_s)
    seen = window_means(visible, ["visible_eps"], width_s)
    return asked.join(seen, [*KEY, "elapsed_s"], "full")


# --- rest ------------------------------------------------------------------------------


def quiescence(
    polls: DataFrame, stable: int = 3, count: str = "visible_events", at: str = "t",
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """First poll at which the count has stayed the same ``stable`` polls in a row.

    Null where no poll gets there: waiting would have ended by its time limit.
    """
    in_order = Window.partitionBy(*keys).orderBy(at)
    same = F.col(count) == F.lag(count).over(in_order)
    islands = polls.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn(
        "_island", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(in_order)
    )
    within = Window.partitionBy(*keys, "_island").orderBy(at).rowsBetween(*_UP_TO_NOW)
    runs = islands.withColumn("_streak", F.sum(F.col("_same").cast("int")).over(within))
    return runs.groupBy(*keys).agg(
        F.min(F.when(F.col("_streak") >= stable, F.col(at))).alias("quiet_at"),
        F.count("*").alias("polls"),
    )


def drain_point(progress: DataFrame, stable: int = 3, keys: Sequence[str] = KEY) -> DataFrame:
    """First batch that closes ``stable`` empty batches in a row.

    A batch reported again, which an idle query does, counts once.
    """
    once = progress.groupBy(*keys, "batch_id").agg(
        F.max("num_input_rows").alias("num_input_rows"), F.min("ts").alias("ts")
    )
    in_order = Window.partitionBy(*keys).orderBy("batch_id")
    busy = F.sum(F.when(F.col("num_input_rows") > 0, 1).otherwise(0)).over(in_order)
    streak = F.sum(F.when(F.col("num_input_rows") == 0, 1).otherwise(0)).over(
        Window.partitionBy(*keys, "_busy").orderBy("batch_id")
    )
    idle = once.withColumn("_busy", busy).withColumn("_streak", streak)
    reached = F.col("_streak") >= stable
    return idle.groupBy(*keys).agg(
        F.min(F.when(reached, F.col("batch_id"))).alias("drained_batch"),
        F.min(F.when(reached, F.col("ts"))).alias("drained_at"),
    )
