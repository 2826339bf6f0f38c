"""Metric samples over time: counter increases, averages over time, series selection, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.schemas import KEY, SNAPSHOT_METRICS

SLICE_S = 3600


def label_match(
    metric: str,
    equal: Mapping[str, str] | None = None,
    unequal: Mapping[str, str] | None = None,
    like: Mapping[str, str] | None = None,
) -> Column:
    """Condition on a sample's metric and labels. A missing label counts as the empty string, and a
    pattern must match the whole label."""

    def label(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("labels"), F.lit(name)), F.lit(""))

    keep = F.col("metric") == metric
    for name, value in (equal or {}).items():
        keep = keep & (label(name) == value)
    for name, value in (unequal or {}).items():
        keep = keep & (label(name) != value)
    for name, pattern in (like or {}).items():
        keep = keep & label(name).rlike(f"^(?:{pattern})$")
    return keep


def with_series(samples: DataFrame) -> DataFrame:
    """``series``: one text per metric and label set, whatever the labels' order in the map. What separates the
    parts is escaped inside them, so different label sets make different texts."""
    plain = lambda x: F.regexp_replace(x, r"([\\\\=,|])", r"\\$1")
    entries = F.array_sort(F.map_entries("labels"))
    text = F.transform(entries, lambda e: F.concat_ws("=", plain(e["key"]), plain(e["value"])))
    return samples.withColumn("series", F.concat_ws("|", plain(F.col("metric")), F.array_join(text, ",")))


def _step(now: Column, previous: Column) -> Column:
    """Growth of a counter between two samples; a lower value means it began again at 0."""
    return F.when(now < previous, now).otherwise(now - previous)


def counter_increase(
    samples: DataFrame,
    series: Sequence[str],
    at: str = "ts",
    value: str = "value",
    slice_s: int = SLICE_S,
) -> DataFrame:
    """Increase of each counter series over its samples, without extrapolation to window edges.

    Each series is cut into time slices: steps inside a slice are added up there, and the step into
    a slice comes from the slices' first and last values. So a long series is read by many tasks.
    Samples of a series must have distinct times.
    """
    series = list(series)
    sliced = samples.withColumn("_slice", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / slice_s))
    inner = Window.partitionBy(*series, "_slice").orderBy(at)
    outer = Window.partitionBy(*series).orderBy("_slice")
    steps = sliced.withColumn("_step", _step(F.col(value), F.lag(value).over(inner)))
    slices = steps.groupBy(*series, "_slice").agg(
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_inside"),
        F.min_by(value, at).alias("_first"),
        F.max_by(value, at).alias("_last"),
        F.count("*").alias("_samples"),
    )
    joined = slices.withColumn("_into", _step(F.col("_first"), F.lag("_last").over(outer)))
    return joined.groupBy(*series).agg(
        (F.sum("_inside") + F.coalesce(F.sum("_into"), F.lit(0.0))).alias("increase"),
        F.sum("_samples").alias("samples"),
    )


def increase_rate(increases: DataFrame, duration_s: float, by: Sequence[str] = ()) -> DataFrame:
    """Increases summed over series, per second."""
    total = F.coalesce(F.sum("increase"), F.lit(0.0)) / F.lit(float(duration_s))
    return increases.groupBy(*by).agg(total.alias("rate"))


def average_over_time(samples: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    """Mean of each series over its samples."""
    return samples.groupBy(*series).agg(F.avg(value).alias("average"))


def sum_of_averages(
    samples: DataFrame, series: Sequence[str], by: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Mean of each series over time, summed over series."""
    return average_over_time(samples, series, value).groupBy(*by).agg(F.sum("average").alias("total"))


def max_over_time(samples: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*series).agg(F.max(value).alias("maximum"))


def first_usable(*candidates: Column) -> Column:
    """First candidate that is neither missing nor 0; 0 when none is."""
    usable = [F.when(F.isnan(c) | (c == 0), None).otherwise(c) for c in candidates]
    return F.coalesce(*usable, F.lit(0.0))


def pivot_snapshot(
    snapshot: DataFrame, order: str = "line", keys: Sequence[str] = KEY, metrics: Sequence[str] = SNAPSHOT_METRICS
) -> DataFrame:
    """One column per metric. The last line of a metric counts, an unreadable or missing value is 0."""

    def latest(metric: str) -> Column:
        own = F.col("metric") == metric
        line = F.when(own, F.col(order))
        picked = F.max_by(F.coalesce("value", F.lit(0.0)), line)
        return F.coalesce(picked, F.lit(0.0)).alias(metric)

    return snapshot.groupBy(*keys).agg(*[latest(m) for m in metrics])
