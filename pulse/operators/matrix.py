"""The experiment as a grid of runs: what is expected, present, missing; simple run-level reductions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.schemas import (
    EVENT_BYTES_RANGE,
    KEY,
    OFFICIAL_DURATION_S,
    REAL_LAG_SOURCE,
    REQUIRED_ARTIFACTS,
    SCENARIO_TARGET_EPS,
    SCENARIOS,
    STRATEGIES,
)


def _column(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


def expected_pairs(
    spark: SparkSession, strategies: Sequence[str] = STRATEGIES, scenarios: Sequence[str] = SCENARIOS
) -> DataFrame:
    """Every strategy with every scenario; both are short lists given by the caller."""
    pairs = [(a, b) for a in strategies for b in scenarios]
    return spark.createDataFrame(pairs, "strategy STRING, scenario STRING")


def expected_runs(
    spark: SparkSession,
    repetitions: int,
    strategies: Sequence[str] = STRATEGIES,
    scenarios: Sequence[str] = SCENARIOS,
) -> DataFrame:
    """The run matrix: pairs times repetitions."""
    pairs = expected_pairs(spark, strategies, scenarios)
    numbers = F.sequence(F.lit(1), F.lit(repetitions))
    names = F.transform(numbers, lambda n: F.concat(F.lit("run_"), n.cast("string")))
    return pairs.withColumn("run_id", F.explode(names))


def missing(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.join(actual.select(*on).distinct(), list(on), "left_anti")


def missing_artifacts(
    runs: DataFrame, inventory: DataFrame, required: Sequence[str] = REQUIRED_ARTIFACTS
) -> DataFrame:
    """Artifact kinds that a run should have and has not."""
    wanted = F.explode(F.array(*[F.lit(kind) for kind in required]))
    checks = runs.select(*KEY).distinct().withColumn("artifact", wanted)
    return missing(checks, inventory, [*KEY, "artifact"])


def all_run_keys(*tables: DataFrame) -> DataFrame:
    """Run keys found in any of the tables. Each is reduced to its keys before the union."""
    keys = [t.select(*KEY).distinct() for t in tables]
    union = keys[0]
    for other in keys[1:]:
        union = union.unionByName(other)
    return union.distinct()


def union_all(*tables: DataFrame) -> DataFrame:
    """Tables of one meaning under each other; columns a table lacks are null."""
    union = tables[0]
    for other in tables[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    return union


def rows_per_label(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))


def real_lag() -> Column:
    return F.col("lag_source") == REAL_LAG_SOURCE


def lag_per_run(lag: DataFrame) -> DataFrame:
    """Highest real lag of each run, and whether it has any."""
    real = F.coalesce(real_lag(), F.lit(False))
    return lag.groupBy(*KEY).agg(
        F.max(F.when(real, F.col("lag"))).alias("kafka_lag_max"),
        F.bool_or(real).alias("kafka_lag_real_available"),
    )


def lag_coverage(spark: SparkSession, lag: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """Whether each known strategy has any real lag measurement."""
    seen = lag.groupBy("strategy").agg(F.bool_or(real_lag()).alias("_seen"))
    known = _column(spark, "strategy", strategies)
    return known.join(seen, "strategy", "left").select(
        "strategy", F.coalesce("_seen", F.lit(False)).alias("covered")
    )


def resources_per_run(resources: DataFrame) -> DataFrame:
    """Mean processor and memory use of each run."""
    return resources.groupBy(*KEY).agg(
        F.avg("cpu_cores").alias("cpu_avg_cores"),
        F.avg(F.col("mem_rss_bytes") / 1048576.0).alias("memory_rss_avg_mb"),
    )


_REDUCTIONS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median, "count": F.count}


def reduce_by(
    df: DataFrame, reductions: Mapping[str, str], by: Sequence[str] = ("strategy", "scenario")
) -> DataFrame:
    """Named reductions of columns by group; the column keeps its name."""
    return df.groupBy(*by).agg(*[_REDUCTIONS[how](c).alias(c) for c, how in reductions.items()])


def mean_sem(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("strategy", "scenario")):
    """Mean and standard error. One value has error 0; no value has mean null and error 0."""
    out = []
    for c in columns:
        n = F.count(c)
        error = F.when(n > 1, F.stddev_samp(c) / F.sqrt(n)).otherwise(0.0)
        out += [F.avg(c).alias(f"{c}_mean"), error.alias(f"{c}_sem")]
    return df.groupBy(*by).agg(*out)


def modal_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value of each group, the smallest of those equally frequent."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    rank = F.struct(F.col("_n"), -F.col(value))
    return counts.groupBy(*by).agg(F.max_by(value, rank).alias(value))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Different values of each column, nulls left out.

    Each column is grouped for itself, over a scan of that column alone. One aggregate over all of them would first write
    every row once for each column, as wide as all columns. A frame that is dear to compute is best written before.
    """
    values = [df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*").alias(c)) for c in columns]
    return union_all(*values).agg(*[F.max(c).alias(c) for c in columns])


def any_row(df: DataFrame, condition: Column) -> DataFrame:
    """Whether any row violates, and how many do."""
    bad = F.count_if(condition)
    return df.agg((bad > 0).alias("violated"), bad.alias("rows"))


def coefficient_of_variation(value: str) -> Column:
    """In percent; 0 where the mean is not above 0."""
    mean = F.avg(value)
    return F.when(mean > 0, F.stddev_samp(value) / mean * 100).otherwise(0.0)


def volume_budget(spark: SparkSession, runs: int = 1, duration_s: int = OFFICIAL_DURATION_S) -> DataFrame:
    """Events and bytes each official scenario may use: target rate times duration, and the largest
    size an event is reckoned with."""
    events = [(scenario, runs * eps * duration_s) for scenario, eps in SCENARIO_TARGET_EPS.items()]
    rows = [(scenario, n, n * EVENT_BYTES_RANGE[1]) for scenario, n in events]
    return spark.createDataFrame(rows, "scenario STRING, budget_events BIGINT, budget_bytes BIGINT")


def payload_volume(df: DataFrame, budget: DataFrame, payload: str = "payload", by=("scenario",)) -> DataFrame:
    """Events and payload bytes by group beside the group's budget (budget_events, budget_bytes)."""
    used = df.groupBy(*by).agg(
        F.count("*").alias("events"),
        F.sum(F.octet_length(payload)).cast("bigint").alias("bytes"),
    )
    return used.join(budget, list(by), "left").withColumn(
        "within_budget",
        (F.col("events") <= F.col("budget_events")) & (F.col("bytes") <= F.col("budget_bytes")),
    )
