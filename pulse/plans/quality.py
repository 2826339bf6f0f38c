"""Data-quality rules. Each group of rules is one aggregate over its table, unpivoted to rows.

A row is (check, passed, severity, message, observed). A rule about nothing, such as one on an empty
table, gives no row; only the existence rules report absence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.columns import in_scope, lenient_double
from pulse.operators import matrix
from pulse.operators.order_stats import LATENCY_QUANTILES, MS_WIDTH, exact_quantiles
from pulse.schemas import (
    EXTREME_LATENCY_MS,
    KEY,
    OFFICIAL_DURATION_S,
    PLAUSIBLE_FROM_MS,
    PLAUSIBLE_TO_MS,
    REQUIRED_ARTIFACTS,
    SCENARIO_TARGET_EPS,
)

COLUMNS = ["check", "passed", "severity", "message", "observed"]
ERROR, WARNING, INFO = "error", "warning", "info"


@dataclass(frozen=True)
class Rule:
    """One rule over an aggregate row: when it holds, how serious a failure is, what was seen."""

    check: str | Column
    severity: str | Column
    holds: Column
    observed: Column
    message: str
    applies: Column | None = None


def _rows(aggregate: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    def struct(rule: Rule) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        row = F.struct(
            text(rule.check).alias("check"),
            F.coalesce(rule.holds, F.lit(False)).alias("passed"),
            text(rule.severity).alias("severity"),
            F.lit(rule.message).alias("message"),
            rule.observed.cast("double").alias("observed"),
        )
        return row if rule.applies is None else F.when(rule.applies, row)

    kept = F.array_compact(F.array(*[struct(r) for r in rules]))
    return aggregate.select(F.inline(kept))


def _is_zero(check: str, severity: str, count: str, message: str, applies: Column | None = None) -> Rule:
    return Rule(check, severity, F.col(count) == 0, F.col(count), message, applies)


# --- samples --------------------------------------------------------------------------


def sample_counters(samples: DataFrame) -> DataFrame:
    """Exact counters by strategy, in one pass. Number columns may be text."""
    latency, produced, visible = (lenient_double(c) for c in ("latency_ms", "produced_at", "visible_at"))
    outside = lambda x: (x < PLAUSIBLE_FROM_MS) | (x > PLAUSIBLE_TO_MS)
    return samples.select(
        "strategy", latency.alias("latency"), produced.alias("produced"), visible.alias("visible"),
    ).groupBy("strategy").agg(
        F.count("latency").alias("rows"),
        F.count_if(F.col("latency").isNull()).alias("unparsable"),
        F.count_if(F.col("latency") < 0).alias("negative"),
        F.count_if(F.col("latency") == 0).alias("zero"),
        F.count_if(F.col("latency") > EXTREME_LATENCY_MS).alias("extreme"),
        F.count_if(F.col("latency").isNotNull() & (F.col("visible") < F.col("produced"))).alias("backwards"),
        F.count_if(
            F.col("latency").isNotNull() & (outside(F.col("produced")) | outside(F.col("visible")))
        ).alias("implausible"),
        matrix.coefficient_of_variation("latency").alias("cv_pct"),
    )


def sample_checks(samples: DataFrame) -> DataFrame:
    """Existence, signs, sizes and times of the samples; all strategies together."""
    names = ["rows", "unparsable", "negative", "zero", "extreme", "backwards", "implausible"]
    counters = sample_counters(_with_columns(samples, ["latency_ms", "produced_at", "visible_at", "strategy"]))
    totals = counters.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    some = F.col("rows") > 0
    has_times = {"produced_at", "visible_at"} <= set(samples.columns)
    absent = [c for c in ("latency_ms", "strategy", "scenario") if c not in samples.columns]
    share = lambda n: F.col(n) / F.col("rows") * 100
    rules = [
        Rule("V13", ERROR, some, F.col("rows"), "latency samples exist"),
        _is_zero("V14", ERROR, "negative", "no negative latency", some),
        Rule("V15", WARNING, share("extreme") < 1.0, F.col("extreme"), "under 1 % above 5 minutes", some),
        Rule("V16", WARNING, share("zero") < 5.0, F.col("zero"), "under 5 % zero latencies", some),
        Rule("V17", ERROR, F.lit(not absent), F.lit(len(absent)), "required columns exist", F.lit(True) if absent else some),
        _is_zero("V18", ERROR, "unparsable", "no unreadable latency", some),
        Rule("V24", WARNING, F.lit(has_times), F.lit(int(has_times)), "time columns exist", some if has_times else F.lit(True)),
    ]
    if has_times:
        rules += [
            _is_zero("V25", ERROR, "backwards", "visible not before produced", some),
            _is_zero("V26", WARNING, "implausible", "times within 2020-2030", some),
        ]
    return _rows(totals, rules)


def _with_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def strategy_checks(samples: DataFrame) -> DataFrame:
    """Sample size, percentile order and spread of each strategy."""
    typed = samples.withColumn("latency_ms", lenient_double("latency_ms")).where(F.col("latency_ms").isNotNull())
    figures = sample_counters(samples).join(
        exact_quantiles(typed, ["strategy"], "latency_ms", LATENCY_QUANTILES, MS_WIDTH), "strategy"
    )
    named = lambda check: F.concat(F.lit(check + ":"), F.col("strategy"))
    enough = F.col("rows") >= 10
    c = F.col
    return _rows(
        figures,
        [
            Rule(named("V19"), WARNING, c("rows") >= 100, c("rows"), "at least 100 samples"),
            Rule(
                named("V20"), ERROR,
                (c("latency_p50_ms") <= c("latency_p95_ms")) & (c("latency_p95_ms") <= c("latency_p99_ms")),
                c("latency_p50_ms"), "p50 <= p95 <= p99", enough,
            ),
            Rule(named("V21"), WARNING, c("cv_pct") < 500, F.round("cv_pct", 6), "variation under 500 %", enough),
        ],
    )


def expectation_checks(samples: DataFrame) -> DataFrame:
    """Lower median latency than batch, where both strategies have samples."""
    typed = samples.withColumn("latency_ms", lenient_double("latency_ms"))
    medians = exact_quantiles(typed, ["strategy"], "latency_ms", {"median": 0.5}, MS_WIDTH)
    of = lambda s: F.max(F.when(F.col("strategy") == s, F.col("median"))).alias(s)
    row = medians.agg(of("batch"), of("microbatch"), of("streaming"))
    rules = [
        Rule(
            check, WARNING, F.col(other) < F.col("batch"), F.col("batch") - F.col(other),
            f"{other} median below batch", F.col(other).isNotNull() & F.col("batch").isNotNull(),
        )
        for check, other in (("V22", "streaming"), ("V23", "microbatch"))
    ]
    return _rows(row, rules)


def sample_count_checks(samples: DataFrame, runs: DataFrame, lines: int = 10) -> DataFrame:
    """Enough lines in each run's sample file; the header is one of them."""
    counts = samples.groupBy(*KEY).agg(F.count("*").alias("_n"))
    short = runs.select(*KEY).distinct().join(counts, KEY, "left").agg(
        F.count_if(F.coalesce("_n", F.lit(0)) + 1 < lines).alias("short")
    )
    return _rows(short, [_is_zero("V30", WARNING, "short", f"every run has {lines} lines")])


# --- runs -------------------------------------------------------------------------------


def artifact_checks(
    runs: DataFrame, inventory: DataFrame, required: Sequence[str] = REQUIRED_ARTIFACTS
) -> DataFrame:
    gaps = matrix.missing_artifacts(runs, inventory, required).agg(F.count("*").alias("gaps"))
    return _rows(gaps, [_is_zero("V1", WARNING, "gaps", "every run has its artifacts")])


def summary_checks(summaries: DataFrame, run_stats: DataFrame | None = None) -> DataFrame:
    """Consistency of the run summaries; with ``run_stats``, also with the samples."""
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    joined = summaries
    counted = F.lit(None).cast("bigint")
    if run_stats is not None:
        joined = summaries.join(run_stats.select(*KEY, "latency_rows"), KEY, "left")
        counted = F.count_if(zero("visible_events") != zero("latency_rows"))
    drift = F.abs(c("generation_duration_seconds") - c("official_duration_seconds"))
    row = joined.agg(
        F.count("*").alias("runs"),
        F.count_if(zero("visible_events") > zero("generated_events")).alias("excess"),
        F.count_if((c("delivery_ratio_pct") < 0) | (c("delivery_ratio_pct") > 100)).alias("ratio"),
        counted.alias("unequal"),
        F.count_if(drift > 1.0).alias("drift"),
        F.count_if((c("target_eps") > 0) & (c("generated_eps_real") / c("target_eps") < 0.70)).alias("slow"),
    )
    some = c("runs") > 0
    return _rows(
        row,
        [
            _is_zero("V2", ERROR, "excess", "visible events within generated events", some),
            _is_zero("V3", ERROR, "ratio", "delivery ratio within 0-100", some),
            _is_zero("V4", ERROR, "unequal", "visible events equal exported samples", some & c("unequal").isNotNull()),
            _is_zero("V6", ERROR, "drift", "generation lasts the official duration", some),
            _is_zero("V8", WARNING, "slow", "real rate at least 70 % of target", some),
        ],
    )


def metadata_checks(metadata: DataFrame) -> DataFrame:
    """One duration, and that the official one; one commit; each scenario's own target."""
    c = F.col
    row = metadata.agg(
        F.count("*").alias("runs"),
        F.count_distinct("official_duration_seconds").alias("durations"),
        F.min("official_duration_seconds").alias("shortest"),
        F.count_distinct("git_commit").alias("commits"),
    )
    uniform = c("durations") == 1
    some = c("runs") > 0
    general = _rows(
        row,
        [
            Rule(
                "V5", F.when(uniform, WARNING).otherwise(ERROR),
                uniform & (F.floor("shortest") == OFFICIAL_DURATION_S), c("durations"),
                "one official duration of 300 s", some,
            ),
            Rule("V12", WARNING, c("commits") <= 1, c("commits"), "one commit", some),
        ],
    )
    targets = F.create_map(*[F.lit(x) for pair in SCENARIO_TARGET_EPS.items() for x in pair])
    own = F.try_element_at(targets, c("scenario"))
    modal = matrix.modal_value(metadata, ["scenario"], "target_eps")
    present = metadata.select("scenario").distinct().join(modal, "scenario", "left").where(own.isNotNull())
    wrong = present.agg(F.count_if(~F.coalesce(F.round("target_eps") == own, F.lit(False))).alias("wrong"))
    return general.unionByName(
        _rows(wrong, [_is_zero("V7", WARNING, "wrong", "modal target of each official scenario")])
    )


def latency_sign_checks(run_stats: DataFrame) -> DataFrame:
    row = run_stats.agg(
        F.count("*").alias("runs"), F.count_if(F.col("latency_non_positive_count") > 0).alias("bad")
    )
    return _rows(row, [_is_zero("V10", ERROR, "bad", "all latencies positive", F.col("runs") > 0)])


def lag_checks(lag: DataFrame) -> DataFrame:
    covered = matrix.lag_coverage(lag.sparkSession, lag)
    row = covered.agg(F.count_if(~F.col("covered")).alias("uncovered"))
    return _rows(row, [_is_zero("V9", WARNING, "uncovered", "real lag for every strategy")])


def run_id_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Each table has rows with a run id. Each is looked at by an aggregate of its own."""
    seen = None
    for name, table in tables.items():
        n = F.count("run_id") if "run_id" in table.columns else F.lit(0)
        one = table.agg(n.alias("rows")).withColumn("table", F.lit(name))
        seen = one if seen is None else seen.unionByName(one)
    row = seen.agg(F.count_if(F.col("rows") == 0).alias("without"))
    return _rows(row, [_is_zero("V11", ERROR, "without", "run id in every table")])


def generator_checks(runs: DataFrame, generators: DataFrame) -> DataFrame:
    gaps = matrix.missing(runs.select(*KEY).distinct(), generators, KEY).agg(F.count("*").alias("gaps"))
    return _rows(gaps, [_is_zero("V31", ERROR, "gaps", "generator summary for every run")])


def scope_checks(runs: DataFrame, scope: str = "official") -> DataFrame:
    row = runs.select(*KEY).distinct().agg(F.count_if(~in_scope("scenario", scope)).alias("foreign"))
    return _rows(row, [_is_zero("V32", WARNING, "foreign", "only scenarios of the scope")])


# --- telemetry and clocks ------------------------------------------------------------------


def snapshot_checks(snapshot: DataFrame) -> DataFrame:
    """Snapshots exist, and each has a processor and a memory metric."""
    metric = F.lower("metric")
    per_run = snapshot.groupBy(*KEY).agg(
        F.bool_or(metric.contains("cpu")).alias("cpu"), F.bool_or(metric.contains("mem")).alias("mem")
    )
    row = per_run.agg(F.count("*").alias("runs"), F.count_if(~(F.col("cpu") & F.col("mem"))).alias("bare"))
    exists = Rule("V27", INFO, F.col("runs") > 0, F.col("runs"), "snapshots exist")
    complete = _is_zero("V28", WARNING, "bare", "snapshots have cpu and mem", F.col("runs") > 0)
    return _rows(row, [exists, complete])


def clock_status(offsets: DataFrame, threshold_ms: int = 5) -> DataFrame:
    """Rounded offset of each node and whether it is within the threshold; unknown is not."""
    rounded = F.round(F.abs(lenient_double("offset_ms"))).cast("bigint")
    within = F.coalesce(rounded <= threshold_ms, F.lit(False))
    return offsets.select(
        "node", rounded.alias("offset_rounded_ms"), F.when(within, "OK").otherwise("FAIL").alias("status")
    )


def clock_checks(offsets: DataFrame, threshold_ms: int = 5) -> DataFrame:
    row = clock_status(offsets, threshold_ms).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") == "FAIL").alias("off")
    )
    return _rows(row, [_is_zero("V29", ERROR, "off", f"clocks within {threshold_ms} ms", F.col("nodes") > 0)])


# --- report ---------------------------------------------------------------------------------


def quality_report(*parts: DataFrame) -> DataFrame:
    """All rules' rows under each other."""
    return matrix.union_all(*parts).select(*COLUMNS)


def quality_rollup(rows: DataFrame) -> DataFrame:
    """One row: the numbers of checks, and whether all passed, in the usual and the strict sense."""
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    counts = rows.agg(
        F.count("*").alias("total_checks"),
        F.count_if("passed").alias("passed_count"),
        failed(ERROR).alias("error_count"),
        failed(WARNING).alias("warning_count"),
        failed(INFO).alias("info_count"),
    )
    no_errors = F.col("error_count") == 0
    return counts.withColumn("passed", no_errors).withColumn(
        "passed_strict", no_errors & (F.col("warning_count") == 0)
    )
