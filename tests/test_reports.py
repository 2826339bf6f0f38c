import pytest
from pyspark.sql import functions as F

from pulse.plans import reports
from pulse.schemas import KEY, OFFICIAL_COLUMNS

RUN = "strategy STRING, scenario STRING, run_id STRING"
R = ("batch", "low-load", "run_1")
SAMPLES = RUN + ", produced_at LONG, visible_at LONG, latency_ms LONG"
META = RUN + ", target_eps LONG, official_duration_seconds DOUBLE, generation_end_ts LONG"
SUMMARY = (
    RUN + ", generated_events LONG, visible_events LONG, cpu_cores_avg DOUBLE, cpu_avg_cores DOUBLE,"
    " mem_rss_mb_avg DOUBLE, memory_rss_avg_mb DOUBLE"
)
GENERATOR = (
    RUN + ", total_events_generated LONG, generated_events LONG, generation_start_epoch_ms LONG, generation_end_epoch_ms LONG"
)
LAG = RUN + ", lag DOUBLE, lag_source STRING"
RESOURCES = RUN + ", cpu_cores DOUBLE, mem_rss_bytes DOUBLE"


@pytest.fixture
def metrics(frame):
    def build(samples=(), meta=(), summary=(), generator=(), lag=(), resources=(), **options):
        return reports.official_metrics(
            frame(list(samples), SAMPLES), frame(list(meta), META), frame(list(summary), SUMMARY),
            frame(list(generator), GENERATOR), frame(list(lag), LAG), frame(list(resources), RESOURCES), **options,
        )

    return build


def seen(n_by_cutoff, n_late, last=104500):
    early = [(*R, 90000, 99000 + i % 900, 9000) for i in range(n_by_cutoff)]
    return early + [(*R, 90000, 101000, 11000)] * (n_late - 1) + [(*R, 90000, last, last - 90000)]


def test_official_metrics(metrics):
    got = metrics(
        samples=seen(900, 90), meta=[(*R, 100, 10.0, 99)], summary=[(*R, 1000, 990, None, 0.5, None, None)],
        generator=[(*R, None, 7, 0, 100000)], lag=[(*R, 4.0, "real_prometheus"), (*R, 9.0, "missing")],
        resources=[(*R, 2.0, 2097152.0), (*R, 4.0, 4194304.0)],
    )
    assert got.columns == OFFICIAL_COLUMNS
    row = got.collect()[0].asDict()
    want = {
        "target_eps": 100, "generated_events": 1000, "visible_events_cutoff": 900, "visible_events_final": 990,
        "generated_eps_real": 100.0, "visible_eps_cutoff": 90.0, "delivery_ratio_cutoff_pct": 90.0,
        "delivery_ratio_final_pct": 99.0, "pending_visibility_events": 100.0, "time_to_drain_s": 4.5,
        "cpu_avg_cores": 0.5, "memory_rss_avg_mb": 3.0, "kafka_lag_max": 4.0, "kafka_lag_real_available": True,
    }
    assert {k: row[k] for k in want} == want


def test_cutoff_in_whole_seconds(metrics):
    options = dict(samples=seen(3, 2), meta=[(*R, 1, 10.0, 99)], generator=[(*R, None, 5, 0, 100000)])
    assert metrics(**options).first()["visible_events_cutoff"] == 3
    row = metrics(**options, whole_seconds=True).first()
    assert row["visible_events_cutoff"] == 1 and row["time_to_drain_s"] == 5.5


def test_guards(metrics):
    row = metrics(
        samples=[(*R, 0, 50, 50)], meta=[(*R, 1, 0.0, 99)], summary=[(*R, 0, 0, None, None, None, None)],
        generator=[(*R, None, 0, 0, 100000)],
    ).first()
    assert row["generated_eps_real"] is None and row["delivery_ratio_final_pct"] is None
    assert row["time_to_drain_s"] == 0.0 and row["kafka_lag_real_available"] is False


def test_run_without_samples(metrics):
    tables = dict(meta=[(*R, 1, 10.0, 99)], generator=[(*R, None, 5, 0, 100000)])
    row = metrics(**tables).first()
    assert row["visible_events_cutoff"] is None and row["pending_visibility_events"] is None
    row = metrics(**tables, fill_zero=True).first()
    assert row["visible_events_cutoff"] == 0 and row["pending_visibility_events"] == 5.0


def test_runs_of_any_table_and_of_the_scope(metrics):
    other = ("batch", "cyclic-load", "run_9")
    tables = dict(lag=[(*R, 1.0, "missing")], resources=[(*other, 1.0, 1.0)])
    assert [r["run_id"] for r in metrics(**tables).collect()] == ["run_1"]
    assert sorted(r["run_id"] for r in metrics(**tables, scope="all").collect()) == ["run_1", "run_9"]
    assert metrics().count() == 0


def test_warmup_is_left_out(metrics):
    samples = [(*R, 500, 700, 200), (*R, 3000, 3100, 100)]
    tables = dict(samples=samples, generator=[(*R, None, 2, 0, 100000)])
    assert metrics(**tables).first()["latency_p50_ms"] == 150.0
    assert metrics(**tables, warmup_s=3).first()["latency_p50_ms"] == 100.0


def test_run_and_scenario_stats(frame):
    values = [(-5, 1), (0, 2), (7, 3), (300001, None)]
    df = frame([(*R, 0, v, x) for x, v in values] + [(*R, 0, 9, None)], SAMPLES)
    row = reports.run_stats(df).first()
    assert (row["latency_rows"], row["visible_events_final_latency"], row["last_visible_at_ms"]) == (4, 3, 3)
    assert (row["latency_positive_count"], row["latency_non_positive_count"]) == (2, 2)
    assert (row["latency_min_ms"], row["latency_max_ms"], row["latency_p50_ms"]) == (-5.0, 300001.0, 3.5)
    assert reports.scenario_stats(df).first()["latency_rows"] == 4


def test_summary_for_print_is_labelled_and_ordered(frame):
    rows = [("streaming", "high-load"), ("batch", "zeta"), ("batch", "low-load"), ("microbatch", "low-load")]
    df = frame([(a, b, "r", 0, 3, 3) for a, b in rows], SAMPLES)
    got = reports.latency_summary(reports.scenario_stats(df)).collect()
    assert [(r["strategy_label"], r["scenario_label"]) for r in got] == [
        ("Batch", "Carga baja"), ("Micro-batch", "Carga baja"), ("Streaming", "Carga alta"), ("Batch", "zeta"),
    ]


def test_lag_summary_needs_every_pair(spark, frame):
    df = frame(
        [("batch", "a", 3.0, True), ("batch", "a", 5.0, True), ("batch", "b", 1.0, True)],
        "strategy STRING, scenario STRING, kafka_lag_max DOUBLE, kafka_lag_real_available BOOLEAN",
    )
    full = reports.lag_summary(df, ["batch"], ["a", "b"]).collect()
    assert sorted((r["scenario"], r["kafka_lag_max"]) for r in full) == [("a", 4.0), ("b", 1.0)]
    assert reports.lag_summary(df, ["batch"], ["a", "b", "c"]).count() == 0


def test_production_totals(frame):
    log = frame([(*R, 1000, "é"), (*R, 3000, "ab")], RUN + ", produced_at LONG, payload STRING")
    row = reports.production_totals(log).first()
    assert (row["generated_events"], row["generated_bytes"], row["generation_duration_seconds"]) == (2, 4, 2.0)
    alone = reports.production_totals(log.limit(1)).first()
    assert alone["generation_duration_seconds"] == 0.001 and alone["generated_eps_real"] == 1000.0


def test_run_summary_guards(frame):
    generators = frame(
        [(*R, 0, 0.0, 0.0)], RUN + ", generated_events LONG, generation_duration_seconds DOUBLE, generated_eps_real DOUBLE"
    )
    visible = frame([], RUN + ", visible_events LONG")
    pivot = frame([], RUN + "".join(f", {m} DOUBLE" for m in reports_metrics()))
    meta = frame(
        [(*R, 5, 0.0, 10, 7)],
        RUN + ", target_eps LONG, official_duration_seconds DOUBLE, processing_start_ts LONG, processing_end_ts LONG",
    )
    row = reports.run_summary(generators, visible, pivot, meta).first()
    assert row["delivery_ratio_pct"] == 0.0 and row["official_duration_seconds"] == 1.0
    assert row["generation_duration_seconds"] == 1.0 and row["processing_duration_seconds"] == 0.0
    assert row["kafka_lag_max"] is None and row["kafka_lag_real_present"] is False and row["cpu_cores_avg"] == 0.0


def reports_metrics():
    from pulse.schemas import SNAPSHOT_METRICS

    return SNAPSHOT_METRICS


def test_merge_per_run(frame, rows):
    a = frame([(*R, 1)], RUN + ", x INT")
    b = frame([(*R, "t"), ("batch", "low-load", "run_2", "u")], RUN + ", y STRING")
    merged = reports.merge_per_run(a, b).orderBy("run_id").collect()
    assert [(r["run_id"], r["x"], r["y"]) for r in merged] == [("run_1", 1, "t"), ("run_2", None, "u")]


def test_unreadable_latency_counts_at_the_cutoff_only(metrics):
    samples = [(*R, 0, 50, 50), (*R, 0, 60, None), (*R, 0, 70, 70)]
    row = metrics(samples=samples, generator=[(*R, None, 9, 0, 65)]).first()
    assert (row["visible_events_cutoff"], row["visible_events_final"]) == (2, 2)


def test_run_stats_read_the_samples_once(spark, tmp_path):
    path = str(tmp_path / "samples")
    columns = ["'s' AS strategy", "'c' AS scenario", "'r' AS run_id", "id AS produced_at", "id + 5 AS visible_at", "id % 7 AS latency_ms"]
    spark.range(500).selectExpr(*columns).write.parquet(path)
    for query in (reports.run_stats, reports.scenario_stats):
        got = query(spark.read.parquet(path))
        assert got.collect()[0]["latency_rows"] == 500
        final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1
