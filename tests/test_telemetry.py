import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulse.operators import telemetry
from pulse.plans import snapshot
from pulse.schemas import KEY

START = datetime(2024, 1, 1)
SAMPLE = "metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"


def series(values, step_s=5, metric="m", **labels):
    return [(metric, labels, START + timedelta(seconds=step_s * i), float(v)) for i, v in enumerate(values)]


def increase(values):
    return sum(b if b < a else b - a for a, b in zip(values, values[1:]))


@pytest.mark.parametrize("slice_s", [1, 5, 10, 3600])
def test_increase_with_a_reset(frame, slice_s):
    df = telemetry.with_series(frame(series([10, 15, 3, 8], job="a"), SAMPLE))
    assert telemetry.counter_increase(df, ["series"], slice_s=slice_s).first()["increase"] == 13.0


def test_increase_against_brute_force(frame):
    rng = random.Random(4)
    sets = {f"a{i}": [rng.choice([0, 1, 5, 100]) for _ in range(rng.randint(1, 60))] for i in range(6)}
    df = frame([row for name, values in sets.items() for row in series(values, 7, job=name)], SAMPLE)
    got = telemetry.counter_increase(telemetry.with_series(df.repartition(5)), ["series"], slice_s=60)
    assert {r["series"]: r["increase"] for r in got.collect()} == {
        f"m|job={name}": float(increase(values)) for name, values in sets.items()
    }


def test_series_ignore_the_order_of_labels(frame):
    df = frame([("m", {"a": "1", "b": "2"}, START, 1.0), ("m", {"b": "2", "a": "1"}, START, 1.0)], SAMPLE)
    assert telemetry.with_series(df).select("series").distinct().count() == 1


def test_label_conditions(frame, rows):
    df = frame(
        series([1], name="app-1", mode="idle") + series([2], name="app-12", mode="user") + series([3], other="x"), SAMPLE
    )
    pick = lambda **c: sorted(v for (v,) in rows(df.where(telemetry.label_match("m", **c)), "value"))
    assert pick(equal={"name": "app-1"}) == [1.0]
    assert pick(like={"name": "app-1"}) == [1.0]
    assert pick(like={"name": "app-.*"}) == [1.0, 2.0]
    assert pick(unequal={"mode": "idle"}) == [2.0, 3.0]
    assert pick(equal={"name": ""}) == [3.0]
    assert df.where(telemetry.label_match("other")).count() == 0


def test_sum_of_averages_and_maximum(frame):
    df = telemetry.with_series(frame(series([1, 3], a="x") + series([10], a="y"), SAMPLE))
    assert telemetry.sum_of_averages(df, ["metric", "series"], ["metric"]).first()["total"] == 12.0
    assert telemetry.max_over_time(df, ["metric"]).first()["maximum"] == 10.0


def test_first_usable_skips_zero_and_missing(frame):
    row = frame([(None, 0.0, 4.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    pick = lambda *names: row.select(telemetry.first_usable(*[F.col(n) for n in names]).alias("x")).first()["x"]
    assert pick("a", "b", "c") == 4.0 and pick("a", "b") == 0.0


RUN = "strategy STRING, scenario STRING, run_id STRING"


def test_pivot_takes_the_last_line(frame):
    lines = [("cpu_total_cores", 1.0, 0), ("cpu_total_cores", None, 2), ("mem_rss_bytes", 5.0, 1), ("mem_rss_bytes", 6.0, 3)]
    df = frame([("s", "c", "r", *line) for line in lines], RUN + ", metric STRING, value DOUBLE, line LONG")
    got = telemetry.pivot_snapshot(df).first()
    assert (got["cpu_total_cores"], got["mem_rss_bytes"], got["tput_sink_eps"]) == (0.0, 6.0, 0.0)


@pytest.fixture
def run(frame):
    start = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    return frame(
        [("streaming", "c", "r", start, start + 100_000, 100.0)], RUN + ", start_ms LONG, end_ms LONG, duration_s DOUBLE"
    )


LATENCY = RUN + ", latency_rows LONG, latency_p50_ms DOUBLE, latency_p95_ms DOUBLE, latency_p99_ms DOUBLE"


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_snapshot_of_a_run(frame, run):
    samples = frame(
        series([0, 50, 100], metric=snapshot.CPU_METRIC, job="cadvisor", name="app")
        + series([0, 1000], metric=snapshot.CPU_METRIC, job="cadvisor", name="other")
        + series([0, 9], metric=snapshot.HOST_CPU_METRIC, job="node-exporter", mode="user")
        + series([100, 300], metric=snapshot.MEMORY_METRIC, job="cadvisor", id="/docker/abc")
        + series([0, 500], metric=snapshot.PRODUCED_METRIC, scenario="c")
        + series([3, 8, 5], metric=snapshot.LAG_METRIC, consumergroup="flink-streaming-c-r")
        + [(snapshot.CPU_METRIC, {"job": "cadvisor", "name": "app"}, START + timedelta(seconds=101), 9e9)],
        SAMPLE,
    )
    latency = frame([("streaming", "c", "r", 250, 1.0, 2.0, 3.0)], LATENCY)
    got = values(snapshot.metric_snapshot(samples, run, latency, containers="app", projects="none"))
    assert got == {
        "cpu_total_cores": 1.0, "mem_rss_bytes": 200.0, "tput_produced_eps": 5.0, "tput_sink_eps": 2.5,
        "kafka_consumer_lag": 8.0, "kafka_consumer_lag_real_present": 1.0,
        "latency_p50_ms": 1.0, "latency_p95_ms": 2.0, "latency_p99_ms": 3.0,
    }


def test_snapshot_falls_back_to_the_host(frame, run):
    samples = frame(
        series([0, 90], metric=snapshot.HOST_CPU_METRIC, job="node-exporter", mode="user")
        + series([0, 900], metric=snapshot.HOST_CPU_METRIC, job="node-exporter", mode="idle")
        + series([10, 10], metric=snapshot.HOST_MEMORY_TOTAL, job="node-exporter")
        + series([4, 2], metric=snapshot.HOST_MEMORY_FREE, job="node-exporter"),
        SAMPLE,
    )
    got = values(snapshot.metric_snapshot(samples, run, frame([], LATENCY)))
    assert got["cpu_total_cores"] == pytest.approx(0.9) and got["mem_rss_bytes"] == 7.0
    assert got["tput_sink_eps"] == 0.0 and got["kafka_consumer_lag_real_present"] == 0.0


def test_run_without_samples_has_zeros(frame, run):
    got = values(snapshot.metric_snapshot(frame([], SAMPLE), run, frame([], LATENCY)))
    assert set(got.values()) == {0.0} and len(got) == 9
