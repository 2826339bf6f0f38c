import json

import pytest
from pyspark.sql import functions as F

from pulse.operators import matrix
from pulse.plans import reports
from pulse.sinks import files
from pulse.sources import artifacts

HEADER = "event_id,strategy,scenario,run_id,produced_at,visible_at,latency_ms\n"


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        target = tmp_path / "results" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    put(
        "batch/low-load/run_1/latency_samples.csv",
        HEADER + "a,x,y,z,1,5,4\nb,x,y,z,1,5,4,extra,fields\nc,x,y,z,1\nd,x,y,z,1,9,bad\ne,x,y,z,2,8,6.5\n",
    )
    put("batch/cyclic-load/run_1/latency_samples.csv", HEADER + "f,x,y,z,1,5,4\n")
    put("stray/latency_samples.csv", HEADER + "g,x,y,z,1,5,4\n")
    put("batch/low-load/latency_samples.csv", HEADER + "h,x,y,z,1,5,4\n")
    put("latency_samples.csv", HEADER + "i,own,low-load,flat,1,5,4\n")
    put("batch/low-load/run_1/run_metadata.json", json.dumps({"target_eps": 5, "scenario": "named"}, indent=2))
    put("batch/low-load/run_2/run_metadata.json", "{broken")
    put("batch/low-load/run_1/run_summary.json", json.dumps({"visible_events": 3, "cpu_avg_cores": 0.5}))
    put("batch/low-load/run_1/generator_summary.json", json.dumps({"total_events_generated": 9}))
    put(
        "batch/low-load/run_1/prometheus_snapshot.csv",
        "strategy,scenario,run_id,metric,value,unit\nbatch,low-load,run_1,cpu_total_cores,1.5,cores\n"
        "batch,low-load,run_1,cpu_total_cores,2.5,cores\nbatch,low-load,run_1,mem_rss_bytes,oops,bytes\n",
    )
    put(
        "batch/low-load/run_1/kafka_lag_timeseries.csv",
        "timestamp,strategy,scenario,run_id,consumer_group,topic,lag,lag_source\n5,batch,low-load,run_1,,t,7,missing\n"
        "6,batch,low-load,run_1,,t,8\n",
    )
    put(
        "batch/low-load/run_1/resources_timeseries.csv",
        "timestamp,strategy,scenario,run_id,cpu_cores,mem_rss_bytes\n5,batch,low-load,run_1,0.25,1048576\n",
    )
    return str(tmp_path / "results")


def test_latency_samples(spark, tree, rows):
    got = artifacts.read_latency_samples(spark, tree)
    assert rows(got, "event_id", "strategy", "scenario", "run_id", "latency_ms") == [
        ("a", "batch", "low-load", "run_1", 4.0), ("e", "batch", "low-load", "run_1", 6.5),
    ]
    every = artifacts.read_latency_samples(spark, tree, scope="all")
    assert sorted(r["event_id"] for r in every.collect()) == ["a", "e", "f"]


def test_raw_samples_keep_short_and_bad_rows(spark, tree):
    raw = artifacts.read_latency_samples(spark, tree, raw=True)
    got = {r["event_id"]: r["latency_ms"] for r in raw.collect()}
    assert got == {"a": "4", "c": None, "d": "bad", "e": "6.5"}


def test_flat_root_keeps_its_own_labels(spark, tree):
    got = artifacts.read_latency_samples(spark, tree, scope="all", flat_root=True)
    labels = {r["event_id"]: (r["strategy"], r["run_id"]) for r in got.collect()}
    assert labels["i"] == ("own", "flat") and labels["a"] == ("batch", "run_1")
    assert labels["h"] == ("batch", "latency_samples.csv") and "g" not in labels


def test_documents(spark, tree, rows):
    assert rows(artifacts.read_run_metadata(spark, tree), "strategy", "scenario", "run_id", "target_eps") == [
        ("batch", "named", "run_1", 5)
    ]
    assert rows(artifacts.read_run_summaries(spark, tree), "scenario", "visible_events", "cpu_avg_cores") == [("low-load", 3, 0.5)]
    assert rows(artifacts.read_generator_summaries(spark, tree), "total_events_generated") == [(9,)]


def test_series(spark, tree):
    snapshot = artifacts.read_snapshots(spark, tree)
    from pulse.operators.telemetry import pivot_snapshot

    row = pivot_snapshot(snapshot).first()
    assert (row["cpu_total_cores"], row["mem_rss_bytes"]) == (2.5, 0.0)
    lag = sorted((r["timestamp"], r["lag"], r["lag_source"]) for r in artifacts.read_lag_series(spark, tree).collect())
    assert lag == [(5, 7.0, "missing"), (6, 8.0, "unknown")]
    assert artifacts.read_resource_series(spark, tree).first()["cpu_cores"] == 0.25


@pytest.fixture
def put(tmp_path):
    def write(path, text):
        target = tmp_path / "other" / "batch/low-load/run_1" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
        return str(tmp_path / "other")

    return write


def test_columns_go_by_the_header(spark, put):
    root = put("latency_samples.csv", "\ufefflatency_ms,note,event_id,visible_at,produced_at\n250,n,a,1500,1250\n\n9,n,b\n1,2,3,4,5,6\n")
    put("kafka_lag_timeseries.csv", "timestamp,consumer_group,topic,lag\n5,g,t,7\n")
    put("resources_timeseries.csv", "cpu_cores,timestamp\r\n1.5,5\r\n")
    got = {r["event_id"]: r for r in artifacts.read_latency_samples(spark, root).collect()}
    assert set(got) == {"a", "b"} and got["a"]["latency_ms"] == 250.0 and got["a"]["run_id"] == "run_1"
    assert got["a"]["produced_at"] == 1250 and got["b"]["visible_at"] is None
    lag = artifacts.read_lag_series(spark, root).first()
    assert (lag["strategy"], lag["run_id"], lag["lag"], lag["topic"], lag["lag_source"]) == ("batch", "run_1", 7.0, "t", "unknown")
    resources = artifacts.read_resource_series(spark, root).first()
    assert (resources["cpu_cores"], resources["timestamp"], resources["mem_rss_bytes"], resources["scenario"]) == (1.5, 5, None, "low-load")


def test_columns_that_no_file_has_fail_the_rules(spark, put):
    from pulse.plans.quality import sample_checks

    passed = lambda df: {r["check"]: r["passed"] for r in sample_checks(df).collect()}
    root = put("latency_samples.csv", "event_id,produced_at\na,1250\n")
    got = passed(artifacts.read_latency_samples(spark, root, raw=True))
    assert got["V17"] is False and got["V24"] is False
    root = put("latency_samples.csv", "event_id,latency_ms,visible_at,produced_at\na,1,1251,1250\n")
    got = passed(artifacts.read_latency_samples(spark, root, raw=True))
    assert got["V17"] is True and got["V24"] is True


def test_last_value_of_a_file_in_several_splits(spark, put):
    root = put("prometheus_snapshot.csv", "metric,value\n" + "".join(f"cpu_total_cores,{k}\n" for k in range(3000)))
    from pulse.operators.telemetry import pivot_snapshot

    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert pivot_snapshot(artifacts.read_snapshots(spark, root)).first()["cpu_total_cores"] == 2999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_inventory_lists_files_without_reading_them(spark, tree, rows):
    found = artifacts.artifact_inventory(spark, tree)
    assert rows(found, "run_id", "artifact") == [
        ("run_1", "generator_summary.json"), ("run_1", "latency_samples.csv"), ("run_1", "latency_samples.csv"),
        ("run_1", "run_metadata.json"), ("run_1", "run_summary.json"), ("run_2", "run_metadata.json"),
    ]
    gaps = matrix.missing_artifacts(found, found).where("run_id = 'run_2'")
    assert gaps.count() == 3


def test_metrics_from_a_tree(spark, tree):
    metrics = reports.official_metrics(
        artifacts.read_latency_samples(spark, tree), artifacts.read_run_metadata(spark, tree),
        artifacts.read_run_summaries(spark, tree), artifacts.read_generator_summaries(spark, tree),
        artifacts.read_lag_series(spark, tree), artifacts.read_resource_series(spark, tree),
    )
    row = metrics.where("run_id = 'run_1' AND scenario = 'low-load'").first()
    assert (row["generated_events"], row["visible_events_final"], row["cpu_avg_cores"]) == (9, 3, 0.5)
    assert row["latency_p50_ms"] == 5.25 and row["memory_rss_avg_mb"] == 1.0


def test_written_samples_read_back_in_order(spark, frame, tmp_path):
    df = frame(
        [("b", "s", "c", "r", 1, 9, 8.0), ("a", "s", "c", "r", 1, 9, 8.0), ("z", "s", "c", "r", 1, 2, 1.0)],
        "event_id STRING, strategy STRING, scenario STRING, run_id STRING, produced_at LONG, visible_at LONG, latency_ms DOUBLE",
    )
    path = str(tmp_path / "out")
    files.write_samples_csv(df, path)
    back = spark.read.option("header", "true").csv(path)
    assert back.count() == 3 and back.columns[0] == "event_id"
    files.write_report(df, str(tmp_path / "report"))
    files.write_report(df, str(tmp_path / "report2"), "parquet")
    assert spark.read.parquet(str(tmp_path / "report2")).count() == 3
    files.write_run_documents(df.limit(1), str(tmp_path / "docs"))
    assert (tmp_path / "docs" / "strategy=s" / "scenario=c" / "run_id=r").is_dir()


def test_a_written_tree_has_one_whole_file_a_run(spark, tmp_path, frame):
    rows = [(f"e{k}", "batch", "low load", f"run {k % 2}/x", 10 * k, 20 * k, 1.5 * k) for k in range(40)]
    df = frame(rows, "event_id STRING, strategy STRING, scenario STRING, run_id STRING, produced_at LONG, visible_at LONG, latency_ms DOUBLE")
    root = str(tmp_path / "tree")
    plain = df.withColumn("run_id", F.regexp_replace("run_id", "/x", "")).repartition(7)
    for _ in range(2):
        files.write_tree(plain, root, "latency_samples.csv", ["visible_at"])
    found = sorted(p.relative_to(root).as_posix() for p in (tmp_path / "tree").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert found == ["batch/low load/run 0/latency_samples.csv", "batch/low load/run 1/latency_samples.csv"]
    lines = (tmp_path / "tree/batch/low load/run 1/latency_samples.csv").read_text().splitlines()
    assert lines[0] == "event_id,strategy,scenario,run_id,produced_at,visible_at,latency_ms"
    assert [int(line.split(",")[5]) for line in lines[1:]] == sorted(20 * k for k in range(1, 40, 2))
    assert artifacts.read_latency_samples(spark, root, scope="all").count() == 40
