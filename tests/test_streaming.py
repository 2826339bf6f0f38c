import json

import pytest
from pyspark.sql import functions as F

from pulse.plans.ingest import ingest
from pulse.schemas import KAFKA_RECORD
from pulse.sinks.event_store import EventStore
from pulse.sources.kafka import stream_log_table
from pulse.streaming import monitor, progress
from pulse.streaming.ingest import first_within, ingest_stream, run_to_end, trigger
from pulse.streaming.monitor import COUNTS, WindowCounts, append_samples, count_latencies, live_latency, live_visibility, publish
from pulse.streaming.progress import ProgressTable, run_until_drained


def log(spark, records):
    rows = [
        (None, json.dumps({"event_id": f"00000000-0000-0000-0000-{n:012d}", "produced_at": 1000 * n, "payload": text,
                           "strategy": "batch", "scenario": "low-load", "run_id": "r"}).encode(), "t", 0, offset, None)
        for n, offset, text in records
    ]
    return spark.createDataFrame(rows, KAFKA_RECORD)


def content(store):
    return sorted((r["event_id"], r["payload"], r["visible_at"]) for r in store.events().collect())


@pytest.fixture
def parts(spark, tmp_path):
    """Three files; an id of the first comes again in the second."""
    source = str(tmp_path / "log")
    for records in ([(1, 0, "a"), (2, 1, "a")], [(2, 2, "b"), (3, 3, "b")], [(1, 4, "c"), (4, 5, "c")]):
        log(spark, records).coalesce(1).write.mode("append").parquet(source)
    return source


def test_stream_equals_batch(spark, parts, tmp_path):
    stamp = F.col("produced_at") + 7
    batch = EventStore(spark, str(tmp_path / "batch"), stamp)
    ingest(spark.read.schema(KAFKA_RECORD).parquet(parts), batch, "one")
    stream = EventStore(spark, str(tmp_path / "stream"), stamp)
    source = stream_log_table(spark, parts, files_per_batch=1)
    run_to_end(ingest_stream(source, stream, "run", str(tmp_path / "offsets"), "bounded"))
    assert content(stream) == content(batch)
    assert stream.events().select("batch_id").distinct().count() == 3


@pytest.mark.parametrize("dedupe", ["ledger", "state"])
def test_restart_goes_on_where_it_ended(spark, parts, tmp_path, dedupe):
    store = EventStore(spark, str(tmp_path / "events"), F.col("produced_at"))
    start = lambda: run_to_end(
        ingest_stream(stream_log_table(spark, parts), store, "run", str(tmp_path / "offsets"), "bounded", spread=3, dedupe=dedupe)
    )
    start()
    once = content(store)
    start()
    assert content(store) == once
    log(spark, [(3, 6, "late"), (9, 7, "new")]).write.mode("append").parquet(parts)
    start()
    assert [p for _, p, _ in content(store)] == [p for _, p, _ in once] + ["new"]


def test_new_checkpoint_adds_nothing(spark, parts, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"), F.col("produced_at"))
    for name in ("first", "second"):
        run_to_end(ingest_stream(stream_log_table(spark, parts), store, name, str(tmp_path / name), "bounded"))
    assert store.events().count() == 4
    assert {r["batch_id"].split("-")[0] for r in store.events().collect()} == {"first"}


def test_state_begins_with_the_ids_of_the_store(spark, parts, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"), F.col("produced_at"))
    ingest(log(spark, [(2, 0, "before"), (7, 1, "before")]), store, "load")
    source = stream_log_table(spark, parts, files_per_batch=1)
    run_to_end(ingest_stream(source, store, "run", str(tmp_path / "offsets"), "bounded", dedupe="state"))
    assert sorted((int(e[-2:]), p) for e, p, _ in content(store)) == [(1, "a"), (2, "before"), (3, "b"), (4, "c"), (7, "before")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        ingest_stream(source, store, "run", str(tmp_path / "o"), dedupe="elsewhere")


class Kept(dict):
    """A map and a value of the state, which count how often they are asked."""

    asked, value = 0, None

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value


def test_state_is_asked_by_bucket_and_grows_with_its_ids(monkeypatch):
    from types import SimpleNamespace

    from pulse.streaming import state

    kept, size = Kept(), {}
    value = SimpleNamespace(get=lambda: size.get(0), update=lambda row: size.update({0: row}))
    names = [b"%016d" % n for n in range(20_000)]
    for held in (1 << 20, 500):
        monkeypatch.setattr(state, "HELD", held)
        for first in (0, 7_000):
            known = state._Known(kept, value)
            assert [known.add(n) for n in names[first : first + 10_000]] == [n >= (0 if first == 0 and held > 500 else 10_000 if held > 500 else 17_000) for n in range(first, first + 10_000)]
            known.flush()
        if held > 500:
            # 17 000 ids in tables of 64 and then 128 buckets: not a call for each id.
            assert kept.asked < 1_000
    assert size[0] == (7, 17_000) and sum(len(v[0]) for v in kept.values()) == 16 * 17_000


def test_triggers():
    assert trigger("bounded") == {"availableNow": True}
    assert trigger("microbatch") == {"processingTime": "5 seconds"}
    assert trigger("streaming") == {"processingTime": "0 seconds"}
    with pytest.raises(ValueError):
        trigger("sometimes")


def test_deadline_stops_the_query(spark, parts, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"), F.col("produced_at"))
    query = ingest_stream(stream_log_table(spark, parts), store, "run", str(tmp_path / "offsets"), "microbatch", "1 second")
    with pytest.raises(TimeoutError):
        run_to_end(query, 12)
    assert not query.isActive and store.events().count() == 4


SINK = "event_id STRING, strategy STRING, scenario STRING, run_id STRING, produced_at LONG, visible_at LONG, latency_ms LONG"


@pytest.fixture
def sink(spark, tmp_path):
    rows = [(f"e{i}", "s", "c", "r", 1000 * i, 1000 * i + i, i) for i in range(60)]
    df = spark.createDataFrame(rows, SINK)
    path = str(tmp_path / "sink")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_live_figures_equal_the_batch_ones(spark, sink, tmp_path, rows):
    table, stream = sink
    out = str(tmp_path / "figures")
    run_to_end(publish(live_visibility(stream), out, str(tmp_path / "offsets"), "bounded"))
    got = spark.read.parquet(out)
    assert rows(got, *sorted(got.columns)) == rows(live_visibility(table), *sorted(got.columns))
    assert got.first()["le_50"] == 51 and got.first()["last_visible_at_ms"] == 59059


def test_samples_are_appended(spark, sink, tmp_path):
    table, stream = sink
    out = str(tmp_path / "samples")
    run_to_end(append_samples(stream, out, str(tmp_path / "offsets"), "bounded"))
    assert spark.read.parquet(out).count() == table.count()


def test_windows_are_exact_and_late_rows_count(spark, sink, tmp_path):
    table, stream = sink
    out = str(tmp_path / "windows")
    run_to_end(count_latencies(stream, out, str(tmp_path / "o"), "bounded"))
    read = lambda: {r["window_start_ms"]: (r["rows_seen"], r["p50_ms"]) for r in live_latency(spark, out).collect()}
    assert read()[0] == (10, 4.5) and read()[50000] == (10, 54.5) and len(read()) == 6
    # Rows of the first window that come after all others.
    table.limit(2).withColumn("latency_ms", F.lit(100).cast("long")).write.mode("append").parquet(str(tmp_path / "sink"))
    run_to_end(count_latencies(stream, out, str(tmp_path / "o"), "bounded"))
    assert read()[0] == (12, 5.5) and sum(n for n, _ in read().values()) == 62


def test_counts_of_many_batches_lie_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor, "FOLD", 3)
    counts = WindowCounts(spark, str(tmp_path / "c"))
    batch = lambda n: spark.createDataFrame([(0, "s", "c", n % 4, 1)], COUNTS).coalesce(1)
    for number in range(20):
        counts.add(batch(number), number)
        if number % 5 == 2:
            # The latest batch once more, as after a failure: also where it has been folded.
            counts.add(batch(number), number)
    assert len(WindowCounts(spark, str(tmp_path / "c")).log.latest().attempts) <= 6
    assert live_latency(spark, str(tmp_path / "c")).first()["rows_seen"] == 20
    assert counts.read().groupBy().agg(F.sum("n")).first()[0] == 20
    assert live_latency(spark, str(tmp_path / "none")).collect() == []


def test_progress_rows_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(progress, "SEGMENT", 4)
    table = ProgressTable(spark, str(tmp_path / "p"))
    assert not table.drained(1)
    for rows in (5, 0, 0, 7, 0, 0):
        table._append("q", 1, rows)
    assert len(list((tmp_path / "p").glob("*.json"))) == 2
    assert [r["num_input_rows"] for r in table.read().orderBy("batch_id").collect()] == [5, 0, 0, 7, 0, 0]
    assert table.drained(2) and not table.drained(3)
    table._append("q", None, 0)
    assert table.drained(3)


def test_a_stream_stops_when_it_has_run_dry(spark, parts, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"), F.col("produced_at"))
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "300")
    table = ProgressTable(spark, str(tmp_path / "p"))
    spark.streams.addListener(table)
    try:
        source = stream_log_table(spark, parts, files_per_batch=1)
        query = ingest_stream(source, store, "run", str(tmp_path / "o"), "streaming")
        run_until_drained(query, table)
    finally:
        spark.streams.removeListener(table)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    assert not query.isActive and store.events().count() == 4


def test_copies_within_the_horizon(spark, parts, tmp_path):
    out = str(tmp_path / "out")
    events = first_within(stream_log_table(spark, parts), "1 hour")
    query = events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True)
    run_to_end(query.start(out))
    assert sorted(int(r["event_id"][-2:]) for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
