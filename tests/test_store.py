import json

import pytest
from pyspark.sql import functions as F

from pulse.plans.ingest import IngestCounts, clean_events, ingest, ingest_into_table
from pulse.sinks import jdbc
from pulse.sinks.event_store import EventStore
from pulse.sources.kafka import between_offsets, topic_options
from pulse.sources import sink_scan
from pulse.sources.sink_scan import FileRange, file_ranges, files_of_page, next_page, numbered_pages, pages

LOG = "value BINARY, partition INT, offset LONG"


def record(n, offset, payload="p", run="run_1", partition=0, **more):
    event = {"event_id": f"00000000-0000-0000-0000-{n:012d}", "produced_at": 10 + n, "payload": payload,
             "strategy": "batch", "scenario": "low-load", "run_id": run} | more
    return json.dumps(event).encode(), partition, offset


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "events"), stamp=F.col("produced_at") + 5)


def stored(store):
    names = ("event_id", "produced_at", "visible_at", "payload", "run_id", "batch_id")
    return sorted(tuple(r[n] for n in names) for r in store.events().collect())


def short(store):
    return sorted((int(r["event_id"][-3:]), r["payload"], r["batch_id"]) for r in store.events().collect())


def test_replay_and_new_id_change_nothing(frame, store):
    log = frame([record(1, 7, "late"), record(1, 3, "first"), record(2, 4)], LOG)
    ingest(log, store, "b1")
    once = stored(store)
    assert short(store) == [(1, "first", "b1"), (2, "p", "b1")]
    ingest(log, store, "b1")
    assert stored(store) == once
    ingest(log, store, "b2")
    assert stored(store) == once


def test_overlapping_batch_and_its_replay(frame, store):
    first = frame([record(n, n, "a") for n in range(5)], LOG)
    second = frame([record(n, n, "b") for n in range(3, 8)], LOG)
    for batch, name in ((first, "b1"), (second, "b2"), (second, "b2"), (first, "b1")):
        ingest(batch, store, name)
    assert short(store) == [(n, "a", "b1") for n in range(5)] + [(n, "b", "b2") for n in range(5, 8)]


def test_bad_records_are_counted_and_kept(frame, store):
    log = frame([record(1, 0), (b"nonsense", 0, 1), (None, 0, 2)], LOG)
    for _ in range(2):
        assert ingest(log, store, "b1") == IngestCounts(3, 2)
    got = sorted((r["value"], tuple(r["reject_reasons"])) for r in store.quarantine().collect() if r["value"])
    assert got == [("nonsense", ("malformed_json",))]
    assert store.quarantine().count() == 2
    assert ingest(frame([record(2, 3)], LOG), store, "b2") == IngestCounts(1, 0)


def test_nothing_left_to_write(frame, store):
    bad = frame([(b"x", 0, 0)], LOG)
    assert ingest(bad, store, "b1") == IngestCounts(1, 1)
    assert store.events().count() == 0
    assert ingest(bad.limit(0), store, "b2") == IngestCounts(0, 0)


def test_run_scope_looks_at_one_run_only(frame, store):
    ingest(frame([record(1, 0, "a", "run_1")], LOG), store, "b1")
    other = ("batch", "low-load", "run_2")
    ingest(frame([record(1, 0, "b", "run_2")], LOG), store, "b2", run=other)
    assert short(store) == [(1, "a", "b1"), (1, "b", "b2")]
    ingest(frame([record(1, 0, "c", "run_3")], LOG), store, "b3")
    assert len(short(store)) == 2


def test_emptying_a_run_leaves_the_others(frame, store):
    log = [record(1, 0, run="run_1"), record(2, 1, run="run_10"), record(3, 2, run="run/1 x")]
    ingest(frame(log, LOG), store, "b1")
    store.empty_run("batch", "low-load", "run_1")
    assert [n for n, _, _ in short(store)] == [2, 3]
    store.empty_run("batch", "low-load", "run/1 x")
    assert [n for n, _, _ in short(store)] == [2]
    store.empty_run("batch", "low-load", "no such run")


def test_blank_labels_get_defaults(frame, store):
    ingest(frame([record(1, 0, run=" ", strategy="")], LOG), store, "b1")
    row = store.events().first()
    assert (row["strategy"], row["run_id"]) == ("unknown", "unset")


def test_stamp_is_one_time_per_batch(spark, frame, tmp_path):
    store = EventStore(spark, str(tmp_path / "stamped"))
    ingest(frame([record(n, n) for n in range(20)], LOG).repartition(5), store, "b1")
    assert store.events().select("visible_at").distinct().count() == 1


def test_input_order_does_not_matter(frame):
    records = [record(n % 10, n, f"copy {n // 10}", partition=n % 10 % 3) for n in range(40)]
    want = sorted(tuple(r) for r in clean_events(frame(records, LOG)).select("event_id", "payload").collect())
    got = clean_events(frame(records[::-1], LOG).repartition(9)).select("event_id", "payload").collect()
    assert sorted(tuple(r) for r in got) == want
    assert {p for _, p in want} == {"copy 0"}


def test_offset_bounds(frame, rows):
    log = frame([(p, o) for p in range(3) for o in range(10)], "partition INT, offset LONG")
    got = between_offsets(log, {0: 8, 1: 2}, {0: 9, 2: 1})
    assert rows(got) == [(0, 8)] + [(1, o) for o in range(2, 10)] + [(2, 0)]
    assert between_offsets(log).count() == 30


def test_topic_options():
    assert topic_options("h:1", "t")["endingOffsets"] == "latest"
    streaming = topic_options("h:1", "t", "streaming")
    assert streaming["kafka.fetch.max.wait.ms"] == "100" and streaming["failOnDataLoss"] == "false"
    assert "endingOffsets" not in topic_options("h:1", "t", "microbatch", startingOffsets="latest")
    with pytest.raises(ValueError):
        topic_options("h:1", "t", "other")


def test_jdbc_statements(spark):
    assert jdbc.write_options({"url": "u"}, "t", "streaming")["batchsize"] == "2000"
    merge = jdbc.merge_statement("stage", "events")
    assert merge.startswith("INSERT INTO events (event_id,") and merge.endswith("ON CONFLICT (event_id) DO NOTHING")
    assert "DISTINCT ON (event_id)" in merge
    assert jdbc.empty_statement("events") == "DELETE FROM events WHERE strategy = ? AND scenario = ? AND run_id = ?"
    for target, name in (("events; DROP TABLE x", "w"), ("events", "a b"), ("", "w")):
        with pytest.raises(ValueError):
            jdbc.JdbcStore(spark, {}, target, name)
    assert jdbc.JdbcStore(spark, {}, "public.events", "run_1").staging == "public.events_stage_run_1"


def test_a_table_takes_each_event_once_with_its_labels(spark, frame, monkeypatch):
    """What would be written, and the statements after it; no database is at hand."""
    written, said = [], []
    monkeypatch.setattr(jdbc, "stage", lambda df, options, staging, mode: written.append((staging, mode, jdbc.staged_rows(df).collect())))
    monkeypatch.setattr(jdbc, "execute", lambda spark, options, statement, values=(): said.append((statement, values)))
    table = jdbc.JdbcStore(spark, {"url": "u"}, "events", "w", "microbatch")
    log = frame([record(1, 7, "late"), record(1, 3, "first"), record(2, 4, run=" "), (b"bad", 0, 9)], LOG)
    assert ingest_into_table(log, table) == IngestCounts(4, 1)
    (staging, mode, rows), = written
    assert (staging, mode) == ("events_stage_w", "microbatch")
    assert sorted((r["payload"], r["run_id"]) for r in rows) == [("first", "run_1"), ("p", "unset")]
    assert said == [(jdbc.merge_statement("events_stage_w", "events"), ())]
    table.empty_run("a", "b", "c")
    assert said[-1] == (jdbc.empty_statement("events"), ("a", "b", "c"))


RANGES = [FileRange("a", 10, 0, 9), FileRange("b", 10, 5, 30), FileRange("c", 10, 31, 40), FileRange("d", 10, 41, 50), FileRange("e", 10, 0, 100)]


@pytest.mark.parametrize("after,rows,want", [(-1, 10, "abe"), (-1, 11, "abe"), (-1, 21, "abce"), (10, 10, "bce"), (41, 5, "de"), (101, 5, ""), (0, 1000, "abcde")])
def test_a_page_opens_the_files_that_can_hold_it(after, rows, want):
    assert "".join(r.path for r in files_of_page(RANGES, after, rows)) == want


def test_pages_give_every_row_once_and_in_order(spark, tmp_path):
    path = str(tmp_path / "sink")
    rows = spark.range(300).selectExpr("cast(id AS string) AS event_id", "id * 7 % 40 AS visible_at", "'x' AS payload")
    rows.repartitionByRange(6, "visible_at").write.parquet(path)
    sink = spark.read.parquet(path)
    got = list(pages(sink, rows=32))
    assert [len(p) for p in got] == [32] * 9 + [12]
    flat = [(r["visible_at"], r["event_id"]) for p in got for r in p]
    assert flat == sorted((r["visible_at"], r["event_id"]) for r in rows.collect())
    assert list(pages(sink, cursor=flat[-1])) == [] and len(list(pages(sink, rows=300))) == 1
    # The files of the later pages alone are read.
    ranges = file_ranges(sink)
    near = files_of_page(ranges, flat[200][0], 32)
    page = next_page(sink.where(F.col("_metadata.file_path").isin([r.path for r in near])), None, flat[200], 32)
    page.collect()
    scan = next(n for n in _nodes(page._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan"))
    assert scan.metrics().apply("numFiles").value() == len(near) < len(ranges) == 6


def test_numbered_pages_are_those_of_the_walk_in_few_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink_scan, "_PART_ROWS", 64)
    path, tracker = str(tmp_path / "sink"), spark.sparkContext.statusTracker()
    rows = spark.range(400).selectExpr("cast(id AS string) AS event_id", "if(id < 200, 7, id * 7 % 40) AS visible_at")
    rows.repartition(3).write.parquet(path)
    sink = spark.read.parquet(path)
    jobs = set()
    for cursor, size in (((-(1 << 63), ""), 150), ((7, "150"), 70), ((1000, ""), 5)):
        walk = [(n, *row) for n, page in enumerate(pages(sink, None, cursor, size)) for row in page]
        assert sorted(map(tuple, numbered_pages(sink, None, cursor, size).collect())) == sorted(walk)
    for size in (1, 150):
        spark.sparkContext.setJobGroup(f"pages-{size}", "")
        assert numbered_pages(sink, rows=size).agg(F.max("page")).first()[0] == 399 // size
        jobs.add(len(tracker.getJobIdsForGroup(f"pages-{size}")))
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) == 1 and max(jobs) < 20


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))
