import json

import pytest
from pyspark.sql import functions as F

from pulse.functions.parsing import parse_events
from pulse.plans.ingest import IngestCounts, first_and_rejected, ingest
from pulse.sinks import event_store, manifests
from pulse.sinks.event_store import EventStore
from pulse.sinks.manifests import Attempt, Batches, ConcurrentWriter, Manifest, ManifestLog

LOG = "value BINARY, topic STRING, partition INT, offset LONG"


def record(n, offset, payload="p", run="run_1", partition=0):
    event = {"event_id": f"{n * 7919 % 2**32:08x}-0000-4000-8000-{n:012d}", "produced_at": 10 + n, "payload": payload,
             "strategy": "batch", "scenario": "low-load", "run_id": run}
    return json.dumps(event).encode(), "t", partition, offset


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "events"), stamp=F.col("produced_at") + 5)


def content(store):
    return sorted((int(r["event_id"][-6:]), r["payload"], r["batch_id"]) for r in store.events().collect())


def folders(tmp_path):
    return {p.name.removeprefix("attempt=") for p in (tmp_path / "events").glob("attempt=*")}


# --- names and documents ---


def test_batches_are_ranges():
    names = [f"run-{k:012d}" for k in (3, 1, 2, 7)] + ["load", "run-x"]
    got = Batches()
    for name in names:
        got = got | Batches.of(name)
    assert got.ranges == (("run-", 1, 3), ("run-", 7, 7)) and got.single == ("load", "run-x")
    assert all(name in got for name in names) and "run-000000000004" not in got and "other" not in got
    left = got.without("run-000000000002").without("load")
    assert left.ranges == (("run-", 1, 1), ("run-", 3, 3), ("run-", 7, 7)) and left.single == ("run-x",)
    assert not Batches.of("a").without("a")


def test_a_repeat_replaces_and_a_fold_swaps():
    first = Attempt("x", 0, 5, 0, Batches.of("a"))
    both = Attempt("y", 1, 9, 1, Batches(("b", "c")))
    m = Manifest().with_batch("a", first).folded([], both)
    again = m.with_batch("a", Attempt("z", 0, 1, 0, Batches.of("a")))
    assert [a.name for a in again.attempts] == ["y", "z"] and again.retired == ((3, "x"),)
    part = again.with_batch("c", None)
    assert part.attempts[0].replaced == ("c",) and "c" not in part.attempts[0].batches and part.version == 4
    assert manifests._as_manifest(manifests._as_text(part.without_run(("s", "c", "r")))) == part.without_run(("s", "c", "r"))


def test_only_one_writer_gets_a_version(spark, tmp_path):
    one, two = (ManifestLog(spark, str(tmp_path / "m")) for _ in range(2))
    base = one.latest()
    one.commit(base.with_batch("a", None), ())
    with pytest.raises(ConcurrentWriter):
        two.commit(base.with_batch("b", None), ())
    assert two.latest().version == 1 and len(list((tmp_path / "m").glob("*.json"))) == 1


def test_few_documents_stay(spark, tmp_path):
    log, m = ManifestLog(spark, str(tmp_path / "m")), Manifest()
    for _ in range(manifests.KEPT + 10):
        m = m.with_batch("a", None)
        log.commit(m, ())
    assert len(list((tmp_path / "m").glob("*.json"))) == manifests.KEPT
    assert ManifestLog(spark, str(tmp_path / "m")).latest() == m


# --- crashes ---


@pytest.mark.parametrize("at", ["_write_ledger", "_commit", "attempt_counts"])
def test_a_crash_neither_hides_nor_doubles_rows(frame, store, tmp_path, monkeypatch, at):
    ingest(frame([record(n, n, "a") for n in range(4)], LOG), store, "b1")
    before = content(store)
    again = frame([record(n, n, "b") for n in range(6)], LOG)

    def crash(*args, **more):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(EventStore, at, crash)
        with pytest.raises(RuntimeError, match="lost"):
            ingest(again, store, "b1")
    assert content(store) == before
    assert content(EventStore(store.spark, store.path, store.stamp)) == before
    ingest(again, store, "b1")
    assert content(store) == [(n, "b", "b1") for n in range(6)]
    # What the crash left is named by no manifest, and goes on demand.
    named = {a.name for a in store.manifest().attempts} | {name for _, name in store.manifest().retired}
    lost = folders(tmp_path) - named
    assert len(lost) == 1 and store.vacuum() == sorted(lost) and folders(tmp_path) == named
    assert content(store) == [(n, "b", "b1") for n in range(6)]


def test_a_crash_while_folding_changes_nothing(frame, store, monkeypatch):
    monkeypatch.setattr(event_store, "FOLD", 3)
    for k in range(2):
        ingest(frame([record(k, k)], LOG), store, f"b{k}")
    with monkeypatch.context() as broken:
        broken.setattr(Manifest, "folded", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest(frame([record(2, 2)], LOG), store, "b2")
    assert [n for n, _, _ in content(store)] == [0, 1, 2] and len(store.manifest().attempts) == 3
    ingest(frame([record(3, 3)], LOG), store, "b3")
    assert [n for n, _, _ in content(store)] == [0, 1, 2, 3] and len(store.manifest().attempts) == 1


# --- many batches ---


def test_many_batches_fold_and_still_know_every_id(frame, store, monkeypatch):
    monkeypatch.setattr(event_store, "FOLD", 3)
    for k in range(11):
        rows = [record(n, n, f"b{k}") for n in range(2 * k, 2 * k + 4)] + [(b"bad", "t", 0, 100)]
        assert ingest(frame(rows, LOG), store, f"run-{k:012d}") == IngestCounts(5, 1)
    assert content(store) == [(n, f"b{max(0, n // 2 - 1)}", f"run-{max(0, n // 2 - 1):012d}") for n in range(24)]
    assert store.quarantine().count() == 11 and len(store.manifest().attempts) <= 5
    assert {r["batch_id"] for r in store.quarantine().collect()} == {f"run-{k:012d}" for k in range(11)}
    # A batch that was folded long ago is written again: with fewer rows, and no bad one.
    ingest(frame([record(4, 4, "new")], LOG), store, "run-000000000001")
    assert (4, "new", "run-000000000001") in content(store) and store.quarantine().count() == 10
    assert [n for n, _, _ in content(store)] == [0, 1, 2, 3, 4, *range(6, 24)]
    assert ingest(frame([record(5, 5, "again")], LOG), store, "late").records == 1
    assert (5, "again", "late") in content(store)


def test_an_emptied_run_may_come_again_after_folding(frame, store, monkeypatch):
    monkeypatch.setattr(event_store, "FOLD", 2)
    ingest(frame([record(1, 0), record(2, 1, run="run_2")], LOG), store, "a")
    store.empty_run("batch", "low-load", "run_1")
    assert [n for n, _, _ in content(store)] == [2]
    ingest(frame([record(3, 2)], LOG), store, "b")
    ingest(frame([record(1, 0, "again"), record(2, 1, "no")], LOG), store, "c")
    assert content(store) == [(1, "again", "c"), (2, "p", "a"), (3, "p", "b")]


# --- plans ---


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_look_up_reads_no_stored_event_and_shuffles_nothing_stored(frame, store, monkeypatch):
    monkeypatch.setattr(event_store, "FOLD", 3)
    for k in range(5):
        ingest(frame([record(n, n) for n in range(10 * k, 10 * k + 10)], LOG), store, f"b{k}")
    name = store.write(store.staged(first_and_rejected(parse_events(frame([record(3, 0), record(99, 1)], LOG))), "new"))
    known = store.known(store.attempt_ids(name), 2, "new")
    text = plan(known)
    stored = [path for path in known.inputFiles() if name not in path]
    assert stored and all("/_ledger/" in path for path in stored)
    assert text.count("Exchange") == text.count("BroadcastExchange") and "BroadcastHashJoin" in text
    assert known.count() == 1
    # Two ids open two of the folded attempt's buckets at most.
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters", 1)[1][:200]
    assert max(a.level for a in store.manifest().attempts) == 1


def test_ledger_frames_are_listed_once(frame, store):
    for k in range(3):
        ingest(frame([record(k, k)], LOG), store, f"b{k}")
    before = dict(store._ledgers)
    ingest(frame([record(9, 9)], LOG), store, "b9")
    assert before and all(store._ledgers[name] is df for name, df in before.items())


def test_the_log_is_read_once(spark, frame, store):
    """Rows of the log that go through a counter: once each, with known ids and bad records among them."""
    ingest(frame([record(1, 0)], LOG), store, "before")
    rows = [record(n, n) for n in range(20)] + [(b"bad", "t", 0, 30 + n) for n in range(5)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert ingest(frame(rows, LOG).mapInArrow(count, LOG), store, "b") == IngestCounts(25, 5)
    assert read.value == 25 and store.events().count() == 20 and store.quarantine().count() == 5


def test_rejected_records_are_dealt_over_the_tasks(frame):
    text = plan(first_and_rejected(parse_events(frame([(b"x", "t", 0, 1)], LOG))))
    assert "WindowGroupLimit" in text and text.count("Scan ExistingRDD") == 1


def test_offsets_as_the_topic_reader_takes_them(frame):
    from pulse.sources.kafka import log_ends, offsets_option

    log = frame([record(1, 4), record(2, 9, partition=2)], LOG)
    assert log_ends(log) == {("t", 0): 5, ("t", 2): 10}
    assert json.loads(offsets_option(log_ends(log))) == {"t": {"0": 5, "2": 10}}
