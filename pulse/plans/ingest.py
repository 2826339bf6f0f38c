"""Event ingestion: one pipeline for batch, micro-batch and low-latency modes."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pulse.functions.parsing import accepted, parse_events, without_text
from pulse.operators.keys import first_wins
from pulse.sinks.event_store import SENT_IDS, EventStore, Run, id_numbers
from pulse.sinks.jdbc import JdbcStore


@dataclass(frozen=True)
class IngestCounts:
    records: int
    rejected: int


def clean_events(log: DataFrame) -> DataFrame:
    """Accepted records of a Kafka-shaped log, first copy of each event."""
    return first_wins(accepted(parse_events(log)))


def first_and_rejected(parsed: DataFrame) -> DataFrame:
    """The first copy of each accepted event, and every rejected record: one frame, so that the log is read once.

    A rejected record is a copy of none; it has a key of its own, and so they are dealt over all tasks.
    """
    own = F.concat(F.lit("rejected "), F.monotonically_increasing_id().cast("string"))
    keyed = parsed.withColumn("_key", F.when(F.col("accepted"), F.col("event_id")).otherwise(own))
    return first_wins(keyed, "_key").drop("_key")


def ingest(log: DataFrame, store: EventStore, batch_id: str, run: Run | None = None) -> IngestCounts:
    """Add a log's events to the store, once each, and its bad records to the quarantine.

    The log is read once. What it gives, accepted and rejected, is written under a name that no reader knows; the ids
    are looked up in the store's ledger, and only if some are known already is what was written (not the log) read
    again without them. One manifest then puts it in effect, in place of what the same batch wrote before.
    ``run`` says that the log is one run's and its ids come back in no other: they are compared with that run's
    alone, and rows need not be gathered by run before they are written.
    """
    return ingest_parsed(parse_events(log), store, batch_id, run)


def ingest_parsed(parsed: DataFrame, store: EventStore, batch_id: str, run: Run | None = None, unseen: bool = False) -> IngestCounts:
    """``ingest`` of records parsed before. ``unseen`` says that the store can have none of their events, as when a stream's own
    state has let them through."""
    seen = Observation()
    parsed = parsed.observe(seen, F.count("*").alias("records"), F.count_if(~F.col("accepted")).alias("rejected"))
    name = store.write(store.staged(first_and_rejected(without_text(parsed)), batch_id), one_run=run is not None)
    try:
        counts = IngestCounts(**seen.get)
    except Py4JError:
        # A plan whose result turns out empty is cut short, and what it observed is lost with it.
        counts = IngestCounts(0, 0)
    events, rejected = store.attempt_counts(name)
    if events and not unseen:
        name, events = _without_known(store, name, batch_id, events, run)
    store.add(name, batch_id, events, rejected)
    return counts


def ingest_into_table(log: DataFrame, table: JdbcStore) -> IngestCounts:
    """The log's events into a database table, once each, in one pass; the table itself knows which ids it has.

    Bad records are counted and left out. Run again, also with other batches in between, it adds nothing.
    """
    seen = Observation()
    parsed = parse_events(log).observe(seen, F.count("*").alias("records"), F.count_if(~F.col("accepted")).alias("rejected"))
    table.add(first_wins(accepted(parsed)))
    try:
        return IngestCounts(**seen.get)
    except Py4JError:
        return IngestCounts(0, 0)


def _without_known(store: EventStore, name: str, batch_id: str, events: int, run: Run | None) -> tuple[str, int]:
    """An attempt without the events that the store has already, and how many it has: the same one if there are none."""
    known = store.known(store.attempt_ids(name), events, batch_id, run)
    if known is None:
        return name, events
    # A stream hardly ever brings an id again, so first only whether one is known.
    if not known.limit(1).count():
        return name, events
    # A batch has fewer known ids than ids.
    looked_up = f"{store.path}/_known-{name}"
    known.write.parquet(looked_up)
    try:
        known = store.spark.read.schema("hi LONG, lo LONG").parquet(looked_up)
        rows = store.attempt_rows(name).withColumns(dict(zip(("hi", "lo"), id_numbers())))
        # A rejected record has no id, and is in no ledger.
        fresh = rows.join(F.broadcast(known) if known.count() <= SENT_IDS else known, ["hi", "lo"], "left_anti").drop("hi", "lo")
        made = store.write(fresh, one_run=run is not None)
        store.discard(name)
        return made, store.attempt_counts(made)[0]
    finally:
        files, where = store.log.files(looked_up)
        files.delete(where, True)
