"""Continuous ingestion: the batch pipeline, once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from pulse.functions.parsing import accepted, parse_events
from pulse.plans.ingest import ingest, ingest_into_table, ingest_parsed
from pulse.sinks.event_store import EventStore
from pulse.sinks.jdbc import JdbcStore
from pulse.streaming.state import keyed_state, unseen

DEFAULT_INTERVAL = "5 seconds"


def trigger(mode: str, interval: str = DEFAULT_INTERVAL) -> dict:
    """Trigger of a mode: ``bounded`` takes what there is and stops, ``microbatch`` works in fixed
    steps, ``streaming`` starts the next step as soon as the last has ended."""
    if mode == "bounded":
        return {"availableNow": True}
    if mode == "microbatch":
        return {"processingTime": interval}
    if mode == "streaming":
        return {"processingTime": "0 seconds"}
    raise ValueError(f"unknown mode: {mode}")


def ingest_stream(
    log: DataFrame,
    store: EventStore,
    name: str,
    checkpoint: str,
    mode: str = "microbatch",
    interval: str = DEFAULT_INTERVAL,
    run: tuple[str, str, str] | None = None,
    spread: int | None = None,
    dedupe: str = "ledger",
) -> StreamingQuery:
    """Start ingesting a Kafka-shaped stream.

    ``checkpoint`` must belong to this run alone. A batch that is repeated after a failure has the
    same id, so the store replaces what the first attempt wrote; together with the offsets in the
    checkpoint each event is stored once. ``spread`` deals the records over that many tasks, for a
    source with few or uneven partitions.

    ``dedupe`` says where ids are looked up: in the store's ``ledger``, of which a batch opens its own buckets, or in the
    stream's own ``state``, which begins with the ledger and costs what a batch holds; see ``pulse.streaming.state``.
    """
    if dedupe not in ("ledger", "state"):
        raise ValueError(f"unknown dedupe: {dedupe}")

    def write(batch: DataFrame, number: int) -> None:
        source = batch.repartition(spread) if spread else batch
        if dedupe == "state":
            ingest_parsed(source, store, f"{name}-{number:012d}", run, unseen=True)
        else:
            ingest(source, store, f"{name}-{number:012d}", run)

    if dedupe == "ledger":
        return writer(log, checkpoint, trigger(mode, interval)).foreachBatch(write).start()
    with keyed_state(log.sparkSession):
        return writer(unseen(log, store), checkpoint, trigger(mode, interval)).foreachBatch(write).start()


def ingest_stream_into_table(
    log: DataFrame, table: JdbcStore, checkpoint: str, mode: str = "microbatch", interval: str = DEFAULT_INTERVAL
) -> StreamingQuery:
    """Start ingesting a Kafka-shaped stream into a database table. A repeated batch adds nothing, as the table has its ids."""

    def write(batch: DataFrame, number: int) -> None:
        ingest_into_table(batch, table)

    return writer(log, checkpoint, trigger(mode, interval)).foreachBatch(write).start()


def first_within(log: DataFrame, horizon: str) -> DataFrame:
    """Accepted events of a stream without the copies that come within ``horizon`` of the first.

    For streams whose copies are known to come soon: the state holds the ids of the horizon only,
    and no table is asked. Copies that come later are let through; the store has no such limit.
    """
    events = accepted(parse_events(log))
    timed = events.withColumn("produced_ts", F.timestamp_millis("produced_at"))
    return timed.withWatermark("produced_ts", horizon).dropDuplicatesWithinWatermark(["event_id"]).drop("produced_ts")


def writer(df: DataFrame, checkpoint: str, when: dict, output: str = "append") -> DataStreamWriter:
    return df.writeStream.outputMode(output).option("checkpointLocation", checkpoint).trigger(**when)


def run_to_end(query: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for a bounded query, however long it takes. With a deadline, a query that has not ended by then is
    stopped, which is an error: what it has written is not all there is."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream had not ended after {timeout_s} s and was stopped; its output is not complete")
