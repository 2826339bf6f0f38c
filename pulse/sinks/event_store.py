"""The event sink as a partitioned table: one row per event id, safe to write again.

Under ``path``, each attempt has a folder of events by run and one of rejected records; ``_ledger`` has the attempts' ids, and
``_manifest`` says which attempts are in effect (see ``manifests``). An id is two whole numbers, its 128 bits.

A small attempt's ids lie in one piece; those of a large or folded one in a fixed number of hash buckets, each a folder of
files in order of the ids. A batch looks its ids up in the ledger alone: it opens its own buckets, its ids go to
the tasks that read them if they are few enough, and no stored event is read or shuffled. Attempts of a size
are folded into a larger one as soon as there are ``FOLD`` of them, so a store of any number of batches has few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions.columns import label_or, now_ms
from pulse.schemas import KEY, SINK_DEFAULTS, SINK_EVENT
from pulse.sinks.manifests import Attempt, Batches, Manifest, ManifestLog, new_name

Run = tuple[str, str, str]

#: Attempts of one level that are folded into one of the next, and rows of the largest attempt of level 0.
FOLD, BASE_ROWS = 16, 1 << 20
#: Hash buckets of the ledger's larger attempts.
BUCKETS = 64
#: Ids that are sent to all tasks: 16 bytes each.
SENT_IDS = 1 << 20

_STORED = T.StructType([*SINK_EVENT.fields, T.StructField("batch_id", T.StringType())])
_QUARANTINE = "value STRING, reject_reasons ARRAY<STRING>, batch_id STRING"
_LEDGER = "hi LONG, lo LONG, strategy STRING, scenario STRING, run_id STRING, batch_id STRING, bucket INT"
_ID = ["hi", "lo"]
#: The bucket of attempts that lie in one piece.
_WHOLE = -1


def id_numbers(event_id: str = "event_id") -> list[Column]:
    """The 128 bits of an id as two signed whole numbers."""
    digits = F.regexp_replace(event_id, "-", "")
    return [F.conv(F.substring(digits, first, 16), 16, -10).cast("long").alias(name) for name, first in (("hi", 1), ("lo", 17))]


def bucket_of_id() -> Column:
    return F.pmod(F.xxhash64(*_ID), F.lit(BUCKETS)).cast("int")


def level_of(rows: int) -> int:
    return 0 if rows <= BASE_ROWS else 1 + int(math.log(rows / BASE_ROWS, FOLD))


class EventStore:
    """Events under ``path``. Ingesting a batch again replaces what that batch wrote before, all of it, and nothing else.

    ``stamp`` gives ``visible_at``: the time of the write, one value for a whole batch as ``current_timestamp`` is
    fixed within a query; it does not show when single rows became visible.
    """

    def __init__(self, spark: SparkSession, path: str, stamp: Column | None = None):
        self.spark, self.path, self.stamp = spark, path.rstrip("/"), stamp
        self._ledgers: dict[str, DataFrame] = {}

    @cached_property
    def log(self) -> ManifestLog:
        return ManifestLog(self.spark, f"{self.path}/_manifest")

    @property
    def ledger_path(self) -> str:
        return f"{self.path}/_ledger"

    def manifest(self) -> Manifest:
        return self.log.latest()

    # --- reading ---

    def events(self) -> DataFrame:
        return self._events(self.manifest().attempts).select(*_STORED.names)

    def quarantine(self) -> DataFrame:
        return self._rejected(self.manifest().attempts).select("value", "reject_reasons", "batch_id")

    def _read(self, base: str, paths: list[str], schema: T.StructType | str) -> DataFrame:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        whole = T.StructType([*fields.fields, T.StructField("attempt", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", base).parquet(*paths)

    def _events(self, attempts: Sequence[Attempt]) -> DataFrame:
        found = [a for a in attempts if a.events]
        paths = [f"{self.path}/attempt={a.name}/accepted=true" for a in found]
        return _in_effect(self._read(self.path, paths, _STORED), found)

    def _rejected(self, attempts: Sequence[Attempt]) -> DataFrame:
        found = [a for a in attempts if a.rejected]
        paths = [f"{self.path}/attempt={a.name}/accepted=false" for a in found]
        return _in_effect(self._read(self.path, paths, _QUARANTINE), found, runs=False)

    def _ledger(self, attempt: Attempt) -> DataFrame:
        """One attempt's ids. Its files never change, so they are listed once, not once for each batch."""
        if attempt.name not in self._ledgers:
            self._ledgers[attempt.name] = self._read(self.ledger_path, [f"{self.ledger_path}/attempt={attempt.name}"], _LEDGER)
        return _in_effect(self._ledgers[attempt.name], [attempt])

    def ids(self) -> DataFrame:
        """The ids (hi, lo) of all events in the store, with their labels and batch, out of the ledger."""
        found = [self._ledger(a) for a in self.manifest().attempts if a.events]
        empty = self._read(self.ledger_path, [], _LEDGER)
        return reduce(DataFrame.unionByName, found or [empty]).select(*_ID, *KEY, "batch_id")

    def known(self, ids: DataFrame, count: int, batch_id: str | None = None, run: Run | None = None) -> DataFrame | None:
        """Those of ``count`` ids (hi, lo) that the store has, from other batches than ``batch_id``; with ``run``, from that run alone.
        None if no attempt can have one."""
        attempts = [a for a in self.manifest().attempts if a.events and (batch_id not in a.batches or a.batches.without(batch_id))]
        self._ledgers = {a.name: self._ledgers[a.name] for a in self.manifest().attempts if a.name in self._ledgers}
        if not attempts:
            return None
        found = reduce(DataFrame.unionByName, [self._ledger(a) for a in attempts])
        if count < BUCKETS and any(a.level for a in attempts):
            own = [row[0] for row in ids.select(bucket_of_id().alias("b")).distinct().collect()]
            found = found.where(F.col("bucket").isin(_WHOLE, *own))
        if batch_id is not None:
            found = found.where(F.col("batch_id") != batch_id)
        if run:
            found = found.where(_of_run(run))
        few = ids.select(*_ID)
        return found.select(*_ID).join(F.broadcast(few) if count <= SENT_IDS else few, _ID, "left_semi")

    # --- writing ---

    def staged(self, parsed: DataFrame, batch_id: str) -> DataFrame:
        """Rows as they are written: accepted ones with labels and stamp, and rejected ones with their text and reasons."""
        fine = F.col("accepted")
        stamp = self.stamp if self.stamp is not None else now_ms()
        labels = {c: F.when(fine, label_or(c, default)).otherwise(F.lit("rejected")) for c, default in SINK_DEFAULTS.items()}
        own = {c: F.when(fine, F.col(c)).alias(c) for c in ("event_id", "produced_at", "payload")}
        more = {
            "visible_at": F.when(fine, stamp).cast("long"),
            "batch_id": F.lit(batch_id),
            "value": F.when(~fine, F.col("value")),
            "reject_reasons": F.when(~fine, F.col("reject_reasons")),
        }
        return parsed.withColumns(labels | more).withColumns(own).select(*_STORED.names, "value", "reject_reasons", "accepted")

    def write(self, rows: DataFrame, one_run: bool = False) -> str:
        """Staged rows as a new attempt, which nobody sees yet; its name.

        Rebalancing gathers each run's rows into files of a good size and, unlike a repartition by run, splits a run
        that is too large for one task.
        """
        name, parts = new_name(), ["accepted", *KEY]
        (
            (rows if one_run else rows.hint("rebalance", *parts))
            .sortWithinPartitions(*parts, "visible_at", "event_id")
            .write.partitionBy(*parts)
            .parquet(f"{self.path}/attempt={name}")
        )
        return name

    def attempt_rows(self, name: str) -> DataFrame:
        """The rows of an attempt that is not in effect yet."""
        schema = f"{_STORED.toDDL()}, value STRING, reject_reasons ARRAY<STRING>, accepted BOOLEAN"
        return self._read(self.path, [f"{self.path}/attempt={name}"], schema).drop("attempt")

    def attempt_ids(self, name: str) -> DataFrame:
        rows = self.attempt_rows(name).where("accepted")
        return rows.select(*id_numbers(), *KEY, "batch_id")

    def attempt_counts(self, name: str) -> tuple[int, int]:
        """Events and rejected records of an attempt, by its files: right even if tasks were run again."""
        counted = self.attempt_rows(name).groupBy("accepted").agg(F.count("*").alias("n")).collect()
        counts = {row["accepted"]: row["n"] for row in counted}
        return counts.get(True, 0), counts.get(False, 0)

    def discard(self, name: str) -> None:
        for folder in (self.path, self.ledger_path):
            files, where = self.log.files(f"{folder}/attempt={name}")
            files.delete(where, True)

    def add(self, name: str, batch_id: str, events: int, rejected: int) -> None:
        """Put an attempt in effect as all that the batch wrote."""
        made = None
        if events or rejected:
            made = Attempt(name, level_of(events + rejected), events, rejected, Batches.of(batch_id))
            if events:
                self._write_ledger(self.attempt_ids(name), name, made.level)
        else:
            self.discard(name)
        now = self.manifest()
        if made or any(batch_id in a.batches for a in now.attempts):
            self._commit(now.with_batch(batch_id, made))
            self.fold()

    def _write_ledger(self, ids: DataFrame, name: str, level: int) -> None:
        if level:
            placed = ids.withColumn("bucket", bucket_of_id())
            ordered = placed.repartition("bucket").sortWithinPartitions("bucket", *_ID)
        else:
            # At most BASE_ROWS ids of 16 bytes.
            ordered = ids.withColumn("bucket", F.lit(_WHOLE)).coalesce(1).sortWithinPartitions(*_ID)
        ordered.write.partitionBy("bucket").parquet(f"{self.ledger_path}/attempt={name}")

    def _commit(self, manifest: Manifest) -> None:
        self.log.commit(manifest, (self.path, self.ledger_path))

    def fold(self) -> None:
        """Put the attempts of a level together, if there are ``FOLD`` of them, without what no longer counts of them."""
        while True:
            now = self.manifest()
            by_level: dict[int, list[Attempt]] = {}
            for attempt in now.attempts:
                by_level.setdefault(attempt.level, []).append(attempt)
            old = next((group for level, group in sorted(by_level.items()) if len(group) >= FOLD), None)
            if old is None:
                return
            accepted = self._events(old).drop("attempt").withColumn("accepted", F.lit(True))
            rejected = self._rejected(old).drop("attempt").withColumn("accepted", F.lit(False))
            labelled = rejected.withColumns({c: F.lit("rejected") for c in KEY})
            rows = accepted.select(*_STORED.names, "accepted").unionByName(labelled, allowMissingColumns=True)
            name = self.write(rows)
            events, bad = self.attempt_counts(name)
            level = max(old[0].level + 1, level_of(events + bad))
            if events:
                ids = reduce(DataFrame.unionByName, [self._ledger(a) for a in old if a.events])
                self._write_ledger(ids.select(*_ID, *KEY, "batch_id"), name, level)
            batches = reduce(lambda a, b: a | b, [a.batches for a in old])
            self._commit(now.folded(old, Attempt(name, level, events, bad, batches)))

    def empty_run(self, strategy: str, scenario: str, run_id: str) -> None:
        """Remove one run's rows, and no other's, before the run starts. Its ids may come again."""
        if self.manifest().attempts:
            self._commit(self.manifest().without_run((strategy, scenario, run_id)))

    def vacuum(self) -> list[str]:
        """Remove attempts that no manifest names: what crashed writers left. Not while a writer is at work."""
        now, gone = self.manifest(), []
        named = {a.name for a in now.attempts} | {name for _, name in now.retired}
        for folder in (self.path, self.ledger_path):
            files, where = self.log.files(folder)
            for found in files.listStatus(where) if files.exists(where) else ():
                name = found.getPath().getName()
                if name.startswith("attempt=") and name.removeprefix("attempt=") not in named:
                    files.delete(found.getPath(), True)
                    gone.append(name.removeprefix("attempt="))
        return sorted(set(gone))


def _of_run(run: Run) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == value for c, value in zip(KEY, run)])


def _in_effect(rows: DataFrame, attempts: Sequence[Attempt], runs: bool = True) -> DataFrame:
    """Without rows of batches that were written again since, and of runs that were emptied."""
    for attempt in attempts:
        own = F.col("attempt") == attempt.name
        if attempt.replaced:
            rows = rows.where(~(own & F.col("batch_id").isin(*attempt.replaced)))
        for run in attempt.emptied if runs else ():
            rows = rows.where(~(own & _of_run(run)))
    return rows
