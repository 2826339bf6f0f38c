"""Duplicate suppression in a stream's own state, which begins with the ids that the store has.

The state holds the ids of every event that the stream has let through, in RocksDB and in the checkpoint, and is asked for the batch's
own ids only; the store's ledger is read once, when the query starts for the first time. So a batch costs what it holds, whatever
the store has. Ids lie packed in buckets, which a large batch asks for and writes once each, not once for each id. The stream must be the store's only writer from then on: the state does not learn of others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulse.functions.parsing import parse_events, without_text
from pulse.sinks.event_store import EventStore, id_numbers

#: State groups. A group's ids are one map, asked by key; its seeds come to one task, in parts.
GROUPS = 64
#: Ids of a bucket, on the average at most, and ids of a group that a task holds before it writes their buckets.
BUCKET_IDS, HELD = 256, 1 << 20
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: pd.DataFrame) -> list[bytes]:
    raw = np.column_stack([rows[name].to_numpy("int64") for name in ("hi", "lo")]).astype(">i8").tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


class _Known:
    """A group's ids in the state: a hash table of packed buckets, which doubles as it fills."""

    def __init__(self, buckets, size):
        self._buckets, self._size = buckets, size
        self._bits, self._count = size.get() or (0, 0)
        self._held: dict[int, set[bytes]] = {}
        self._changed: set[int] = set()
        self._rows = 0

    def _bucket(self, place: int) -> set[bytes]:
        found = self._buckets.getValue((place,))
        raw = bytes(found[0]) if found else b""
        return {raw[k : k + 16] for k in range(0, len(raw), 16)}

    def add(self, own: bytes) -> bool:
        """Whether the id is new."""
        place = zlib.crc32(own) & ((1 << self._bits) - 1)
        ids = self._held.get(place)
        if ids is None:
            ids = self._held[place] = self._bucket(place)
            self._rows += len(ids)
        if own in ids:
            return False
        ids.add(own)
        self._changed.add(place)
        self._count, self._rows = self._count + 1, self._rows + 1
        if self._rows >= HELD:
            self.flush()
        return True

    def flush(self) -> None:
        bits = self._bits
        while self._count > BUCKET_IDS << bits:
            bits += 1
        # A table that grows is written whole, which over its life costs each id a few times.
        for place in range(1 << self._bits) if bits > self._bits else self._changed:
            ids = self._held[place] if place in self._held else self._bucket(place)
            parts: dict[int, list[bytes]] = {place: []}
            for own in ids:
                parts.setdefault(zlib.crc32(own) & ((1 << bits) - 1), []).append(own)
            for part, owns in parts.items():
                self._buckets.updateValue((part,), (b"".join(owns),))
        self._size.update((bits, self._count))
        self._bits, self._rows = bits, 0
        self._held.clear()
        self._changed.clear()


class _Seen(StatefulProcessor):
    """Rows whose id is not in the state, which then has it. Copies within a batch all pass; the batch keeps the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._buckets = handle.getMapState("buckets", "bucket LONG", "ids BINARY")
        self._size = handle.getValueState("size", "bits INT, ids LONG")

    def handleInitialState(self, key, seeds: pd.DataFrame, timers) -> None:
        known = _Known(self._buckets, self._size)
        for own in _packed(seeds):
            known.add(own)
        known.flush()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known, fresh = _Known(self._buckets, self._size), set()
        for part in rows:
            passed = []
            for fine, own in zip(part["accepted"].tolist(), _packed(part)):
                if fine and known.add(own):
                    fresh.add(own)
                passed.append(not fine or own in fresh)
            yield part[passed]
        known.flush()

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("state_group", F.pmod(F.xxhash64("hi", "lo"), F.lit(groups)).cast("int"))


def unseen(log: DataFrame, store: EventStore, groups: int = GROUPS) -> DataFrame:
    """The parsed records of a stream without events that the store had at the start or that have come in an earlier batch."""
    parsed = without_text(parse_events(log))
    # A rejected record has no id; it is dealt by its text.
    hi, lo = id_numbers()
    fine = F.col("accepted")
    numbered = parsed.withColumns({"hi": F.when(fine, hi).otherwise(F.xxhash64("value")), "lo": F.when(fine, lo).otherwise(F.lit(0))})
    seeds = _grouped(store.ids().select("hi", "lo"), groups)
    fresh = _grouped(numbered, groups).groupBy("state_group").transformWithStateInPandas(
        statefulProcessor=_Seen(),
        outputStructType=_grouped(numbered, groups).schema,
        outputMode="append",
        timeMode="none",
        initialState=seeds.groupBy("state_group"),
    )
    return fresh.drop("state_group", "hi", "lo")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
