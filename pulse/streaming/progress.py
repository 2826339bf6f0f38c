"""A stream's progress as a table, and the rule that ends a stream which has run dry.

Spark tells a listener what each micro-batch took in, and every so often that there was nothing to take in. Both become rows, numbered
in the order in which they are told, in files of up to ``SEGMENT`` rows; the file that is being filled is written anew with each row.
"""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pulse.operators.timeline import drain_point

ROWS = "query STRING, batch_id LONG, stream_batch LONG, num_input_rows LONG, ts LONG"
SEGMENT = 1000


class ProgressTable(StreamingQueryListener):
    """Progress rows of the session's streams under ``path``; of one query alone, if ``name`` is given."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self._rows: list[dict] = []
        self._told, self._names, self._lock = 0, {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        told = event.progress
        self._append(told.name, told.batchId, told.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._append(self._names.get(str(event.id)), None, 0)

    def onQueryTerminated(self, event) -> None:
        pass

    def _append(self, query: str | None, stream_batch: int | None, rows: int) -> None:
        if self.name is not None and query != self.name:
            return
        with self._lock:
            row = {"query": query, "batch_id": self._told, "stream_batch": stream_batch, "num_input_rows": rows, "ts": int(time.time() * 1000)}
            self._rows.append(row)
            self._told += 1
            self._write(f"{self.path}/rows-{(self._told - 1) // SEGMENT:09d}.json")
            if self._told % SEGMENT == 0:
                self._rows = []

    def _write(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        out = files.create(where, True)
        out.write(bytearray("\n".join(json.dumps(row) for row in self._rows), "utf-8"))
        out.close()

    def read(self) -> DataFrame:
        with self._lock:
            return self.spark.read.schema(ROWS).json(self.path) if self._told else self.spark.createDataFrame([], ROWS)

    def drained(self, stable: int) -> bool:
        """Whether ``stable`` reports in a row have told of no rows, after one that did or from the start."""
        with self._lock:
            if not self._told:
                return False
        found = drain_point(self.read(), stable, keys=["query"]).first()
        return found is not None and found["drained_batch"] is not None


def run_until_drained(query: StreamingQuery, progress: ProgressTable, stable: int = 3, every_s: float = 1.0) -> None:
    """Let a stream that never ends run until its own progress says that it is drained, then stop it.

    Reports of an idle stream come at ``spark.sql.streaming.noDataProgressEventInterval`` at the least, 10 s if it is not set.
    """
    while query.isActive and not progress.drained(stable):
        query.awaitTermination(every_s)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
