"""Live figures of a sink or sample stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse.operators.order_stats import MS_WIDTH, quantiles_of_counts, value_counts
from pulse.schemas import LATENCY_BOUNDS, LATENCY_SAMPLE
from pulse.sinks.event_store import FOLD
from pulse.sinks.manifests import Attempt, Batches, ManifestLog, new_name
from pulse.sources.sink_scan import latency_samples
from pulse.streaming.ingest import trigger, writer

LABELS = ["strategy", "scenario"]


def live_visibility(samples: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Rows seen, latency histogram and last visible time by strategy and scenario.

    Works on a stream and on a table. The state is one row per label pair; every task adds up its
    own rows first.
    """
    x = F.col("latency_ms")
    return samples.groupBy(*LABELS).agg(
        F.count("*").alias("rows_seen"),
        F.max("visible_at").alias("last_visible_at_ms"),
        F.sum(x).alias("latency_sum_ms"),
        *[F.count_if(x <= b).alias(f"le_{b}") for b in bounds],
    )


COUNTS = "window_start_ms LONG, strategy STRING, scenario STRING, latency_ms LONG, n LONG"
_WINDOW = ["window_start_ms", *LABELS]


class WindowCounts:
    """A stream's rows counted by window of production time, labels and latency, under ``path``.

    Each micro-batch adds a small table, which a manifest names; a repeat of the batch takes its place. As soon as there are
    ``FOLD`` tables of a size they are added up into one, so that a reader opens few files, however long the stream has run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = ManifestLog(spark, f"{self.path}/_manifest")

    def read(self) -> DataFrame:
        return self._read(self.log.latest().attempts)

    def _read(self, attempts: Sequence[Attempt]) -> DataFrame:
        tables = [f"{self.path}/attempt={a.name}" for a in attempts]
        if not tables:
            return self.spark.createDataFrame([], f"{COUNTS}, batch STRING")
        rows = self.spark.read.schema(f"{COUNTS}, batch STRING, attempt STRING").option("basePath", self.path).parquet(*tables)
        for attempt in attempts:
            if attempt.replaced:
                again = (F.col("attempt") == attempt.name) & F.col("batch").isin(*attempt.replaced)
                rows = rows.where(~F.coalesce(again, F.lit(False)))
        return rows.drop("attempt")

    def add(self, counts: DataFrame, number: int) -> None:
        batch, name = f"batch-{number:012d}", new_name()
        counts.withColumn("batch", F.lit(batch)).write.parquet(f"{self.path}/attempt={name}")
        self.log.commit(self.log.latest().with_batch(batch, Attempt(name, 0, 1, 0, Batches.of(batch))), (self.path,))
        self.fold()

    def fold(self) -> None:
        while True:
            now = self.log.latest()
            levels = sorted({a.level for a in now.attempts})
            groups = ([a for a in now.attempts if a.level == level] for level in levels)
            old = next((group for group in groups if len(group) >= FOLD), None)
            if old is None:
                return
            name = new_name()
            # A stream repeats no batch but its latest, whose counts therefore stay apart.
            newest = max(last for a in old for _, _, last in a.batches.ranges)
            latest = F.when(F.col("batch") == f"batch-{newest:012d}", F.col("batch"))
            merged = self._read(old).groupBy(*_WINDOW, "latency_ms", latest.alias("batch")).agg(F.sum("n").alias("n"))
            merged.select(*_WINDOW, "latency_ms", "n", "batch").write.parquet(f"{self.path}/attempt={name}")
            batches = reduce(lambda a, b: a | b, [a.batches for a in old])
            self.log.commit(now.folded(old, Attempt(name, old[0].level + 1, 1, 0, batches)), (self.path,))


def count_latencies(
    samples: DataFrame, path: str, checkpoint: str, mode: str = "microbatch", width_ms: int = 10_000
) -> StreamingQuery:
    """Keep, under ``path``, the stream's rows counted by window of production time, labels and latency.

    No window is ever closed: a late row adds to its window's counts like any other, and none is dropped.
    """
    start = F.col("produced_at") - F.pmod("produced_at", F.lit(width_ms))
    store = WindowCounts(samples.sparkSession, path)

    def add(batch: DataFrame, number: int) -> None:
        own = value_counts(batch.withColumn("window_start_ms", start), _WINDOW, "latency_ms")
        store.add(own.withColumn("latency_ms", F.col("latency_ms").cast("long")), number)

    return writer(samples, checkpoint, trigger(mode)).foreachBatch(add).start()


def live_latency(spark: SparkSession, path: str) -> DataFrame:
    """Exact rows, p50, p95 and p99 of every window so far, from the counts under ``path``."""
    merged = WindowCounts(spark, path).read().groupBy(*_WINDOW, "latency_ms").agg(F.sum("n").alias("n"))
    probs = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
    return quantiles_of_counts(merged, _WINDOW, "latency_ms", probs, width=MS_WIDTH, extra=[F.sum("n").alias("rows_seen")])


def append_samples(events: DataFrame, path: str, checkpoint: str, mode: str = "microbatch") -> StreamingQuery:
    """Write the samples of events as they become visible."""
    samples = latency_samples(events).select(*LATENCY_SAMPLE.names)
    return writer(samples, checkpoint, trigger(mode)).format("parquet").start(path)


def publish(figures: DataFrame, path: str, checkpoint: str, mode: str = "microbatch") -> StreamingQuery:
    """Keep ``path`` at the newest state of live figures: one small table, replaced per batch."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return writer(figures, checkpoint, trigger(mode), "complete").foreachBatch(replace).start()
