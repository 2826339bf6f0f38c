"""Event-log readers: Kafka topics, and Kafka-shaped tables with the same columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.schemas import KAFKA_RECORD


def topic_options(servers: str, topic: str, mode: str = "batch", **extra: str) -> dict[str, str]:
    """Options of the Kafka source for one ingestion mode.

    ``batch`` reads what lies between the two offsets. ``microbatch`` and ``streaming`` read on from
    the earliest record and go on past records the broker has already dropped. ``streaming`` also
    asks the broker to answer at once, with whatever it has.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if mode == "batch":
        options["endingOffsets"] = "latest"
    elif mode == "microbatch":
        options["failOnDataLoss"] = "false"
    elif mode == "streaming":
        options |= {
            "failOnDataLoss": "false",
            "kafka.fetch.min.bytes": "1",
            "kafka.fetch.max.wait.ms": "100",
        }
    else:
        raise ValueError(f"unknown mode: {mode}")
    return options | extra


def read_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("kafka").options(**options).load()


def stream_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KAFKA_RECORD).parquet(path)


def stream_log_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(KAFKA_RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


Place = int | tuple[str, int]


def between_offsets(log: DataFrame, starts: dict[Place, int] | None = None, ends: dict[Place, int] | None = None):
    """Records from a start offset up to, but without, an end offset, by (topic, partition), or by partition alone
    if the log is of one topic.

    A partition that is not listed is read from its first, or to its last, record. The bounds are
    one entry per topic partition, so they go into the filter as literals and reach the scan.
    """
    offset = F.col("offset")

    def elsewhere(place: Place):
        topic, number = place if isinstance(place, tuple) else (None, place)
        other = F.col("partition") != number
        return other if topic is None else other | (F.col("topic") != topic)

    keep = F.lit(True)
    for place, first in (starts or {}).items():
        keep = keep & (elsewhere(place) | (offset >= first))
    for place, end in (ends or {}).items():
        keep = keep & (elsewhere(place) | (offset < end))
    return log.where(keep)


def log_ends(log: DataFrame) -> dict[Place, int]:
    """The end offset of each (topic, partition) as it is now: fixed before a pass, it makes the pass the same however often it is
    read while the log grows. One row for each partition comes to the driver."""
    ends = log.groupBy("topic", "partition").agg(F.max("offset").alias("last")).collect()
    return {(row["topic"], row["partition"]): row["last"] + 1 for row in ends}


def offsets_option(places: dict[tuple[str, int], int]) -> str:
    """Offsets as the Kafka source takes them, for ``startingOffsets`` or ``endingOffsets`` of ``topic_options``."""
    topics: dict[str, dict[str, int]] = {}
    for (topic, number), offset in sorted(places.items()):
        topics.setdefault(topic, {})[str(number)] = offset
    return json.dumps(topics)
