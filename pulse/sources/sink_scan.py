"""Reads of the event sink: pages after a cursor, and one run's samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions.columns import label_or, latency_ms, of_run
from pulse.schemas import LATENCY_SAMPLE, SINK_DEFAULTS, SINK_PAGE_ROWS
from pulse.session import shared_dir

#: Rows that one task numbers, about.
_PART_ROWS = 1 << 17


def _after(cursor: tuple[int, str]) -> Column:
    seen_at, seen_id = cursor
    later = (F.col("visible_at") > seen_at) | ((F.col("visible_at") == seen_at) & (F.col("event_id") > seen_id))
    # The first condition alone is what a scan can use to skip row groups.
    return (F.col("visible_at") >= seen_at) & later


def next_page(
    sink: DataFrame, run: tuple[str, str, str] | None, cursor: tuple[int, str], rows: int = SINK_PAGE_ROWS
) -> DataFrame:
    """The next rows in ``(visible_at, event_id)`` order after the cursor.

    A page is full while more may follow; its last row is the next cursor. The page size bounds
    what is sorted out (top-k per task, then of the tasks' results). On Spark tables prefer a
    stream: its checkpoint replaces the cursor and cannot miss rows committed late.
    """
    if run:
        sink = sink.where(of_run(*run))
    page = sink.where(_after(cursor))
    return page.orderBy("visible_at", "event_id").limit(rows)


@dataclass(frozen=True)
class FileRange:
    """A file of the sink, with its rows and the span of their visible times."""

    path: str
    rows: int
    first: int
    last: int


def file_ranges(sink: DataFrame) -> list[FileRange]:
    """The span of each file of a file-based sink: one small row for each file comes to the driver."""
    by_file = sink.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("rows"), F.min("visible_at").alias("first"), F.max("visible_at").alias("last")
    )
    return [FileRange(**row.asDict()) for row in by_file.where(F.col("first").isNotNull()).collect()]


def files_of_page(ranges: Sequence[FileRange], after_ms: int, rows: int) -> list[FileRange]:
    """The files that can hold the next ``rows`` rows from ``after_ms`` on.

    Files that begin later are all unread. In the order of their ends, as many of them as make up a page show by when the
    page must be full; what begins after that is not opened.
    """
    left, found = [r for r in ranges if r.last >= after_ms], 0
    for unread in sorted((r for r in left if r.first > after_ms), key=lambda r: r.last):
        found += unread.rows
        if found >= rows:
            return [r for r in left if r.first <= unread.last]
    return left


def pages(
    sink: DataFrame, run: tuple[str, str, str] | None = None, cursor: tuple[int, str] = (-(1 << 63), ""), rows: int = SINK_PAGE_ROWS
) -> Iterator[list[Row]]:
    """All rows after the cursor in ``(visible_at, event_id)`` order, page by page, until a page is not full.

    The files' spans are taken once, so a page opens only the files that can hold it. Rows that come later belong to the
    next call, from the last row's cursor on. Each page is a job: for a walk over all of a large run's pages
    take ``numbered_pages``.
    """
    own = sink.where(of_run(*run)) if run else sink
    ranges = file_ranges(own)
    while True:
        near = files_of_page(ranges, cursor[0], rows)
        if not near:
            return
        page = next_page(own.where(F.col("_metadata.file_path").isin([r.path for r in near])), None, cursor, rows).collect()
        if page:
            yield page
        if len(page) < rows:
            return
        cursor = (page[-1]["visible_at"], page[-1]["event_id"])


def numbered_pages(
    sink: DataFrame, run: tuple[str, str, str] | None = None, cursor: tuple[int, str] = (-(1 << 63), ""), rows: int = SINK_PAGE_ROWS
) -> DataFrame:
    """The rows of ``pages`` as a table, with the number of their ``page``, in a few jobs however many pages there are.

    The rows are cut into ranges of ``(visible_at, event_id)`` and kept in them; a row's place is its place in its range
    after the rows of the ranges before. So no task holds more than a range, and no page comes to the driver.
    """
    spark = sink.sparkSession
    own = (sink.where(of_run(*run)) if run else sink).where(_after(cursor))
    ranges = max(1, -(-own.count() // _PART_ROWS))
    folder = shared_dir(spark, "pages")
    placed = own.repartitionByRange(ranges, "visible_at", "event_id").withColumn("_range", F.spark_partition_id())
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    # One small row for each range.
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ends = placed.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("visible_at", "event_id")) - 1
    numbered = placed.withColumn("_place", place).join(F.broadcast(ends), "_range")
    return numbered.select(F.expr(f"(_before + _place) div {rows}").alias("page"), *own.columns)


def latency_samples(sink: DataFrame, run: tuple[str, str, str] | None = None) -> DataFrame:
    """Sample rows of the sink, of one run or of all: labels defaulted, latency derived."""
    if run:
        sink = sink.where(of_run(*run))
    labels = [label_or(c, default).alias(c) for c, default in SINK_DEFAULTS.items()]
    samples = sink.select("event_id", *labels, "produced_at", "visible_at")
    return samples.withColumn("latency_ms", latency_ms().cast("double")).select(*LATENCY_SAMPLE.names)


def run_samples(samples: DataFrame, strategy: str, scenario: str, run_id: str) -> DataFrame:
    """One run out of a table that holds many."""
    return samples.where(of_run(strategy, scenario, run_id))


def read_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    run: tuple[str, str, str] | None = None,
    stripes: int | None = None,
    lower_ms: int | None = None,
    upper_ms: int | None = None,
) -> DataFrame:
    """A sink table over JDBC. The run filter is pushed to the database; ``stripes`` splits the
    read on ``visible_at`` so that it does not go through one task."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if stripes:
        reader = (
            reader.option("partitionColumn", "visible_at")
            .option("lowerBound", str(lower_ms))
            .option("upperBound", str(upper_ms))
            .option("numPartitions", str(stripes))
        )
    df = reader.load()
    return df.where(of_run(*run)) if run else df
