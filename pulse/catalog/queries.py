"""The named queries. Each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.catalog import inputs
from pulse.functions import columns as col
from pulse.functions import parsing
from pulse.operators import keys, matrix, order_stats, ranks, telemetry, timeline
from pulse.plans import quality, reports, snapshot
from pulse.plans.ingest import clean_events, ingest
from pulse.schemas import (
    GENERATOR_FILE,
    KEY,
    LAG_FILE,
    LATENCY_FILE,
    LATENCY_SAMPLE,
    METADATA_FILE,
    PRODUCE_BOUNDS,
    RESOURCES_FILE,
    SCENARIO_LABELS,
    SCENARIOS,
    SNAPSHOT_FILE,
    STRATEGIES,
    STRATEGY_LABELS,
    SUMMARY_FILE,
)
from pulse.session import shared_dir
from pulse.sinks import files
from pulse.sinks.event_store import EventStore
from pulse.sources import artifacts
from pulse.sources.kafka import between_offsets, log_ends, read_log_table, stream_log_table
from pulse.sources.sink_scan import latency_samples, next_page, numbered_pages, run_samples
from pulse.streaming.ingest import ingest_stream, run_to_end
from pulse.streaming.monitor import append_samples, count_latencies, live_latency, live_visibility, publish
from pulse.streaming.progress import ProgressTable, run_until_drained

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _as_double(df: DataFrame, *names: str) -> DataFrame:
    """Whole-number columns that may be null, as doubles: clients differ in how they show those."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating-point columns rounded: sums differ in their last bits with the order of addition."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


_ENVELOPE = ["event_id", "produced_at", "payload", *KEY]


# --- ingestion --------------------------------------------------------------------------


@_query
def latency_by_scenario_strategy(spark, sf_dir):
    """Flagship: JSON log, parse, reject, first copy, latency, exact quantiles."""
    events = clean_events(inputs.kafka_log(spark, sf_dir)).withColumn("visible_at", inputs.seen_at())
    timed = events.withColumn("latency_ms", col.latency_ms())
    stats = _rounded(reports.scenario_stats(timed), 3)
    return keys.in_display_order(stats)


@_query
def ingest_accept_reject(spark, sf_dir):
    return parsing.reject_counts(parsing.parse_events(inputs.kafka_log(spark, sf_dir)))


@_query
def ingest_quarantine(spark, sf_dir):
    rejected = parsing.rejected(parsing.parse_events(inputs.kafka_log(spark, sf_dir)))
    return rejected.select("partition", "offset", F.array_join("reject_reasons", ",").alias("reasons"))


@_query
def ingest_first_wins(spark, sf_dir):
    return clean_events(inputs.kafka_log(spark, sf_dir)).select(*_ENVELOPE)


@_query
def shipping_first_wins(spark, sf_dir):
    """First copy of ids that really repeat; the order names every column that tells copies apart."""
    log = inputs.shipping_log(spark, sf_dir)
    return keys.first_wins(log, "event_id", inputs.SHIPPING_ORDER)


@_query
def ingest_insert_if_absent(spark, sf_dir):
    fresh = clean_events(inputs.kafka_log(spark, sf_dir)).select(*_ENVELOPE)
    stored = inputs.event_log(spark, sf_dir).where(F.col("event_no") % 2 == 0)
    return keys.insert_if_absent(fresh, stored, small_batch=True)


@_query
def ingest_bounded_offsets(spark, sf_dir):
    log = inputs.kafka_log(spark, sf_dir)
    part = between_offsets(log, starts={p: 4 for p in range(12)}, ends={p: 100 for p in range(6)})
    return part.groupBy("partition").agg(
        F.count("*").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last")
    )


def _store(spark: SparkSession, label: str) -> EventStore:
    return EventStore(spark, shared_dir(spark, label), stamp=inputs.seen_at())


@_query
def ingest_replay(spark, sf_dir):
    """Two overlapping batches, then the first again, then the same records under a new id."""
    log = inputs.kafka_log(spark, sf_dir)
    part = log.where(F.col("partition") < 6)
    store = _store(spark, "replay")
    ingest(part, store, "a")
    ingest(log, store, "b")
    ingest(part, store, "a")
    ingest(part, store, "c")
    return store.events().select(*_ENVELOPE, "visible_at", "batch_id")


@_query
def ingest_repeat_changed(spark, sf_dir):
    """A batch, and then the same batch with fewer runs and no bad records: nothing of the first is left."""
    log = inputs.kafka_log(spark, sf_dir)
    store = _store(spark, "repeat")
    ingest(log, store, "a")
    good = parsing.parse_events(log).withColumn("key", F.lit(None).cast("binary")).where("accepted AND strategy = 'batch'")
    ingest(good.select("key", F.col("value").cast("binary"), "topic", "partition", "offset", "timestamp"), store, "a")
    left = store.events().select(*_ENVELOPE).withColumn("bad_records", F.lit(store.quarantine().count()).cast("long"))
    return left


def _log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a written table, in twelve parts as on a topic of twelve partitions: who takes one partition reads no other."""
    source = shared_dir(spark, "log")
    inputs.kafka_log(spark, sf_dir).write.partitionBy("partition").parquet(source)
    return read_log_table(spark, source)


@_query
def ingest_many_batches(spark, sf_dir):
    """The log in 24 batches, by partition and by even or odd offset, so that attempts are folded; second copies come in batches of their own."""
    log = _log_file(spark, sf_dir)
    store = _store(spark, "many")
    for odd in (0, 1):
        for number in range(12):
            part = log.where((F.col("partition") == number) & (F.col("offset") % 2 == odd))
            ingest(part, store, f"part-{odd * 12 + number:012d}")
    return store.events().select(*_ENVELOPE, "visible_at", "batch_id")


@_query
def ingest_one_scan(spark, sf_dir):
    """Accepted and rejected records of one pass, up to ends that were fixed before it; records by batch and reason."""
    log = _log_file(spark, sf_dir)
    store = _store(spark, "pinned")
    half = {place: end // 2 for place, end in log_ends(log).items()}
    ingest(between_offsets(log, ends=half), store, "first half")
    ingest(between_offsets(log, starts=half), store, "second half")
    accepted = store.events().groupBy("batch_id").agg(F.count("*").alias("records")).withColumn("reason", F.lit("accepted"))
    reasons = store.quarantine().select("batch_id", F.explode("reject_reasons").alias("reason"))
    return accepted.unionByName(reasons.groupBy("batch_id", "reason").agg(F.count("*").alias("records")))


@_query
def stream_dedupe_state(spark, sf_dir):
    """A store with a third of the log in it, and the whole log as a stream that knows ids by its own state, stopped and started again."""
    log, source = _log_file(spark, sf_dir), shared_dir(spark, "stream")
    store, offsets = _store(spark, "state"), shared_dir(spark, "offsets")
    ingest(log.where(F.col("partition") < 4), store, "load")
    for numbers in ((0, 8), (8, 12)):
        log.where(F.col("partition").between(numbers[0], numbers[1] - 1)).write.mode("append").parquet(source)
        run_to_end(ingest_stream(stream_log_table(spark, source), store, "run", offsets, "bounded", dedupe="state"))
    return store.events().select(*_ENVELOPE, "visible_at", F.col("batch_id").startswith("run").alias("streamed"))


@_query
def stream_equals_batch(spark, sf_dir):
    """The log as a stream of files, ingested in several micro-batches until it is used up."""
    source = shared_dir(spark, "log")
    inputs.kafka_log(spark, sf_dir).repartition(4, "partition").write.parquet(source)
    store = _store(spark, "stream")
    query = ingest_stream(
        stream_log_table(spark, source, files_per_batch=2), store, "run", shared_dir(spark, "offsets"), "bounded"
    )
    run_to_end(query)
    return store.events().select(*_ENVELOPE, "visible_at")


@_query
def stream_drains(spark, sf_dir):
    """The stream with a processing-time trigger, which never ends by itself: stopped by the drain rule on its own progress rows."""
    source = shared_dir(spark, "log")
    inputs.kafka_log(spark, sf_dir).repartition(4, "partition").write.parquet(source)
    store = _store(spark, "drains")
    idle = "spark.sql.streaming.noDataProgressEventInterval"
    before = spark.conf.get(idle, None)
    spark.conf.set(idle, "500")
    progress = ProgressTable(spark, shared_dir(spark, "progress"))
    spark.streams.addListener(progress)
    try:
        stream = stream_log_table(spark, source, files_per_batch=4)
        query = ingest_stream(stream, store, "run", shared_dir(spark, "offsets"), "microbatch", "200 milliseconds")
        run_until_drained(query, progress)
    finally:
        spark.streams.removeListener(progress)
        spark.conf.unset(idle) if before is None else spark.conf.set(idle, before)
    return store.events().select(*_ENVELOPE, "visible_at")


@_query
def live_latency_many_batches(spark, sf_dir):
    """Windows counted over twenty micro-batches, whose tables are added up on the way."""
    source, out = shared_dir(spark, "events"), shared_dir(spark, "windows")
    events = inputs.table(spark, sf_dir, "events")
    events.repartition(20, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_end(count_latencies(inputs.as_event_log(stream), out, shared_dir(spark, "offsets"), "bounded"))
    return _rounded(live_latency(spark, out), 3)


@_query
def stream_samples(spark, sf_dir):
    """Samples appended as they become visible."""
    source, out = shared_dir(spark, "sink"), shared_dir(spark, "samples")
    log = inputs.event_log(spark, sf_dir).select(*_ENVELOPE, "visible_at")
    log.write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    run_to_end(append_samples(stream, out, shared_dir(spark, "offsets"), "bounded"))
    return spark.read.schema(LATENCY_SAMPLE).parquet(out)


def _sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
    return inputs.as_event_log(stream.parquet(f"{sf_dir}/events.parque[t]"))


@_query
def live_monitor_stream(spark, sf_dir):
    out = shared_dir(spark, "monitor")
    figures = live_visibility(_sample_stream(spark, sf_dir))
    run_to_end(publish(figures, out, shared_dir(spark, "offsets"), "bounded"))
    return spark.read.parquet(out)


@_query
def live_latency_stream(spark, sf_dir):
    """Every window's exact figures, from the counts that the stream has written."""
    out = shared_dir(spark, "windows")
    run_to_end(count_latencies(_sample_stream(spark, sf_dir), out, shared_dir(spark, "offsets"), "bounded"))
    return _rounded(live_latency(spark, out), 3)


@_query
def live_gauge(spark, sf_dir):
    return live_visibility(inputs.samples(spark, sf_dir))


# --- typed domain events ----------------------------------------------------------------


@_query
def typed_domain_parse(spark, sf_dir):
    return parsing.domain_report(parsing.parse_domain(inputs.domain_log(spark, sf_dir)))


@_query
def domain_ticks(spark, sf_dir):
    ticks = parsing.domain_view(parsing.parse_domain(inputs.domain_log(spark, sf_dir)), "financial_tick")
    figures = ticks.groupBy("symbol", "exchange").agg(
        F.count("*").alias("ticks"),
        F.min("bid").alias("lowest_bid"),
        F.max("ask").alias("highest_ask"),
        F.sum("volume").alias("volume"),
    )
    return _rounded(figures)


@_query
def domain_views(spark, sf_dir):
    """Rows of each typed view, with one sum per view to check its fields."""
    parsed = parsing.parse_domain(inputs.domain_log(spark, sf_dir))
    sums = {"iot_sensor": "temperature_c", "financial_tick": "price", "health_monitor": "heart_rate_bpm"}
    views = [
        parsing.domain_view(parsed, kind).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("events"), F.sum(F.col(c).cast("double")).alias("total")
        )
        for kind, c in sums.items()
    ]
    return _rounded(matrix.union_all(*views), 4)


# --- scans of the sink, projections ---------------------------------------------------------


@_query
def sink_samples(spark, sf_dir):
    """Labels defaulted on read: every tenth user's strategy is blank, every seventh's run missing."""
    sink = (
        inputs.event_log(spark, sf_dir)
        .withColumn("strategy", F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.col("strategy")))
        .withColumn("run_id", F.when(F.col("user_id") % 7 != 0, F.col("run_id")))
    )
    return latency_samples(sink)


@_query
def run_extract(spark, sf_dir):
    return run_samples(latency_samples(inputs.event_log(spark, sf_dir)), "batch", "low-load", "run_1")


@_query
def keyset_page(spark, sf_dir):
    cursor = (inputs.ORIGIN_MS + 150_000, "00000000-0000-0000-0000-000000000500")
    sink = inputs.event_log(spark, sf_dir)
    page = next_page(sink, ("streaming", "high-load", "run_3"), cursor, rows=100)
    return page.select("event_id", "visible_at")


def _tree(spark: SparkSession) -> str:
    return shared_dir(spark, "results")


@_query
def tree_samples(spark, sf_dir):
    """Samples through the files of a result tree: every fiftieth latency is no number, and the labels within the files are wrong."""
    root, log = _tree(spark), inputs.samples(spark, sf_dir)
    text = F.when(F.col("event_no") % 50 == 0, "n/a").otherwise(F.col("latency_ms").cast("string"))
    rows = log.withColumn("latency_ms", text).select(*LATENCY_SAMPLE.names)
    files.write_tree(rows, root, LATENCY_FILE, ["visible_at", "event_id"])
    return artifacts.read_latency_samples(spark, root)


@_query
def tree_documents(spark, sf_dir):
    """The three documents of every run, written and read: what each says, side by side."""
    root, log = _tree(spark), inputs.event_log(spark, sf_dir)
    files.write_tree(inputs.run_metadata(log), root, METADATA_FILE, fmt="json")
    files.write_tree(inputs.run_summaries(log), root, SUMMARY_FILE, fmt="json")
    # The labels of these are those of their folder alone.
    generators = inputs.generator_summaries(log)
    files.write_tree(generators, root, GENERATOR_FILE, fmt="json")
    told = artifacts.read_run_metadata(spark, root).select(*KEY, "target_eps", "git_commit")
    seen = artifacts.read_run_summaries(spark, root).select(*KEY, "visible_events", "memory_rss_avg_mb")
    made = artifacts.read_generator_summaries(spark, root).select(*KEY, "generated_events", "load_profile")
    figures = told.join(seen, KEY, "full").join(made, KEY, "full")
    return _as_double(figures, "visible_events", "target_eps", "generated_events")


@_query
def tree_snapshots(spark, sf_dir):
    """Metric snapshots through CSV files: rows, readable values and their sum by run and metric."""
    root, log = _tree(spark), inputs.event_log(spark, sf_dir)
    value = F.when(F.col("event_no") % 9 == 0, "oops").otherwise((F.col("event_no") % 1000).cast("string"))
    rows = log.select(*KEY, F.col("event_type").alias("metric"), value.alias("value"), F.lit("unit").alias("unit"))
    files.write_tree(rows, root, SNAPSHOT_FILE)
    read = artifacts.read_snapshots(spark, root)
    return read.groupBy(*KEY, "metric").agg(F.count("*").alias("rows"), F.count("value").alias("readable"), F.sum("value").alias("total"))


@_query
def tree_series(spark, sf_dir):
    """Lag and resource readings through CSV files; a reading without a source is of an unknown one."""
    root, log = _tree(spark), inputs.event_log(spark, sf_dir)
    lag = inputs.lag_series(log).withColumn("lag_source", F.nullif(F.col("lag_source"), F.lit("missing")))
    files.write_tree(lag.withColumn("timestamp", F.lit(1)), root, LAG_FILE)
    files.write_tree(inputs.resource_series(log).withColumn("timestamp", F.lit(1)), root, RESOURCES_FILE)
    lags = artifacts.read_lag_series(spark, root).select(*KEY, F.col("lag_source").alias("kind"), F.col("lag").alias("value"))
    used = artifacts.read_resource_series(spark, root)
    memory = used.select(*KEY, F.lit("memory").alias("kind"), F.col("mem_rss_bytes").alias("value"))
    cores = used.select(*KEY, F.lit("cores").alias("kind"), (F.col("cpu_cores") * 4).alias("value"))
    series = matrix.union_all(lags, memory, cores)
    return series.groupBy(*KEY, "kind").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


@_query
def tree_missing_columns(spark, sf_dir):
    """Files whose columns stand in another order, or are not there: fields go by the header of their own file."""
    root, log = _tree(spark), inputs.samples(spark, sf_dir)
    whole = log.where("strategy <> 'streaming'").select(*reversed(LATENCY_SAMPLE.names))
    files.write_tree(whole, root, LATENCY_FILE)
    files.write_tree(log.where("strategy = 'streaming'").select(*KEY, "latency_ms", "event_id"), root, LATENCY_FILE)
    raw = artifacts.read_latency_samples(spark, root, raw=True)
    return raw.groupBy("strategy").agg(
        F.count("*").alias("rows"), F.count("visible_at").alias("timed"), F.sum(col.lenient_double("latency_ms")).alias("latency")
    )


@_query
def report_files(spark, sf_dir):
    """A report, samples in visible order and documents by run, as files: rows of each kind as they are read again."""
    root, log = _tree(spark), inputs.samples(spark, sf_dir)
    files.write_report(reports.scenario_stats(log), f"{root}/report")
    files.write_samples_csv(latency_samples(log), f"{root}/samples")
    files.write_run_documents(inputs.run_summaries(log), f"{root}/documents")
    report = spark.read.option("header", "true").csv(f"{root}/report").select("strategy", F.col("latency_rows").cast("long").alias("n"))
    samples = spark.read.option("header", "true").csv(f"{root}/samples").groupBy("strategy").agg(F.count("visible_at").alias("n"))
    documents = spark.read.json(f"{root}/documents").groupBy("strategy").agg(F.sum("generated_events").cast("long").alias("n"))
    kinds = {"report": report, "samples": samples, "documents": documents}
    rows = matrix.union_all(*[df.select(F.lit(kind).alias("kind"), "strategy", "n") for kind, df in kinds.items()])
    return rows.groupBy("kind", "strategy").agg(F.sum("n").alias("rows"))


@_query
def keyset_all_pages(spark, sf_dir):
    """All pages of one run, as the walk from cursor to cursor gives them; rows with the number of their page."""
    source = shared_dir(spark, "sink")
    inputs.event_log(spark, sf_dir).repartitionByRange(8, "visible_at").write.parquet(source)
    found = numbered_pages(spark.read.parquet(source), ("streaming", "high-load", "run_3"), rows=25)
    return found.select("page", "event_id", "visible_at")


@_query
def bounded_sample_rows(spark, sf_dir):
    log = inputs.event_log(spark, sf_dir).select("event_id", *KEY, "latency_ms")
    return keys.bounded_sample(log, rows=40)


@_query
def bounded_sample_counts(spark, sf_dir):
    """With repeated ids: the sample's size per run is the bound, or the run's size if that is less."""
    log = inputs.shipping_log(spark, sf_dir)
    return matrix.rows_per_label(keys.bounded_sample(log, rows=1500))


@_query
def lenient_numbers(spark, sf_dir):
    """Text of every kind as numbers: values, and how many could not be read."""
    log = inputs.event_log(spark, sf_dir)
    text = (
        F.when(F.col("event_no") % 10 == 0, "n/a")
        .when(F.col("event_no") % 10 == 1, "")
        .when(F.col("event_no") % 10 == 2, "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    read = log.withColumn("text", text)
    return _rounded(
        read.groupBy("event_type").agg(
            F.count_if(col.is_unparsable("text")).alias("unparsable"),
            F.count(col.lenient_double("text")).alias("parsed"),
            F.sum(col.lenient_double("text")).alias("total"),
        ),
        4,
    )


@_query
def names_and_units(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey",
        col.safe_name("c_name").alias("safe"),
        col.run_topic("c_mktsegment", "c_name", F.col("c_nationkey").cast("string"), "c_custkey").alias("topic"),
        col.iso_utc(F.col("c_custkey") * 86399).alias("iso"),
        col.payload_bytes("c_custkey").alias("payload_bytes"),
        col.payload_was_raised("c_custkey").alias("raised"),
        col.s_to_ms("c_custkey").alias("ms"),
        F.round(col.bytes_to_mib(F.col("c_acctbal") * 1000), 6).alias("mib"),
        F.round(col.ratio_or_null("c_custkey", "c_acctbal"), 6).alias("guarded"),
        F.round(col.ratio_or_zero("c_custkey", "c_acctbal"), 6).alias("guarded_zero"),
        col.at_least("c_acctbal", 0).alias("clamped"),
    )


@_query
def display_labels(spark, sf_dir):
    """Labels and sort ranks of known and unknown categories."""
    scenario = F.when(F.col("user_id") % 4 == 3, F.col("event_type")).otherwise(F.col("scenario"))
    log = inputs.event_log(spark, sf_dir).withColumn("scenario", scenario)
    groups = log.groupBy("scenario", "strategy").agg(F.count("*").alias("rows"))
    return groups.select(
        "rows",
        col.display_label("strategy", STRATEGY_LABELS).alias("strategy_label"),
        col.display_label("scenario", SCENARIO_LABELS).alias("scenario_label"),
        col.preferred_rank("scenario", SCENARIOS).cast("bigint").alias("scenario_rank"),
        col.preferred_rank("strategy", STRATEGIES).cast("bigint").alias("strategy_rank"),
        col.in_scope("scenario").alias("official"),
    )


@_query
def plausible_times(spark, sf_dir):
    log = inputs.shipping_log(spark, sf_dir)
    return log.groupBy("strategy").agg(
        F.count_if(col.is_plausible_ms("visible_at")).alias("plausible"),
        F.count_if(~col.is_plausible_ms("visible_at")).alias("implausible"),
    )


# --- latency ----------------------------------------------------------------------------


@_query
def run_stats(spark, sf_dir):
    return _rounded(reports.run_stats(inputs.samples(spark, sf_dir)), 3)


@_query
def scenario_stats(spark, sf_dir):
    return _rounded(reports.scenario_stats(inputs.samples(spark, sf_dir)), 3)


@_query
def shipping_stats(spark, sf_dir):
    """The same figures where latencies are negative, repeated and wide apart."""
    return _rounded(reports.scenario_stats(inputs.shipping_log(spark, sf_dir)), 3)


@_query
def latency_summary(spark, sf_dir):
    return reports.latency_summary(reports.scenario_stats(inputs.samples(spark, sf_dir)))


@_query
def five_numbers(spark, sf_dir):
    figures = order_stats.five_numbers(inputs.shipping_log(spark, sf_dir), ["scenario", "strategy"], "latency_ms")
    return _rounded(figures, 3)


@_query
def quantiles_wide_and_narrow(spark, sf_dir):
    """Quantiles of fractions below 1, of moments close together, and of numbers up to 10^15, by one and the same call."""
    log = inputs.event_log(spark, sf_dir)
    kinds = {
        "fraction": (F.col("event_no") * 7919 % 100_003) / 100_003.0,
        "moment": F.col("produced_at").cast("double"),
        "wide": (F.col("event_no") * F.col("event_no") * 104_729 % 1_000_000_000_000_000).cast("double"),
    }
    values = matrix.union_all(*[log.select(F.lit(kind).alias("kind"), "strategy", value.alias("x")) for kind, value in kinds.items()])
    probs = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    return _rounded(order_stats.exact_quantiles(values, ["kind", "strategy"], "x", probs), 3)


@_query
def box_stats(spark, sf_dir):
    return _rounded(reports.latency_distribution(inputs.shipping_log(spark, sf_dir)), 3)


@_query
def latency_histogram(spark, sf_dir):
    return order_stats.histogram(inputs.samples(spark, sf_dir), ["strategy", "scenario"], "latency_ms")


@_query
def produce_histogram(spark, sf_dir):
    """The bounds for produce latencies, on the events' values."""
    figures = order_stats.histogram(inputs.event_log(spark, sf_dir), KEY, "value", PRODUCE_BOUNDS)
    return _rounded(figures, 4)


@_query
def kruskal_wallis(spark, sf_dir):
    return _rounded(ranks.kruskal_wallis(inputs.samples(spark, sf_dir)))


@_query
def mann_whitney_u(spark, sf_dir):
    tests = ranks.mann_whitney(inputs.samples(spark, sf_dir))
    return _rounded(tests, 5)


@_query
def shipping_rank_tests(spark, sf_dir):
    """Rank tests on many rows with many ties."""
    log = inputs.shipping_log(spark, sf_dir)
    return _rounded(ranks.kruskal_wallis(log, groups=["A", "N", "R"]), 5)


@_query
def statistical_tests(spark, sf_dir):
    return _rounded(reports.statistical_tests(inputs.samples(spark, sf_dir)))


# --- runs ---------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    return reports.official_metrics(
        log.where(F.col("value") < inputs.LOST_FROM),
        inputs.run_metadata(log),
        inputs.run_summaries(log),
        inputs.generator_summaries(log),
        inputs.lag_series(log),
        inputs.resource_series(log),
        **options,
    )


@_query
def official_metrics(spark, sf_dir):
    return keys.in_display_order(_rounded(_metrics(spark, sf_dir)), then=["run_id"])


@_query
def official_metrics_whole_seconds(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir, scope="all", whole_seconds=True, fill_zero=True))


@_query
def official_metrics_warm(spark, sf_dir):
    """Events of the first minute of each run left out of the samples."""
    metrics = _metrics(spark, sf_dir, warmup_s=60)
    return _rounded(metrics.select(*KEY, "visible_events_cutoff", "latency_p50_ms", "time_to_drain_s"))


@_query
def visible_at_cutoff(spark, sf_dir):
    log = inputs.event_log(spark, sf_dir)
    cutoffs = inputs.generator_summaries(log).withColumnRenamed("generation_end_epoch_ms", "generation_end_ms")
    return reports.visible_at_cutoff(log, cutoffs)


@_query
def throughput_summary(spark, sf_dir):
    return _rounded(reports.throughput_summary(_metrics(spark, sf_dir)))


@_query
def delivery_summary(spark, sf_dir):
    return _rounded(reports.delivery_summary(_metrics(spark, sf_dir)))


@_query
def backlog_summary(spark, sf_dir):
    return _rounded(reports.backlog_summary(_metrics(spark, sf_dir)))


@_query
def drain_summary(spark, sf_dir):
    return _rounded(reports.drain_summary(_metrics(spark, sf_dir)))


@_query
def resource_summary(spark, sf_dir):
    return _rounded(reports.resource_summary(_metrics(spark, sf_dir)))


@_query
def lag_summary(spark, sf_dir):
    return _rounded(reports.lag_summary(_metrics(spark, sf_dir)))


@_query
def production_totals(spark, sf_dir):
    return _rounded(reports.production_totals(inputs.event_log(spark, sf_dir)))


@_query
def run_summary(spark, sf_dir):
    """Summary documents, the snapshot pivoted from readings of the log."""
    log = inputs.event_log(spark, sf_dir)
    visible = log.where(F.col("value") < inputs.LOST_FROM).groupBy(*KEY).agg(F.count("*").alias("visible_events"))
    pivot = telemetry.pivot_snapshot(_readings(log))
    return _rounded(
        reports.run_summary(inputs.generator_summaries(log), visible, pivot, inputs.run_metadata(log)), 3
    )


def _readings(log: DataFrame) -> DataFrame:
    """Snapshot lines: each event is a reading of the metric its number names, some unreadable."""
    names = F.array(
        *[
            F.lit(m)
            for m in (
                "cpu_total_cores", "mem_rss_bytes", "kafka_consumer_lag", "kafka_consumer_lag_real_present",
                "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
            )
        ]
    )
    return log.select(
        *KEY,
        F.element_at(names, (F.col("event_no") % 7).cast("int") + 1).alias("metric"),
        F.when(F.col("event_no") % 13 != 0, F.floor("value").cast("double")).alias("value"),
        F.col("event_no").alias("line"),
    )


@_query
def snapshot_pivot(spark, sf_dir):
    return telemetry.pivot_snapshot(_readings(inputs.event_log(spark, sf_dir)))


@_query
def mean_sem(spark, sf_dir):
    log = inputs.shipping_log(spark, sf_dir).withColumn("days", F.col("latency_ms") / 86400000)
    return _rounded(matrix.mean_sem(log, ["days", "l_quantity"]))


@_query
def reductions(spark, sf_dir):
    log = inputs.shipping_log(spark, sf_dir)
    figures = matrix.reduce_by(log, {"l_quantity": "mean", "l_extendedprice": "max", "latency_ms": "min"})
    return _rounded(figures)


@_query
def modal_target(spark, sf_dir):
    """Most frequent number of events per run, by scenario: ties go to the smallest."""
    sizes = inputs.event_log(spark, sf_dir).groupBy("user_id", "scenario").agg(F.count("*").alias("size"))
    return matrix.modal_value(sizes, ["scenario"], "size")


@_query
def distinct_values(spark, sf_dir):
    return matrix.distinct_counts(inputs.shipping_log(spark, sf_dir), ["event_id", "scenario", "latency_ms"])


@_query
def rows_per_label(spark, sf_dir):
    return matrix.rows_per_label(inputs.shipping_log(spark, sf_dir))


@_query
def any_violation(spark, sf_dir):
    return matrix.any_row(inputs.shipping_log(spark, sf_dir), F.col("latency_ms") <= 0)


@_query
def coefficient_of_variation(spark, sf_dir):
    log = inputs.shipping_log(spark, sf_dir)
    return _rounded(log.groupBy("strategy").agg(matrix.coefficient_of_variation("latency_ms").alias("cv_pct")), 5)


@_query
def volume_budget(spark, sf_dir):
    """Events and payload bytes by scenario, against a budget of so many events of each target."""
    log = inputs.event_log(spark, sf_dir)
    targets = [(s, 400 * 10 ** i, 4000 * 10 ** i) for i, s in enumerate(SCENARIOS)]
    budget = spark.createDataFrame(targets, "scenario STRING, budget_events BIGINT, budget_bytes BIGINT")
    return matrix.payload_volume(log, budget)


@_query
def document_volume(spark, sf_dir):
    """Whole document texts as payloads: bytes by source, and how many are under the smallest size."""
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.groupBy("source", "lang").agg(
        F.count("*").alias("events"),
        F.sum(F.octet_length("text")).cast("bigint").alias("bytes"),
        F.count_if(col.payload_was_raised(F.octet_length("text"))).alias("undersized"),
    )


# --- the grid -----------------------------------------------------------------------------


@_query
def missing_runs(spark, sf_dir):
    """Expected runs without an event of a very high value."""
    actual = inputs.event_log(spark, sf_dir).where(F.col("value") > 150)
    return matrix.missing(matrix.expected_runs(spark, 6), actual, KEY)


@_query
def expected_pairs(spark, sf_dir):
    actual = inputs.event_log(spark, sf_dir).where((F.col("event_no") % 3 + F.col("user_id") % 3) != 2)
    return matrix.missing(matrix.expected_pairs(spark), actual, ["strategy", "scenario"])


@_query
def artifact_gaps(spark, sf_dir):
    log = inputs.event_log(spark, sf_dir)
    return matrix.missing_artifacts(log, inputs.artifact_inventory(log.where(F.col("user_id") % 10 < 3)))


@_query
def run_keys_union(spark, sf_dir):
    log = inputs.event_log(spark, sf_dir)
    ships = inputs.shipping_log(spark, sf_dir)
    return matrix.all_run_keys(log, inputs.lag_series(log), inputs.resource_series(log), ships)


@_query
def reconcile_counts(spark, sf_dir):
    """Summaries beside the rows really exported."""
    log = inputs.event_log(spark, sf_dir)
    counted = matrix.rows_per_label(log.where(F.col("value") < inputs.LOST_FROM))
    figures = reports.reconciled_counts(inputs.run_summaries(log), counted)
    return _as_double(figures, "visible_events", "rows")


@_query
def runs_semi_join(spark, sf_dir):
    """Samples of the runs whose rates vary over time."""
    log = inputs.event_log(spark, sf_dir)
    advanced = inputs.generator_summaries(log).where(col.is_advanced("load_profile"))
    return matrix.rows_per_label(keys.keep_runs(log, advanced))


@_query
def first_of_run(spark, sf_dir):
    log = inputs.event_log(spark, sf_dir)
    return keys.first_per_run(log, ["produced_at", "event_id"]).select(*KEY, "event_id", "produced_at")


@_query
def lag_coverage(spark, sf_dir):
    lag = inputs.lag_series(inputs.event_log(spark, sf_dir)).where("strategy = 'streaming' OR lag > 400")
    return matrix.lag_coverage(spark, lag)


# --- timelines ------------------------------------------------------------------------------


@_query
def elapsed_counts(spark, sf_dir):
    return timeline.elapsed_counts(inputs.samples(spark, sf_dir))


@_query
def visibility_timeline(spark, sf_dir):
    log = inputs.event_log(spark, sf_dir)
    seen = log.where(F.col("value") < inputs.LOST_FROM)
    return timeline.visibility_timeline(seen, inputs.timeline_runs(log))


@_query
def timeline_wrong_clock(spark, sf_dir):
    """Clocks that are wrong by a little, by months, and beyond all reason: intervals, and the account of what is on no axis."""
    number = F.col("event_no")
    wrong = (
        F.when(number % 97 == 0, F.lit(10**18))
        .when(number % 97 == 1, F.lit(0))
        .when(number % 97 == 2, F.col("visible_at") + 200 * 86_400_000)
        .otherwise(F.col("visible_at"))
    )
    samples = inputs.samples(spark, sf_dir).withColumn("visible_at", wrong.cast("long"))
    counts = timeline.elapsed_counts(samples)
    return timeline.visible_intervals(counts).join(timeline.off_axis(counts), KEY)


@_query
def latency_timeseries(spark, sf_dir):
    return _rounded(timeline.latency_timeseries(inputs.samples(spark, sf_dir)), 3)


def _run_profiles(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    runs = inputs.timeline_runs(inputs.event_log(spark, sf_dir))
    return runs.withColumn("load_profile", F.lit(profile)).select(*KEY, "duration_s", "load_profile", "fallback_rate")


@_query
def rate_timeline_cyclic(spark, sf_dir):
    return timeline.rate_timeline(_run_profiles(spark, sf_dir, "cyclic"))


@_query
def rate_timeline_bursty(spark, sf_dir):
    return timeline.rate_timeline(_run_profiles(spark, sf_dir, "bursty"))


@_query
def peak_rates(spark, sf_dir):
    runs = inputs.timeline_runs(inputs.event_log(spark, sf_dir))
    return timeline.peak_rates(runs).select(*KEY, "load_profile", "peak_rate")


@_query
def produced_timeline(spark, sf_dir):
    return _rounded(timeline.produced_timeline(inputs.timeline_runs(inputs.event_log(spark, sf_dir))))


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = inputs.event_log(spark, sf_dir)
    runs = inputs.timeline_runs(log)
    seen = log.where(F.col("value") < inputs.LOST_FROM)
    return timeline.produced_timeline(runs), timeline.visibility_timeline(seen, runs), runs


@_query
def backlog_timeline(spark, sf_dir):
    produced, visible, runs = _series(spark, sf_dir)
    return _rounded(timeline.backlog_timeline(visible, produced, runs))


@_query
def response_series(spark, sf_dir):
    produced, visible, _ = _series(spark, sf_dir)
    return _rounded(timeline.response_series(produced, visible))


@_query
def quiescence_point(spark, sf_dir):
    """Polls of the visible total every second."""
    visible = timeline.visibility_timeline(inputs.samples(spark, sf_dir))
    polls = visible.select(*KEY, F.col("elapsed_s").alias("t"), F.col("cumulative_visible").alias("visible_events"))
    return _as_double(timeline.quiescence(polls, 3), "quiet_at")


@_query
def drain_point(spark, sf_dir):
    """Progress of one-second batches, each reported twice."""
    produced = timeline.visibility_timeline(inputs.samples(spark, sf_dir).withColumn("visible_at", F.col("produced_at")))
    progress = produced.select(
        *KEY,
        F.col("elapsed_s").alias("batch_id"),
        F.col("visible_count_window").alias("num_input_rows"),
        (F.col("elapsed_s") * 1000).alias("ts"),
    )
    twice = progress.unionByName(progress.withColumn("ts", F.col("ts") + 500))
    return _as_double(timeline.drain_point(twice, 2), "drained_batch", "drained_at")


# --- telemetry --------------------------------------------------------------------------------


@_query
def counter_increase(spark, sf_dir):
    scraped = telemetry.with_series(inputs.metric_samples(spark, sf_dir))
    increases = telemetry.counter_increase(scraped, ["metric", "series"])
    return _rounded(increases.groupBy("metric").agg(
        F.count("*").alias("series"), F.sum("samples").alias("samples"), F.sum("increase").alias("increase")
    ), 4)


@_query
def counter_rate(spark, sf_dir):
    """Increase per second of the counters under a label condition, by strategy."""
    found = inputs.metric_samples(spark, sf_dir).where(
        telemetry.label_match(
            "container_cpu_usage_seconds_total", {"job": "cadvisor"}, {"mode": "idle"}, {"name": "app-[12]"}
        )
    )
    labelled = telemetry.with_series(found).withColumn("strategy", F.element_at("labels", F.lit("strategy")))
    increases = telemetry.counter_increase(labelled, ["strategy", "series"])
    return _rounded(telemetry.increase_rate(increases, 2592000, ["strategy"]), 9)


@_query
def average_over_time(spark, sf_dir):
    found = telemetry.with_series(inputs.metric_samples(spark, sf_dir))
    return _rounded(telemetry.sum_of_averages(found, ["metric", "series"], ["metric"]), 4)


@_query
def maximum_over_time(spark, sf_dir):
    found = inputs.metric_samples(spark, sf_dir).where(telemetry.label_match("kafka_consumergroup_lag"))
    grouped = found.withColumn("consumergroup", F.element_at("labels", F.lit("consumergroup")))
    return telemetry.max_over_time(grouped, ["consumergroup"])


@_query
def metric_snapshot(spark, sf_dir):
    runs = inputs.slot_runs(spark, sf_dir)
    latency = reports.run_stats(inputs.samples(spark, sf_dir))
    return _rounded(
        snapshot.metric_snapshot(inputs.metric_samples(spark, sf_dir), runs, latency, containers="app-[12]")
    )


@_query
def snapshot_series(spark, sf_dir):
    """Lag and resource points out of the pivoted snapshot."""
    pivot = telemetry.pivot_snapshot(_readings(inputs.event_log(spark, sf_dir)))
    lag, resources = snapshot.series_of_snapshot(pivot, F.lit(0).cast("bigint"))
    return lag.join(resources, ["timestamp", *KEY])


# --- quality ------------------------------------------------------------------------------------


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    seen = log.where(F.col("value") < inputs.LOST_FROM)
    stats = reports.run_stats(seen)
    metadata, summaries = inputs.run_metadata(log), inputs.run_summaries(log)
    generators, lag = inputs.generator_summaries(log), inputs.lag_series(log)
    nodes = log.groupBy("user_id").agg(F.count("*").alias("_n"))
    offsets = nodes.select(
        F.col("user_id").cast("string").alias("node"), (F.col("_n") % 12 - 6.5).cast("string").alias("offset_ms")
    )
    return quality.quality_report(
        quality.sample_checks(seen),
        quality.strategy_checks(seen),
        quality.expectation_checks(seen),
        quality.sample_count_checks(seen, metadata),
        quality.artifact_checks(metadata, inputs.artifact_inventory(log.where(F.col("user_id") % 10 < 3))),
        quality.summary_checks(summaries, stats),
        quality.metadata_checks(metadata),
        quality.latency_sign_checks(stats),
        quality.lag_checks(lag),
        quality.run_id_checks({"samples": seen, "metadata": metadata, "summaries": summaries, "generators": generators}),
        quality.generator_checks(metadata, generators.where("run_id != 'run_2'")),
        quality.scope_checks(log),
        quality.snapshot_checks(_readings(log)),
        quality.clock_checks(offsets),
    )


@_query
def quality_rows(spark, sf_dir):
    return _quality(spark, sf_dir).drop("message")


@_query
def quality_rollup(spark, sf_dir):
    return quality.quality_rollup(_quality(spark, sf_dir))


@_query
def sample_counters(spark, sf_dir):
    counters = quality.sample_counters(inputs.shipping_log(spark, sf_dir))
    return _rounded(counters, 5)


@_query
def clock_status(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer")
    offsets = customers.select(
        F.col("c_name").alias("node"),
        F.when(F.col("c_custkey") % 9 == 0, "N/A").otherwise((F.col("c_acctbal") / 1000).cast("string")).alias("offset_ms"),
    )
    return _as_double(quality.clock_status(offsets), "offset_rounded_ms")
