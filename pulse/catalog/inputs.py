"""Ingestion data out of the sample tables, which hold no ingestion log.

``events`` becomes 45 runs (3 strategies, 3 scenarios, 5 repetitions); ``lineitem`` with ``orders``
becomes a log whose ids repeat and whose latencies may be negative. Everything is computed from the
rows, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators.timeline import profile_runs
from pulse.plans.reports import production_totals
from pulse.schemas import KEY, SCENARIO_TARGET_EPS, SCENARIOS, STRATEGIES

ORIGIN_MS = 1704067200000  # first moment of the events table's month
SPEEDUP = 8640  # a month of 30 days in 300 s, the length of an official run
LOST_FROM = 150.0  # events of at least this value never become visible
SLOT_MS = 16 * 3600 * 1000  # 45 slots fill the month
TOPIC = "events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables hold timestamps without zone, read as UTC wherever epoch times are needed.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _base_latency(strategy: Column) -> Column:
    base = F.when(strategy == "batch", 120000).when(strategy == "microbatch", 5000).otherwise(200)
    return base.cast("bigint")


def as_event_log(events: DataFrame, speedup: int = SPEEDUP) -> DataFrame:
    """One sink row per event. ``speedup`` 1 keeps the month's own times."""
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    if speedup != 1:
        ms = F.lit(ORIGIN_MS) + F.floor((ms - ORIGIN_MS) / speedup)
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    strategy = _pick(STRATEGIES, F.col("event_id") % 3)
    delay = _base_latency(strategy) + F.floor(F.col("value") * 100)
    return events.select(
        F.concat(F.lit("00000000-0000-0000-0000-"), number).alias("event_id"),
        F.col("event_id").alias("event_no"),
        "user_id",
        "event_type",
        "value",
        F.col("props").alias("payload"),
        strategy.alias("strategy"),
        _pick(SCENARIOS, F.col("user_id") % 3).alias("scenario"),
        F.concat(F.lit("run_"), (F.col("user_id") % 5 + 1).cast("string")).alias("run_id"),
        ms.alias("produced_at"),
        (ms + delay).alias("visible_at"),
        delay.alias("latency_ms"),
    )


def event_log(spark: SparkSession, sf_dir: str, speedup: int = SPEEDUP) -> DataFrame:
    return as_event_log(table(spark, sf_dir, "events"), speedup)


def samples(spark: SparkSession, sf_dir: str, speedup: int = SPEEDUP) -> DataFrame:
    """Latency samples: the events that became visible."""
    return event_log(spark, sf_dir, speedup).where(F.col("value") < LOST_FROM)


def shipping_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples out of order and shipping dates, with repeated ids and negative latencies."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    ms = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div 1000")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
            "event_id"
        ),
        ms("o_orderdate").alias("produced_at"),
        ms("l_shipdate").alias("visible_at"),
        (ms("l_shipdate") - ms("o_orderdate")).alias("latency_ms"),
        F.col("l_returnflag").alias("strategy"),
        F.col("o_orderpriority").alias("scenario"),
        F.col("l_linestatus").alias("run_id"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
    )


SHIPPING_ORDER = ["visible_at", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


# --- Kafka-shaped logs ------------------------------------------------------------------


def as_kafka_log(log: DataFrame) -> DataFrame:
    """JSON records of an event log. Every seventh event comes twice, the second copy a millisecond
    younger; of each 101 first copies six are bad in some way and one has no payload."""
    copies = log.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("event_no") % 7 == 0, 1).otherwise(0))))
    flaw = F.when(F.col("copy") == 0, F.col("event_no") % 101).otherwise(F.lit(0).cast("bigint"))
    flawed = copies.withColumn("flaw", flaw).withColumn("produced_at", F.col("produced_at") + F.col("copy"))
    c = F.col

    def envelope(produced_at: Column) -> Column:
        return F.to_json(
            F.struct(
                F.when(c("flaw") == 5, "1-1-1-1-1").otherwise(c("event_id")).alias("event_id"),
                produced_at.alias("produced_at"),
                F.when(c("flaw") != 7, F.when(c("copy") == 1, "copy").otherwise(c("payload"))).alias("payload"),
                "strategy",
                "scenario",
                F.when(c("flaw") != 4, c("run_id")).alias("run_id"),
                c("value").alias("reading"),
            )
        )

    text = (
        F.when(c("flaw") == 1, "not json")
        .when(c("flaw") == 2, "[]")
        .when(c("flaw") == 3, F.lit(None))
        .when(c("flaw") == 6, envelope(c("produced_at").cast("string")))
        .otherwise(envelope(c("produced_at")))
    )
    return flawed.select(
        c("event_id").cast("binary").alias("key"),
        text.cast("binary").alias("value"),
        F.lit(TOPIC).alias("topic"),
        (c("event_no") % 12).cast("int").alias("partition"),
        (F.floor(c("event_no") / 12) * 2 + c("copy")).alias("offset"),
        F.timestamp_millis("produced_at").alias("timestamp"),
    )


def kafka_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_kafka_log(as_event_log(table(spark, sf_dir, "events")))


def seen_at() -> Column:
    """A fixed visibility stamp for ingested records, from the record alone."""
    number = F.substring("event_id", 25, 12).cast("bigint")
    return F.col("produced_at") + _base_latency(F.col("strategy")) + number * 7919 % 40000


def domain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records of the three domain kinds, some outside their rules; ``error`` events have a
    kind that is not known."""
    log = as_event_log(table(spark, sf_dir, "events"))
    c = F.col
    kind = (
        F.when(c("event_type") == "purchase", "financial_tick")
        .when(c("event_type") == "signup", "health_monitor")
        .when(c("event_type") == "error", "mystery")
        .otherwise("iot_sensor")
    )
    pulse = F.floor(c("value")) + 40
    fields = {
        "device_id": F.concat(F.lit("sensor-"), F.lpad(c("user_id").cast("string"), 4, "0")),
        "temperature_c": c("value") - 20,
        "humidity_pct": c("value") + 10,
        "pressure_hpa": c("value") + 950,
        "battery_v": F.lit(3.0),
        "status": F.when(c("user_id") % 10 == 0, "lost").otherwise("ok"),
        "symbol": F.when(c("user_id") % 2 == 0, "AAPL").otherwise("MSFT"),
        "exchange": F.lit("nyse"),
        "price": c("value"),
        "bid": F.when(c("event_no") % 11 == 0, c("value") + 1).otherwise(c("value") - 0.5),
        "ask": c("value") + 0.5,
        "volume": c("value") * 2,
        "patient_id": F.concat(F.lit("P-"), (c("user_id") + 1000).cast("string")),
        "heart_rate_bpm": pulse,
        "steps_delta": c("user_id") % 25,
        "alert": pulse > 150,
    }
    envelope = [c(n).alias(n) for n in ("event_id", "produced_at", "payload", *KEY)]
    text = F.to_json(F.struct(*envelope, kind.alias("schema"), *[f.alias(n) for n, f in fields.items()]))
    return log.select(text.cast("binary").alias("value"))


# --- per-run tables --------------------------------------------------------------------


def generator_summaries(log: DataFrame) -> DataFrame:
    totals = production_totals(log)
    return totals.withColumn("total_events_generated", F.lit(None).cast("bigint")).withColumn(
        "load_profile",
        F.when(F.col("run_id") == "run_1", "cyclic").when(F.col("run_id") == "run_2", "bursty").otherwise("constant"),
    )


def run_metadata(log: DataFrame) -> DataFrame:
    """Run 5 has a wrong target, and every run the commit that its number of events names."""
    targets = F.create_map(*[F.lit(x) for pair in SCENARIO_TARGET_EPS.items() for x in pair])
    runs = log.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max("produced_at").alias("_end"))
    off = F.when(F.col("run_id") == "run_5", 1).otherwise(0)
    return runs.select(
        *KEY,
        (F.element_at(targets, F.col("scenario")) + off).cast("bigint").alias("target_eps"),
        F.lit(300.0).alias("official_duration_seconds"),
        F.floor(F.col("_end") / 1000).alias("generation_end_ts"),
        F.floor(F.col("_end") / 1000).alias("processing_start_ts"),
        (F.floor(F.col("_end") / 1000) + F.col("_n") % 50).alias("processing_end_ts"),
        F.concat(F.lit("commit-"), (F.col("_n") % 2).cast("string")).alias("git_commit"),
    )


def run_summaries(log: DataFrame) -> DataFrame:
    """Run 4 has no visible count, run 3 no resource figures."""
    n = F.col("generated_events")
    seen = F.col("_seen")
    runs = log.groupBy(*KEY).agg(
        F.count("*").alias("generated_events"),
        F.count_if(F.col("value") < LOST_FROM).alias("_seen"),
        ((F.max("produced_at") - F.min("produced_at")) / 1000).alias("generation_duration_seconds"),
    )
    known = F.col("run_id") != "run_3"
    return runs.select(
        *KEY,
        "generated_events",
        F.when(F.col("run_id") != "run_4", seen).alias("visible_events"),
        F.lit(300.0).alias("official_duration_seconds"),
        "generation_duration_seconds",
        F.when(known, n / 1000).alias("cpu_cores_avg"),
        F.lit(None).cast("double").alias("cpu_avg_cores"),
        F.lit(None).cast("double").alias("mem_rss_mb_avg"),
        F.when(known, n * 2.0).alias("memory_rss_avg_mb"),
        (seen * 100.0 / n).alias("delivery_ratio_pct"),
        F.lit(10).cast("bigint").alias("target_eps"),
        (n / 300).alias("generated_eps_real"),
    )


def lag_series(log: DataFrame) -> DataFrame:
    """A lag reading per error or purchase event; a purchase's is a real one."""
    kept = log.where(F.col("event_type").isin("error", "purchase"))
    real = F.when(F.col("event_type") == "purchase", "real_prometheus").otherwise("missing")
    return kept.select(*KEY, F.floor("value").cast("double").alias("lag"), real.alias("lag_source"))


def resource_series(log: DataFrame) -> DataFrame:
    """A processor and memory reading per view event."""
    kept = log.where(F.col("event_type") == "view")
    return kept.select(
        *KEY,
        (F.floor("value") / 4).alias("cpu_cores"),
        (F.floor("value") * 1048576).cast("double").alias("mem_rss_bytes"),
    )


def artifact_inventory(log: DataFrame) -> DataFrame:
    """A run has an artifact when an event of the kind it stands for has a high value."""
    kinds = {
        "click": "latency_samples.csv",
        "view": "run_metadata.json",
        "purchase": "run_summary.json",
        "signup": "generator_summary.json",
    }
    pairs = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    kept = log.where((F.col("value") > 60) & F.col("event_type").isin(list(kinds)))
    return kept.select(*KEY, F.element_at(pairs, F.col("event_type")).alias("artifact")).distinct()


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped samples over the month: a metric per event type, labels from the event."""
    log = event_log(spark, sf_dir, 1)
    c = F.col
    metric = (
        F.when(c("event_type") == "click", "container_cpu_usage_seconds_total")
        .when(c("event_type") == "view", "container_memory_rss")
        .when(c("event_type") == "purchase", "kafka_produced_messages_total")
        .when(c("event_type") == "signup", "node_cpu_seconds_total")
        .otherwise("kafka_consumergroup_lag")
    )
    job = F.when(c("event_type") == "signup", "node-exporter").otherwise("cadvisor")
    group = F.concat_ws("-", F.lit("flink-streaming"), "scenario", "run_id")
    labels = F.create_map(
        F.lit("job"), job,
        F.lit("name"), F.concat(F.lit("app-"), (c("user_id") % 4).cast("string")),
        F.lit("mode"), F.when(c("user_id") % 2 == 0, "idle").otherwise("user"),
        F.lit("strategy"), c("strategy"),
        F.lit("scenario"), c("scenario"),
        F.lit("run_id"), c("run_id"),
        F.lit("consumergroup"), group,
    )
    # Events may share a millisecond; a scrape time must not repeat within a series.
    moment = F.timestamp_micros(c("produced_at") * 1000 + c("event_no") % 1000)
    return log.select(metric.alias("metric"), labels.alias("labels"), moment.alias("ts"), "value")


def slot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45 runs one after the other over the month."""
    keys = event_log(spark, sf_dir).select(*KEY).distinct()
    place = lambda values, name: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) - 1
    number = F.substring("run_id", 5, 9).cast("bigint") - 1
    slot = (place(STRATEGIES, "strategy") * 3 + place(SCENARIOS, "scenario")) * 5 + number
    return keys.select(
        *KEY,
        (F.lit(ORIGIN_MS) + slot * SLOT_MS).alias("start_ms"),
        (F.lit(ORIGIN_MS) + slot * SLOT_MS + SLOT_MS - 1).alias("end_ms"),
        F.lit(float(SLOT_MS // 1000)).alias("duration_s"),
    )


def timeline_runs(log: DataFrame) -> DataFrame:
    """Duration, generated events and load profile of each run, with one fallback rate."""
    runs = profile_runs(generator_summaries(log), run_metadata(log))
    return runs.withColumn("fallback_rate", F.lit(10000))
