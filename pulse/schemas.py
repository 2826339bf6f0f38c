"""Table schemas, the run key and the fixed values every report shares."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["strategy", "scenario", "run_id"]

# --- Fixed values -----------------------------------------------------------

STRATEGIES = ["batch", "microbatch", "streaming"]
SCENARIOS = ["low-load", "medium-load", "high-load"]
SCENARIO_TARGET_EPS = {"low-load": 2000, "medium-load": 10000, "high-load": 30000}

STRATEGY_LABELS = {
    "batch": "Batch",
    "microbatch": "Micro-batch",
    "streaming": "Streaming",
}
SCENARIO_LABELS = {
    "low-load": "Carga baja",
    "medium-load": "Carga media",
    "high-load": "Carga alta",
}

# Latency and produce-latency histogram upper bounds, in ms.
LATENCY_BOUNDS = [1, 2, 5, 10, 20, 50, 100, 250, 500, 1000, 2000, 5000, 10000]
PRODUCE_BOUNDS = [0.5, 1, 2, 5, 10, 20, 50, 100, 250, 500, 1000]

# (start_s, end_s, start_rate, end_rate)
LOAD_PROFILES = {
    "bursty": [
        (0, 60, 2000, 2000),
        (60, 120, 2000, 10000),
        (120, 180, 10000, 10000),
        (180, 210, 10000, 1000),
        (210, 240, 1000, 1000),
        (240, 270, 1000, 5000),
        (270, 300, 5000, 5000),
    ],
    "cyclic": [
        (0, 30, 5000, 5000),
        (30, 60, 15000, 15000),
        (60, 90, 30000, 30000),
        (90, 120, 5000, 5000),
        (120, 135, 60000, 60000),
        (135, 150, 5000, 5000),
    ],
}
PROFILE_PERIOD_S = {"cyclic": 150}

MIN_PAYLOAD_BYTES = 1500
EVENT_BYTES_RANGE = (1600, 1900)
OFFICIAL_DURATION_S = 300
EXTREME_LATENCY_MS = 300_000
PLAUSIBLE_FROM_MS = 1577836800000  # 2020-01-01
PLAUSIBLE_TO_MS = 1893456000000  # 2030-01-01
REAL_LAG_SOURCE = "real_prometheus"

# Display sample: rows kept per run.
SAMPLE_ROWS_PER_RUN = 20_000
SINK_PAGE_ROWS = 5000

# JDBC rows per flush, by mode.
FLUSH_ROWS = {"batch": 500, "microbatch": 1000, "streaming": 2000}

SINK_DEFAULTS = {"strategy": "unknown", "scenario": "unknown", "run_id": "unset"}

# File names in a result tree <root>/<strategy>/<scenario>/<run_id>/<file>.
LATENCY_FILE = "latency_samples.csv"
METADATA_FILE = "run_metadata.json"
SUMMARY_FILE = "run_summary.json"
GENERATOR_FILE = "generator_summary.json"
SNAPSHOT_FILE = "prometheus_snapshot.csv"
LAG_FILE = "kafka_lag_timeseries.csv"
RESOURCES_FILE = "resources_timeseries.csv"
REQUIRED_ARTIFACTS = [LATENCY_FILE, METADATA_FILE, SUMMARY_FILE, GENERATOR_FILE]

SNAPSHOT_METRICS = [
    "cpu_total_cores",
    "mem_rss_bytes",
    "tput_produced_eps",
    "tput_sink_eps",
    "kafka_consumer_lag",
    "kafka_consumer_lag_real_present",
    "latency_p50_ms",
    "latency_p95_ms",
    "latency_p99_ms",
]

OFFICIAL_COLUMNS = [
    "strategy",
    "scenario",
    "run_id",
    "target_eps",
    "generated_events",
    "visible_events_cutoff",
    "visible_events_final",
    "official_duration_s",
    "generated_eps_real",
    "visible_eps_cutoff",
    "delivery_ratio_cutoff_pct",
    "delivery_ratio_final_pct",
    "pending_visibility_events",
    "time_to_drain_s",
    "latency_p50_ms",
    "latency_p95_ms",
    "latency_p99_ms",
    "cpu_avg_cores",
    "memory_rss_avg_mb",
    "kafka_lag_real_available",
    "kafka_lag_max",
]

# --- Schemas ----------------------------------------------------------------


_TYPES = {
    "BINARY": T.BinaryType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(ddl: str) -> T.StructType:
    """Schemas are made at import, when there may be no session to parse DDL."""
    fields = [field.split() for field in ddl.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


KAFKA_RECORD = _struct(
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)
ENVELOPE = _struct(
    "event_id STRING, produced_at BIGINT, payload STRING, strategy STRING, scenario STRING, run_id STRING"
)
SINK_EVENT = _struct(
    "event_id STRING, produced_at BIGINT, visible_at BIGINT, payload STRING,"
    " strategy STRING, scenario STRING, run_id STRING"
)
LATENCY_SAMPLE = _struct(
    "event_id STRING, strategy STRING, scenario STRING, run_id STRING,"
    " produced_at BIGINT, visible_at BIGINT, latency_ms DOUBLE"
)
GENERATOR_SUMMARY = _struct(
    "strategy STRING, scenario STRING, run_id STRING, target_eps BIGINT, generated_events BIGINT,"
    " total_events_generated BIGINT, generated_bytes BIGINT, produce_errors BIGINT,"
    " generation_start_epoch_ms BIGINT, generation_end_epoch_ms BIGINT,"
    " generation_duration_seconds DOUBLE, generated_eps_real DOUBLE, payload_bytes BIGINT,"
    " load_profile STRING"
)
RUN_METADATA = _struct(
    "strategy STRING, scenario STRING, run_id STRING, target_eps BIGINT,"
    " official_duration_seconds DOUBLE, warmup_seconds DOUBLE, cooldown_seconds DOUBLE,"
    " payload_bytes BIGINT, kafka_topic STRING, kafka_partitions INT, sink STRING,"
    " generation_start_ts BIGINT, generation_end_ts BIGINT, processing_start_ts BIGINT,"
    " processing_end_ts BIGINT, run_start_ts BIGINT, run_end_ts BIGINT, git_commit STRING,"
    " branch STRING, started_at_utc STRING, load_profile STRING, compute_region STRING,"
    " brazil_network_mode STRING, broker_endpoint_used STRING, sink_endpoint_used STRING"
)
RUN_SUMMARY = _struct(
    "strategy STRING, scenario STRING, run_id STRING, target_eps BIGINT, generated_events BIGINT,"
    " visible_events BIGINT, official_duration_seconds DOUBLE, generation_duration_seconds DOUBLE,"
    " generated_eps_real DOUBLE, visible_eps_equivalent DOUBLE, delivery_ratio_pct DOUBLE,"
    " latency_p50_ms DOUBLE, latency_p95_ms DOUBLE, latency_p99_ms DOUBLE, kafka_lag_max DOUBLE,"
    " kafka_lag_mean DOUBLE, kafka_lag_real_present BOOLEAN, cpu_cores_avg DOUBLE,"
    " cpu_avg_cores DOUBLE, mem_rss_mb_avg DOUBLE, memory_rss_avg_mb DOUBLE,"
    " processing_duration_seconds DOUBLE, estimated_backlog_events BIGINT"
)
SNAPSHOT = _struct(
    "strategy STRING, scenario STRING, run_id STRING, metric STRING, value DOUBLE, unit STRING"
)
LAG_SERIES = _struct(
    "timestamp BIGINT, strategy STRING, scenario STRING, run_id STRING, consumer_group STRING,"
    " topic STRING, lag DOUBLE, lag_source STRING"
)
RESOURCE_SERIES = _struct(
    "timestamp BIGINT, strategy STRING, scenario STRING, run_id STRING, cpu_cores DOUBLE,"
    " mem_rss_bytes DOUBLE"
)
IOT_FIELDS = _struct(
    "device_id STRING, temperature_c DOUBLE, humidity_pct DOUBLE, pressure_hpa DOUBLE,"
    " battery_v DOUBLE, status STRING"
)
TICK_FIELDS = _struct(
    "symbol STRING, exchange STRING, price DOUBLE, bid DOUBLE, ask DOUBLE, volume DOUBLE,"
    " trade_id STRING"
)
HEALTH_FIELDS = _struct(
    "patient_id STRING, device_model STRING, heart_rate_bpm INT, spo2_pct DOUBLE,"
    " steps_delta INT, alert BOOLEAN, location STRING"
)
DOMAIN_FIELDS = {
    "iot_sensor": IOT_FIELDS,
    "financial_tick": TICK_FIELDS,
    "health_monitor": HEALTH_FIELDS,
}
DEFAULT_DOMAIN = "iot_sensor"
