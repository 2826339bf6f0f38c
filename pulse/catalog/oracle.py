"""SQL for the named queries, written from what each should give, for another engine to run."""

from __future__ import annotations

from pulse.catalog.inputs import LOST_FROM, ORIGIN_MS, SLOT_MS, SPEEDUP
from pulse.schemas import (
    LATENCY_BOUNDS,
    LOAD_PROFILES,
    PRODUCE_BOUNDS,
    SCENARIO_LABELS,
    SCENARIO_TARGET_EPS,
    SCENARIOS,
    STRATEGIES,
    STRATEGY_LABELS,
)

_SQL: dict[str, str] = {}
K = "strategy, scenario, run_id"


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def _values(name: str, columns: str, rows) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


# --- the inputs, one named table expression each --------------------------------------------


def _log(speedup: int) -> str:
    ms = "epoch_us(ts) // 1000"
    at = ms if speedup == 1 else f"{ORIGIN_MS} + ({ms} - {ORIGIN_MS}) // {speedup}"
    return f"""log AS (
      SELECT *, visible_at - produced_at AS latency_ms FROM (
        SELECT *, produced_at + CASE strategy WHEN 'batch' THEN 120000 WHEN 'microbatch' THEN 5000
                                ELSE 200 END + floor(value * 100)::BIGINT AS visible_at
        FROM (
          SELECT '00000000-0000-0000-0000-' || lpad(event_id::VARCHAR, 12, '0') AS event_id,
                 event_id AS event_no, user_id, event_type, value, props AS payload,
                 CASE event_id % 3 WHEN 0 THEN 'batch' WHEN 1 THEN 'microbatch'
                      ELSE 'streaming' END AS strategy,
                 CASE user_id % 3 WHEN 0 THEN 'low-load' WHEN 1 THEN 'medium-load'
                      ELSE 'high-load' END AS scenario,
                 'run_' || (user_id % 5 + 1) AS run_id, {at} AS produced_at
          FROM events)))"""


_PARTS = {
    "log": _log(SPEEDUP),
    "month": _log(1),
    "samples": f"samples AS (SELECT * FROM log WHERE value < {LOST_FROM})",
    "ships": """ships AS (
      SELECT *, visible_at - produced_at AS latency_ms FROM (
        SELECT l_orderkey || '-' || l_linenumber AS event_id, epoch_us(o_orderdate) // 1000 AS produced_at,
               epoch_us(l_shipdate) // 1000 AS visible_at, l_returnflag AS strategy,
               o_orderpriority AS scenario, l_linestatus AS run_id, l_partkey, l_suppkey, l_quantity,
               l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))""",
    "records": """records AS (
      SELECT log.*, copy, CASE WHEN copy = 0 THEN event_no % 101 ELSE 0 END AS flaw
      FROM log, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR event_no % 7 = 0)""",
    "clean": """clean AS (
      SELECT event_id, event_no, produced_at + copy AS produced_at,
             CASE WHEN flaw = 7 THEN '' WHEN copy = 1 THEN 'copy' ELSE payload END AS payload,
             strategy, scenario, run_id
      FROM records WHERE flaw NOT BETWEEN 1 AND 6
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY copy) = 1)""",
    "stored": """stored AS (
      SELECT event_id, produced_at, payload, strategy, scenario, run_id,
             produced_at + CASE strategy WHEN 'batch' THEN 120000 WHEN 'microbatch' THEN 5000 ELSE 200 END
             + event_no * 7919 % 40000 AS visible_at, event_no
      FROM clean)""",
    "gen": f"""gen AS (
      SELECT {K}, count(*) AS generated_events, sum(strlen(payload))::BIGINT AS generated_bytes,
             min(produced_at) AS start_ms, max(produced_at) AS end_ms,
             greatest(0.001::DOUBLE, (max(produced_at) - min(produced_at)) / 1000.0::DOUBLE) AS seconds,
             CASE run_id WHEN 'run_1' THEN 'cyclic' WHEN 'run_2' THEN 'bursty' ELSE 'constant' END AS profile
      FROM log GROUP BY {K})""",
    "meta": f"""meta AS (
      SELECT {K}, CASE scenario WHEN 'low-load' THEN 2000 WHEN 'medium-load' THEN 10000 ELSE 30000 END
             + CASE run_id WHEN 'run_5' THEN 1 ELSE 0 END AS target_eps,
             max(produced_at) // 1000 AS end_s, count(*) % 50 AS processing_s, count(*) % 2 AS commit_no
      FROM log GROUP BY {K})""",
    "summ": f"""summ AS (
      SELECT {K}, count(*) AS generated, count(*) FILTER (value < {LOST_FROM}) AS seen,
             CASE WHEN run_id <> 'run_4' THEN count(*) FILTER (value < {LOST_FROM}) END AS visible,
             (max(produced_at) - min(produced_at)) / 1000.0::DOUBLE AS seconds,
             CASE WHEN run_id <> 'run_3' THEN count(*) / 1000.0::DOUBLE END AS cpu,
             CASE WHEN run_id <> 'run_3' THEN count(*) * 2.0::DOUBLE END AS mem
      FROM log GROUP BY {K})""",
    "lag": f"""lag AS (
      SELECT {K}, floor(value) AS lag, event_type = 'purchase' AS is_real FROM log
      WHERE event_type IN ('error', 'purchase'))""",
    "res": f"""res AS (
      SELECT {K}, floor(value) / 4 AS cpu, floor(value) AS mem FROM log WHERE event_type = 'view')""",
    "readings": f"""readings AS (
      SELECT {K}, ['cpu_total_cores', 'mem_rss_bytes', 'kafka_consumer_lag',
                   'kafka_consumer_lag_real_present', 'latency_p50_ms', 'latency_p95_ms',
                   'latency_p99_ms'][event_no % 7 + 1] AS metric,
             CASE WHEN event_no % 13 <> 0 THEN floor(value) ELSE 0 END AS value, event_no AS line
      FROM log)""",
    "pivot": f"""pivoted AS (
      SELECT {K}, {{}}
      FROM readings GROUP BY {K})""".replace(
        "{}",
        ", ".join(
            f"coalesce(max_by(value, line) FILTER (metric = '{m}'), 0)::DOUBLE AS {m}"
            for m in (
                "cpu_total_cores", "mem_rss_bytes", "tput_produced_eps", "tput_sink_eps",
                "kafka_consumer_lag", "kafka_consumer_lag_real_present", "latency_p50_ms",
                "latency_p95_ms", "latency_p99_ms",
            )
        ),
    ),
    "scraped": """scraped AS (
      SELECT CASE event_type WHEN 'click' THEN 'container_cpu_usage_seconds_total'
               WHEN 'view' THEN 'container_memory_rss' WHEN 'purchase' THEN 'kafka_produced_messages_total'
               WHEN 'signup' THEN 'node_cpu_seconds_total' ELSE 'kafka_consumergroup_lag' END AS metric,
             'app-' || (user_id % 4) AS name, CASE user_id % 2 WHEN 0 THEN 'idle' ELSE 'user' END AS mode,
             strategy, scenario, run_id, produced_at, produced_at * 1000 + event_no % 1000 AS at_us, value
      FROM log)""",
}


def _sql(name: str, parts: str, body: str) -> None:
    _SQL[name] = "WITH " + ",\n".join(_PARTS.get(p, p) for p in parts.split()) + "\n" + body


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(_PARTS.get(p, p) for p in parts) + "\n"


def _stats(keys: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS latency_rows,
      round(quantile_cont(latency_ms, 0.5), 3) AS latency_p50_ms,
      round(quantile_cont(latency_ms, 0.95), 3) AS latency_p95_ms,
      round(quantile_cont(latency_ms, 0.99), 3) AS latency_p99_ms,
      min(latency_ms)::DOUBLE AS latency_min_ms, max(latency_ms)::DOUBLE AS latency_max_ms
    FROM {source} GROUP BY {keys}"""


# --- ingestion ---------------------------------------------------------------------------------

_SQL["latency_by_scenario_strategy"] = _with(
    "log", "records", "clean", "stored",
    "timed AS (SELECT *, visible_at - produced_at AS latency_ms FROM stored)",
) + _stats("strategy, scenario", "timed")

_REASON = """CASE WHEN flaw IN (1, 2, 6) THEN 'malformed_json' WHEN flaw = 3 THEN 'null_value'
  WHEN flaw = 4 THEN 'missing_run_id' WHEN flaw = 5 THEN 'invalid_event_id' ELSE 'accepted' END"""
_sql("ingest_accept_reject", "log records",
     f"SELECT {_REASON} AS reason, count(*) AS records FROM records GROUP BY 1")
_sql("ingest_quarantine", "log records",
     f"""SELECT (event_no % 12)::INTEGER AS "partition", event_no // 12 * 2 + copy AS "offset",
         {_REASON} AS reasons FROM records WHERE flaw BETWEEN 1 AND 6""")
_ENVELOPE = f"event_id, produced_at, payload, {K}"
_sql("ingest_first_wins", "log records clean", f"SELECT {_ENVELOPE} FROM clean")
_sql("shipping_first_wins", "ships", """SELECT * FROM ships QUALIFY row_number() OVER (
  PARTITION BY event_id ORDER BY visible_at, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
_sql("ingest_insert_if_absent", "log records clean", f"SELECT {_ENVELOPE} FROM clean WHERE event_no % 2 <> 0")
_sql("ingest_bounded_offsets", "log records", """
  SELECT part AS "partition", count(*) AS records, min(place) AS first, max(place) AS last
  FROM (SELECT (event_no % 12)::INTEGER AS part, event_no // 12 * 2 + copy AS place FROM records)
  WHERE place >= 4 AND (part >= 6 OR place < 100) GROUP BY part""")
_sql("ingest_replay", "log records clean stored",
     f"""SELECT {_ENVELOPE}, visible_at, CASE WHEN event_no % 12 < 6 THEN 'a' ELSE 'b' END AS batch_id
         FROM stored""")
_sql("ingest_repeat_changed", "log records clean",
     f"SELECT {_ENVELOPE}, 0::BIGINT AS bad_records FROM clean WHERE strategy = 'batch'")
_sql("ingest_many_batches", "log records clean stored",
     f"""SELECT {_ENVELOPE}, visible_at, 'part-' || lpad((event_no % 12 + 12 * copy)::VARCHAR, 12, '0') AS batch_id
         FROM stored JOIN (SELECT event_no, min(copy) AS copy FROM records WHERE flaw NOT BETWEEN 1 AND 6 GROUP BY event_no) USING (event_no)""")
_sql("stream_dedupe_state", "log records clean stored",
     f"SELECT {_ENVELOPE}, visible_at, event_no % 12 >= 4 AS streamed FROM stored")
_sql("ingest_one_scan", "log records", """,
  placed AS (SELECT *, event_no % 12 AS part, event_no // 12 * 2 + copy AS place FROM records),
  ends AS (SELECT part, (max(place) + 1) // 2 AS half FROM placed GROUP BY part),
  told AS (SELECT event_no, copy, CASE WHEN place < half THEN 'first half' ELSE 'second half' END AS batch_id,
             CASE flaw WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'malformed_json' WHEN 3 THEN 'null_value' WHEN 4 THEN 'missing_run_id'
                  WHEN 5 THEN 'invalid_event_id' WHEN 6 THEN 'malformed_json' ELSE 'accepted' END AS reason
           FROM placed JOIN ends USING (part)),
  firsts AS (SELECT * FROM told WHERE reason <> 'accepted' UNION ALL
             SELECT * FROM (SELECT * FROM told WHERE reason = 'accepted' QUALIFY row_number() OVER (PARTITION BY event_no ORDER BY copy) = 1))
  SELECT batch_id, reason, count(*) AS records FROM firsts GROUP BY batch_id, reason""")
_sql("stream_equals_batch", "log records clean stored", f"SELECT {_ENVELOPE}, visible_at FROM stored")
_sql("stream_drains", "log records clean stored", f"SELECT {_ENVELOPE}, visible_at FROM stored")
_SAMPLE = f"event_id, {K}, produced_at, visible_at, latency_ms::DOUBLE AS latency_ms"
_sql("stream_samples", "log", f"SELECT {_SAMPLE} FROM log")

_GAUGE = """SELECT strategy, scenario, count(*) AS rows_seen, max(visible_at) AS last_visible_at_ms,
  sum(latency_ms)::BIGINT AS latency_sum_ms, """ + ", ".join(
    f"count(*) FILTER (latency_ms <= {b}) AS le_{b}" for b in LATENCY_BOUNDS
)
_sql("live_monitor_stream", "log", _GAUGE + " FROM log GROUP BY strategy, scenario")
_sql("live_gauge", "log samples", _GAUGE + " FROM samples GROUP BY strategy, scenario")

# --- typed domain events -------------------------------------------------------------------------

_RULES = {
    "iot_sensor": {
        "temperature_range": "value - 20 < -10 OR value - 20 > 60",
        "humidity_range": "value + 10 < 10 OR value + 10 > 99.9::DOUBLE",
        "pressure_range": "value + 950 < 950 OR value + 950 > 1050",
        "battery_range": "false",
        "status_unknown": "user_id % 10 = 0",
    },
    "financial_tick": {
        "quote_disorder": "event_no % 11 = 0",
        "price_range": "value < 1 OR value > 80000",
    },
    "health_monitor": {
        "alert_mismatch": "floor(value) + 40 < 45",
        "heart_rate_range": "floor(value) + 40 > 180",
        "steps_range": "user_id % 25 > 20",
    },
}
_KIND = """CASE event_type WHEN 'purchase' THEN 'financial_tick' WHEN 'signup' THEN 'health_monitor'
  ELSE 'iot_sensor' END"""
_CHECKS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{rule}' AS rule, count(*) FILTER ({test}) AS violations"
    f" FROM log WHERE {_KIND} = '{kind}'"
    for kind, rules in _RULES.items()
    for rule, test in rules.items()
)
_SQL["typed_domain_parse"] = _with("log", f"checks AS ({_CHECKS})") + f"""
  SELECT schema, records, r.rule, coalesce(violations, 0) AS violations
  FROM (SELECT {_KIND} AS schema, count(*) AS records FROM log GROUP BY 1) AS k
  CROSS JOIN (SELECT DISTINCT rule FROM checks) AS r
  LEFT JOIN checks ON checks.kind = k.schema AND checks.rule = r.rule"""
_sql("domain_ticks", "log", """
  SELECT CASE user_id % 2 WHEN 0 THEN 'AAPL' ELSE 'MSFT' END AS symbol, 'nyse' AS exchange,
         count(*) AS ticks,
         round(min(CASE WHEN event_no % 11 = 0 THEN value + 1 ELSE value - 0.5 END), 6) AS lowest_bid,
         round(max(value + 0.5), 6) AS highest_ask, round(sum(value * 2), 6) AS volume
  FROM log WHERE event_type = 'purchase' GROUP BY 1, 2""")
_sql("domain_views", "log", f"""
  SELECT {_KIND} AS kind, count(*) AS events,
         round(sum(CASE {_KIND} WHEN 'iot_sensor' THEN value - 20 WHEN 'financial_tick' THEN value
                   ELSE floor(value) + 40 END), 4) AS total
  FROM log GROUP BY 1""")

# --- scans of the sink, projections -----------------------------------------------------------------

_sql("sink_samples", "log", """
  SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE strategy END AS strategy, scenario,
         CASE WHEN user_id % 7 <> 0 THEN run_id ELSE 'unset' END AS run_id, produced_at, visible_at,
         latency_ms::DOUBLE AS latency_ms
  FROM log""")
_sql("run_extract", "log", f"""SELECT {_SAMPLE} FROM log
  WHERE strategy = 'batch' AND scenario = 'low-load' AND run_id = 'run_1'""")
_sql("tree_samples", "log samples", f"SELECT {_SAMPLE} FROM samples WHERE event_no % 50 <> 0")
_sql("tree_documents", "log gen meta summ", f"""
  SELECT {K}, meta.target_eps::DOUBLE AS target_eps, 'commit-' || commit_no AS git_commit, summ.visible::DOUBLE AS visible_events,
         summ.mem AS memory_rss_avg_mb, gen.generated_events::DOUBLE AS generated_events, gen.profile AS load_profile
  FROM gen JOIN meta USING ({K}) JOIN summ USING ({K})""")
_sql("tree_snapshots", "log", f"""
  SELECT {K}, event_type AS metric, count(*) AS rows, count(*) FILTER (event_no % 9 <> 0) AS readable,
         (sum(event_no % 1000) FILTER (event_no % 9 <> 0))::DOUBLE AS total FROM log GROUP BY ALL""")
_sql("tree_series", "log", f""",
  readings AS (
    SELECT {K}, CASE event_type WHEN 'purchase' THEN 'real_prometheus' ELSE 'unknown' END AS kind, floor(value)::DOUBLE AS v
    FROM log WHERE event_type IN ('purchase', 'error')
    UNION ALL SELECT {K}, 'memory', floor(value) * 1048576 FROM log WHERE event_type = 'view'
    UNION ALL SELECT {K}, 'cores', floor(value) FROM log WHERE event_type = 'view')
  SELECT {K}, kind, count(*) AS rows, sum(v) AS total FROM readings GROUP BY ALL""")
_sql("tree_missing_columns", "log samples", """
  SELECT strategy, count(*) AS rows, count(*) FILTER (strategy <> 'streaming') AS timed, sum(latency_ms)::DOUBLE AS latency
  FROM samples GROUP BY strategy""")
_sql("report_files", "log samples", """
  SELECT kind, strategy, count(*) AS rows FROM samples, (VALUES ('report'), ('samples'), ('documents')) AS k(kind) GROUP BY ALL""")
_sql("keyset_all_pages", "log", """
  SELECT (row_number() OVER (ORDER BY visible_at, event_id) - 1) // 25 AS page, event_id, visible_at
  FROM log WHERE strategy = 'streaming' AND scenario = 'high-load' AND run_id = 'run_3'""")
_sql("keyset_page", "log", f"""SELECT event_id, visible_at FROM log
  WHERE strategy = 'streaming' AND scenario = 'high-load' AND run_id = 'run_3'
    AND (visible_at, event_id) > ({ORIGIN_MS + 150_000}, '00000000-0000-0000-0000-000000000500')
  ORDER BY visible_at, event_id LIMIT 100""")
_sql("bounded_sample_rows", "log", f"""SELECT event_id, {K}, latency_ms FROM log
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY md5('42:' || event_id)) <= 40""")
_sql("bounded_sample_counts", "ships", f"SELECT {K}, least(count(*), 1500) AS rows FROM ships GROUP BY {K}")
_sql("lenient_numbers", "log", """
  SELECT event_type, count(*) FILTER (event_no % 10 < 3) AS unparsable,
         count(*) FILTER (event_no % 10 >= 3) AS parsed,
         round(sum(value) FILTER (event_no % 10 >= 3), 4) AS total
  FROM log GROUP BY event_type""")
_safe = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9_-]', '_', 'g')"
_SQL["names_and_units"] = f"""
  SELECT c_custkey, {_safe('c_name')} AS safe,
         'events_' || {_safe('c_mktsegment')} || '_' || {_safe('c_name')} || '_' || c_nationkey || '_' || c_custkey AS topic,
         strftime(TIMESTAMP '1970-01-01' + to_seconds(c_custkey * 86399), '%Y-%m-%dT%H:%M:%SZ') AS iso,
         greatest(1500, c_custkey) AS payload_bytes, c_custkey < 1500 AS raised, c_custkey * 1000 AS ms,
         round(c_acctbal * 1000 / 1048576.0::DOUBLE, 6) AS mib,
         CASE WHEN c_acctbal > 0 THEN round(c_custkey / c_acctbal, 6) END AS guarded,
         CASE WHEN c_acctbal > 0 THEN round(c_custkey / c_acctbal, 6) ELSE 0 END AS guarded_zero,
         greatest(c_acctbal, 0) AS clamped
  FROM customer"""


def _case(column: str, pairs, otherwise: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in pairs)
    return f"CASE {column} {arms} ELSE {otherwise} END"


_sql("display_labels", "log", f"""
  SELECT count(*) AS rows, {_case('strategy', STRATEGY_LABELS.items(), 'strategy')} AS strategy_label,
         {_case('s', SCENARIO_LABELS.items(), 's')} AS scenario_label,
         {_case('s', [(v, i + 1) for i, v in enumerate(SCENARIOS)], '4')}::BIGINT AS scenario_rank,
         {_case('strategy', [(v, i + 1) for i, v in enumerate(STRATEGIES)], '4')}::BIGINT AS strategy_rank,
         s IN ('low-load', 'medium-load', 'high-load') AS official
  FROM (SELECT *, CASE WHEN user_id % 4 = 3 THEN event_type ELSE scenario END AS s FROM log)
  GROUP BY strategy, s""")
_sql("plausible_times", "ships", """
  SELECT strategy, count(*) FILTER (visible_at BETWEEN 1577836800000 AND 1893456000000) AS plausible,
         count(*) FILTER (visible_at NOT BETWEEN 1577836800000 AND 1893456000000) AS implausible
  FROM ships GROUP BY strategy""")

# --- latency ----------------------------------------------------------------------------------------

_RUN_STATS = f"""SELECT {K}, count(*) AS latency_rows, count(visible_at) AS visible_events_final_latency,
    max(visible_at) AS last_visible_at_ms, count(*) FILTER (latency_ms > 0) AS latency_positive_count,
    count(*) FILTER (latency_ms <= 0) AS latency_non_positive_count,
    round(quantile_cont(latency_ms, 0.5), 3) AS latency_p50_ms,
    round(quantile_cont(latency_ms, 0.95), 3) AS latency_p95_ms,
    round(quantile_cont(latency_ms, 0.99), 3) AS latency_p99_ms,
    min(latency_ms)::DOUBLE AS latency_min_ms, max(latency_ms)::DOUBLE AS latency_max_ms
  FROM samples GROUP BY {K}"""
_PARTS["stats"] = f"stats AS ({_RUN_STATS})"
_sql("run_stats", "log samples", _RUN_STATS)
_sql("scenario_stats", "log samples", _stats("strategy, scenario", "samples"))
_sql("shipping_stats", "ships", _stats("strategy, scenario", "ships"))
_SQL["latency_summary"] = _with("log", "samples", f"st AS ({_stats('strategy, scenario', 'samples')})") + f"""
  SELECT {_case('strategy', STRATEGY_LABELS.items(), 'strategy')} AS strategy_label,
         {_case('scenario', SCENARIO_LABELS.items(), 'scenario')} AS scenario_label,
         latency_rows AS visible_events, round(latency_p50_ms, 2) AS latency_p50_ms,
         round(latency_p95_ms, 2) AS latency_p95_ms, round(latency_p99_ms, 2) AS latency_p99_ms,
         latency_min_ms, latency_max_ms
  FROM st"""
_BOX = """SELECT scenario, strategy, count(*) AS rows,
    round(quantile_cont(latency_ms, 0.25), 3) AS q1, round(quantile_cont(latency_ms, 0.5), 3) AS median,
    round(quantile_cont(latency_ms, 0.75), 3) AS q3"""
_sql("five_numbers", "ships",
     _BOX + ", min(latency_ms) AS minimum, max(latency_ms) AS maximum FROM ships GROUP BY scenario, strategy")
_sql("quantiles_wide_and_narrow", "log", """,
  numbers AS (
    SELECT 'fraction' AS kind, strategy, (event_no * 7919 % 100003) / 100003.0::DOUBLE AS x FROM log
    UNION ALL SELECT 'moment', strategy, produced_at::DOUBLE FROM log
    UNION ALL SELECT 'wide', strategy, (event_no * event_no * 104729 % 1000000000000000)::DOUBLE FROM log)
  SELECT kind, strategy, round(quantile_cont(x, 0.01), 3) AS p01, round(quantile_cont(x, 0.5), 3) AS p50,
         round(quantile_cont(x, 0.99), 3) AS p99 FROM numbers GROUP BY kind, strategy""")
_SQL["box_stats"] = _with(
    "ships", "late AS (SELECT * FROM ships WHERE latency_ms > 0)",
    f"box AS ({_BOX} FROM late GROUP BY scenario, strategy)",
) + """
  SELECT box.*, w.whisker_low, w.whisker_high, w.rows_inside FROM box JOIN (
    SELECT scenario, strategy, min(latency_ms) AS whisker_low, max(latency_ms) AS whisker_high,
           count(*) AS rows_inside
    FROM late JOIN box USING (scenario, strategy)
    WHERE latency_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
    GROUP BY scenario, strategy) AS w USING (scenario, strategy)"""


def _histogram(keys: str, value: str, source: str, bounds, total: str) -> str:
    les = " UNION ALL ".join(
        [f"SELECT {keys}, '{b}' AS le, count(*) FILTER ({value} <= {b}) AS cumulative FROM {source} GROUP BY {keys}"
         for b in bounds] + [f"SELECT {keys}, '+Inf', count(*) FROM {source} GROUP BY {keys}"]
    )
    return f"""SELECT h.*, value_sum, observations FROM ({les}) AS h JOIN (
      SELECT {keys}, {total} AS value_sum, count(*) AS observations FROM {source} GROUP BY {keys}) AS t
      USING ({keys})"""


_sql("latency_histogram", "log samples",
     _histogram("strategy, scenario", "latency_ms", "samples", LATENCY_BOUNDS, "sum(latency_ms)::BIGINT"))
_sql("produce_histogram", "log", _histogram(K, "value", "log", PRODUCE_BOUNDS, "round(sum(value), 4)"))


def _average_ranks(block: str, source: str) -> str:
    """Average rank of tied values, from the plain rank and the number of equals."""
    return f"""SELECT *, (rank() OVER (PARTITION BY {block} ORDER BY latency_ms)
        + (count(*) OVER (PARTITION BY {block}, latency_ms) - 1) / 2.0::DOUBLE)::DOUBLE AS r,
        (count(*) OVER (PARTITION BY {block}, latency_ms))::DOUBLE AS t
      FROM {source}"""


def _kruskal(source: str, digits: int) -> str:
    return f"""
  ranked AS ({_average_ranks('scenario', source)}),
  groups AS (SELECT scenario, strategy, count(*)::DOUBLE AS n, sum(r) AS rs, sum(t * t - 1) AS ties
             FROM ranked GROUP BY scenario, strategy),
  whole AS (SELECT scenario, sum(n) AS rows, count(*) AS groups, sum(rs * rs / n) AS sq, sum(ties) AS ties
            FROM groups GROUP BY scenario),
  tested AS (SELECT *, (12.0::DOUBLE / (rows * (rows + 1)) * sq - 3 * (rows + 1))
                       / (1 - ties / (rows * rows * rows - rows)) AS h FROM whole)
  SELECT scenario, rows, groups, round(h, {digits}) AS kruskal_h, round(exp(-h / 2), {digits}) AS kruskal_p
  FROM tested"""


_SQL["kruskal_wallis"] = _with("log", "samples") + "," + _kruskal("samples", 6)
_SQL["shipping_rank_tests"] = _with("ships") + "," + _kruskal("ships", 5)
#: 2·(1 − Φ(z)) by the series of the error function, each term from its logarithm.
_TAILS = """CASE WHEN z >= 8 THEN 0.0::DOUBLE WHEN z <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(-z * z / 2)
    * list_sum(list_transform(range(0, 151), lambda k: exp(2 * k * ln(2.0::DOUBLE) + (2 * k + 1) * ln(z / sqrt(2.0::DOUBLE))
        + lgamma(k + 1.0::DOUBLE) - lgamma(2 * k + 2.0::DOUBLE))))) END"""
_PAIRS_TESTED = f"""
  pairs(a, b) AS (VALUES ('batch', 'microbatch'), ('batch', 'streaming'), ('microbatch', 'streaming')),
  both_sides AS (SELECT scenario, a || '_vs_' || b AS pair, strategy = a AS is_left, latency_ms
                 FROM samples JOIN pairs ON strategy IN (a, b)),
  ranked AS ({_average_ranks('scenario, pair', 'both_sides')}),
  sums AS (SELECT scenario, pair, count(*) FILTER (is_left)::DOUBLE AS n1,
                  count(*) FILTER (NOT is_left)::DOUBLE AS n2,
                  sum(r) FILTER (is_left) AS r1, sum(t * t - 1) AS ties
           FROM ranked GROUP BY scenario, pair),
  us AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n1 + n2 AS n FROM sums),
  big AS (SELECT *, greatest(u1, n1 * n2 - u1) AS u FROM us),
  zs AS (SELECT *, (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM big),
  tested_pairs AS (SELECT *, {_TAILS} AS p FROM zs)"""
_SQL["mann_whitney_u"] = _with("log", "samples") + f""",{_PAIRS_TESTED}
  SELECT scenario, pair, n1, n2, u1, u,
         round(z, 5) AS z, round(p, 5) AS p, round(least(1.0::DOUBLE, 3 * p), 5) AS p_adj
  FROM tested_pairs"""

_WIDE = ", ".join(f"round(max(least(1.0::DOUBLE, 3 * p)) FILTER (pair = '{n}'), 6) AS {n}_p_adj" for n in (
    "batch_vs_microbatch", "batch_vs_streaming", "microbatch_vs_streaming"))
_SQL["statistical_tests"] = _with("log", "samples") + f""",
  whole_tests AS (WITH base AS (SELECT 1), {_kruskal('samples', 6).lstrip()}),{_PAIRS_TESTED},
  wide AS (SELECT scenario, {_WIDE} FROM tested_pairs GROUP BY scenario)
  SELECT scenario, kruskal_h, kruskal_p, CASE WHEN kruskal_p < 0.05 THEN 'si' ELSE 'no' END AS significant, wide.* EXCLUDE (scenario)
  FROM whole_tests LEFT JOIN wide USING (scenario) WHERE groups >= 2"""

# --- runs ---------------------------------------------------------------------------------------------


def _official(cutoff: str, fill: bool, rounded: bool = True, source: str = "samples") -> str:
    at_cutoff = "coalesce(cut.n, 0)" if fill else "cut.n"
    r = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    return f"""
  SELECT gen.strategy, gen.scenario, gen.run_id, meta.target_eps::BIGINT AS target_eps,
         generated AS generated_events, {at_cutoff}::BIGINT AS visible_events_cutoff,
         coalesce(visible, st.n) AS visible_events_final, 300.0::DOUBLE AS official_duration_s,
         {r('generated / 300.0::DOUBLE')} AS generated_eps_real,
         {r(at_cutoff + ' / 300.0::DOUBLE')} AS visible_eps_cutoff,
         {r(at_cutoff + ' / generated::DOUBLE * 100.0')} AS delivery_ratio_cutoff_pct,
         {r('coalesce(visible, st.n) / generated::DOUBLE * 100.0')} AS delivery_ratio_final_pct,
         CASE WHEN {at_cutoff} IS NOT NULL THEN greatest(generated - {at_cutoff}, 0)::DOUBLE END
           AS pending_visibility_events,
         CASE WHEN st.last_at IS NOT NULL THEN {r(f"greatest((st.last_at - {cutoff}) / 1000.0::DOUBLE, 0)")} END
           AS time_to_drain_s,
         {r('st.p50')} AS latency_p50_ms, {r('st.p95')} AS latency_p95_ms, {r('st.p99')} AS latency_p99_ms,
         {r('coalesce(summ.cpu, rs.cpu)')} AS cpu_avg_cores, {r('coalesce(summ.mem, rs.mem)')} AS memory_rss_avg_mb,
         coalesce(lg.found, false) AS kafka_lag_real_available, lg.highest AS kafka_lag_max
  FROM gen JOIN meta USING ({K}) JOIN summ USING ({K})
  LEFT JOIN (SELECT {K}, count(*) AS n, max(visible_at) AS last_at, quantile_cont(latency_ms, 0.5) AS p50,
                    quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99
             FROM {source} GROUP BY {K}) AS st USING ({K})
  LEFT JOIN (SELECT {K}, count(*) FILTER (visible_at <= {cutoff}) AS n
             FROM {source} JOIN gen USING ({K}) JOIN meta USING ({K}) GROUP BY {K}) AS cut USING ({K})
  LEFT JOIN (SELECT {K}, avg(cpu) AS cpu, avg(mem) AS mem FROM res GROUP BY {K}) AS rs USING ({K})
  LEFT JOIN (SELECT {K}, max(lag) AS highest, true AS found FROM lag WHERE is_real GROUP BY {K}) AS lg
    USING ({K})"""


_RUNS = "log samples gen meta summ lag res"
_sql("official_metrics", _RUNS, _official("end_ms", False))
_sql("official_metrics_whole_seconds", _RUNS, _official("end_s * 1000", True))
_SQL["official_metrics_warm"] = _with(
    *_RUNS.split(),
    f"warm AS (SELECT samples.* FROM samples JOIN gen USING ({K}) WHERE produced_at >= start_ms + 60000)",
    f"m AS ({_official('end_ms', False, source='warm')})",
) + f"SELECT {K}, visible_events_cutoff, latency_p50_ms, time_to_drain_s FROM m"
_sql("visible_at_cutoff", "log gen", f"""
  SELECT {K}, count(*) FILTER (visible_at <= end_ms) AS visible_events_cutoff
  FROM log JOIN gen USING ({K}) GROUP BY {K}""")


def _mean_sem(columns: list[str], source: str, extra: str = "") -> str:
    figures = ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(CASE WHEN count({c}) > 1 THEN"
        f" stddev_samp({c}) / sqrt(count({c})) ELSE 0 END, 6) AS {c}_sem"
        for c in columns
    )
    return f"SELECT strategy, scenario, {figures}{extra} FROM {source} GROUP BY strategy, scenario"


_METRICS = f"m AS ({_official('end_ms', False, rounded=False)})"


def _figure(name: str, columns: list[str], extra: str = "") -> None:
    _SQL[name] = _with(*_RUNS.split(), _METRICS) + _mean_sem(columns, "m", extra)


_figure("throughput_summary", ["generated_eps_real", "visible_eps_cutoff", "delivery_ratio_cutoff_pct"],
        ", " + _case("scenario", SCENARIO_TARGET_EPS.items(), "NULL") + "::INTEGER AS target_eps")
_figure("delivery_summary", ["delivery_ratio_cutoff_pct", "delivery_ratio_final_pct"])
_sem = lambda c: f"CASE WHEN count({c}) > 1 THEN stddev_samp({c}) / sqrt(count({c})) ELSE 0 END"
_P, _M = "pending_visibility_events", "memory_rss_avg_mb"
_figure("backlog_summary", [_P], f""", round(avg({_P}) / 1000000, 6) AS pending_millions_mean,
  round({_sem(_P)} / 1000000, 6) AS pending_millions_sem""")
_figure("drain_summary", ["time_to_drain_s"])
_figure("resource_summary", ["cpu_avg_cores", _M], f""", round(avg({_M}) / 1024, 6) AS memory_rss_avg_gb_mean,
  round({_sem(_M)} / 1024, 6) AS memory_rss_avg_gb_sem""")
_SQL["lag_summary"] = _with(*_RUNS.split(), _METRICS) + """
  SELECT strategy, scenario, round(avg(kafka_lag_max), 6) AS kafka_lag_max FROM m
  WHERE kafka_lag_max IS NOT NULL
    AND (SELECT count(DISTINCT (strategy, scenario)) FROM m WHERE kafka_lag_real_available) = 9
  GROUP BY strategy, scenario"""
_sql("production_totals", "log gen", f"""
  SELECT {K}, generated_events, generated_bytes, start_ms AS generation_start_epoch_ms,
         end_ms AS generation_end_epoch_ms, round(seconds, 6) AS generation_duration_seconds,
         round(generated_events / seconds, 6) AS generated_eps_real
  FROM gen""")
_sql("run_summary", "log samples gen meta readings pivot", f"""
  SELECT gen.strategy, gen.scenario, gen.run_id, target_eps::BIGINT AS target_eps, generated_events,
         coalesce(v.n, 0) AS visible_events, 300.0::DOUBLE AS official_duration_seconds,
         round(seconds, 3) AS generation_duration_seconds,
         round(generated_events / seconds, 3) AS generated_eps_real,
         round(generated_events / seconds, 3) AS generated_eps_actual,
         round(generated_events / 300.0::DOUBLE, 3) AS generated_eps_official,
         round(coalesce(v.n, 0) / 300.0::DOUBLE, 3) AS visible_eps_equivalent,
         round(coalesce(v.n, 0) / generated_events::DOUBLE * 100, 3) AS delivery_ratio_pct,
         latency_p50_ms, latency_p95_ms, latency_p99_ms,
         CASE WHEN kafka_consumer_lag_real_present >= 1 THEN kafka_consumer_lag END AS kafka_lag_max,
         CASE WHEN kafka_consumer_lag_real_present >= 1 THEN kafka_consumer_lag END AS kafka_lag_mean,
         kafka_consumer_lag_real_present >= 1 AS kafka_lag_real_present,
         cpu_total_cores AS cpu_cores_avg, round(mem_rss_bytes / 1048576.0::DOUBLE, 3) AS mem_rss_mb_avg,
         processing_s::DOUBLE AS processing_duration_seconds,
         greatest(generated_events - coalesce(v.n, 0), 0) AS estimated_backlog_events
  FROM gen JOIN meta USING ({K}) JOIN pivoted USING ({K})
  LEFT JOIN (SELECT {K}, count(*) AS n FROM samples GROUP BY {K}) AS v USING ({K})""")
_sql("snapshot_pivot", "log readings pivot", "SELECT * FROM pivoted")
_SQL["mean_sem"] = _with("ships", "d AS (SELECT *, latency_ms / 86400000.0::DOUBLE AS days FROM ships)") + _mean_sem(
    ["days", "l_quantity"], "d")
_sql("reductions", "ships", """SELECT strategy, scenario, round(avg(l_quantity), 6) AS l_quantity,
  max(l_extendedprice) AS l_extendedprice, min(latency_ms) AS latency_ms FROM ships GROUP BY strategy, scenario""")
_sql("modal_target", "log", """
  SELECT scenario, size FROM (
    SELECT scenario, size, row_number() OVER (PARTITION BY scenario ORDER BY count(*) DESC, size) AS place
    FROM (SELECT user_id, scenario, count(*) AS size FROM log GROUP BY user_id, scenario)
    GROUP BY scenario, size) WHERE place = 1""")
_sql("distinct_values", "ships", """SELECT count(DISTINCT event_id) AS event_id,
  count(DISTINCT scenario) AS scenario, count(DISTINCT latency_ms) AS latency_ms FROM ships""")
_sql("rows_per_label", "ships", f"SELECT {K}, count(*) AS rows FROM ships GROUP BY {K}")
_sql("any_violation", "ships", """SELECT bool_or(latency_ms <= 0) AS violated,
  count(*) FILTER (latency_ms <= 0) AS rows FROM ships""")
_CV = """CASE WHEN avg(latency_ms) > 0 THEN stddev_samp(latency_ms) / avg(latency_ms) * 100 ELSE 0 END"""
_sql("coefficient_of_variation", "ships",
     f"SELECT strategy, round({_CV}, 5) AS cv_pct FROM ships GROUP BY strategy")
_sql("volume_budget", "log", """
  SELECT scenario, events, bytes, budget_events, budget_bytes,
         events <= budget_events AND bytes <= budget_bytes AS within_budget
  FROM (SELECT scenario, count(*) AS events, sum(strlen(payload))::BIGINT AS bytes,
               CASE scenario WHEN 'low-load' THEN 400 WHEN 'medium-load' THEN 4000 ELSE 40000 END::BIGINT AS budget_events,
               CASE scenario WHEN 'low-load' THEN 4000 WHEN 'medium-load' THEN 40000 ELSE 400000 END::BIGINT AS budget_bytes
        FROM log GROUP BY scenario)""")
_SQL["document_volume"] = """
  SELECT source, lang, count(*) AS events, sum(strlen(text))::BIGINT AS bytes,
         count(*) FILTER (strlen(text) < 1500) AS undersized
  FROM documents GROUP BY source, lang"""

# --- the grid -------------------------------------------------------------------------------------------

_GRID = """(VALUES ('batch'), ('microbatch'), ('streaming')) AS a(strategy),
  (VALUES ('low-load'), ('medium-load'), ('high-load')) AS b(scenario)"""
_sql("missing_runs", "log", f"""
  SELECT strategy, scenario, 'run_' || i AS run_id FROM {_GRID}, range(1, 7) AS c(i)
  EXCEPT SELECT {K} FROM log WHERE value > 150""")
_sql("expected_pairs", "log", f"""
  SELECT strategy, scenario FROM {_GRID}
  EXCEPT SELECT strategy, scenario FROM log WHERE event_no % 3 + user_id % 3 <> 2""")
_ARTIFACTS = """CASE event_type WHEN 'click' THEN 'latency_samples.csv' WHEN 'view' THEN 'run_metadata.json'
  WHEN 'purchase' THEN 'run_summary.json' WHEN 'signup' THEN 'generator_summary.json' END"""
_GAPS = f"""SELECT {K}, artifact FROM (SELECT DISTINCT {K} FROM log), (VALUES ('latency_samples.csv'),
    ('run_metadata.json'), ('run_summary.json'), ('generator_summary.json')) AS r(artifact)
  EXCEPT SELECT {K}, {_ARTIFACTS} FROM log WHERE value > 60 AND user_id % 10 < 3"""
_sql("artifact_gaps", "log", _GAPS)
_sql("run_keys_union", "log ships", f"SELECT {K} FROM log UNION SELECT {K} FROM ships")
_sql("reconcile_counts", "log samples summ", f"""
  SELECT {K}, visible::DOUBLE AS visible_events, rows::DOUBLE AS rows, visible IS DISTINCT FROM rows AS differs
  FROM summ LEFT JOIN (SELECT {K}, count(*) AS rows FROM samples GROUP BY {K}) USING ({K})""")
_sql("runs_semi_join", "log", f"""SELECT {K}, count(*) AS rows FROM log WHERE run_id IN ('run_1', 'run_2')
  GROUP BY {K}""")
_sql("first_of_run", "log", f"""SELECT {K}, event_id, produced_at FROM log
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY produced_at, event_id) = 1""")
_sql("lag_coverage", "log lag", """
  SELECT s.strategy, coalesce(bool_or(is_real), false) AS covered
  FROM (VALUES ('batch'), ('microbatch'), ('streaming')) AS s(strategy)
  LEFT JOIN (SELECT * FROM lag WHERE strategy = 'streaming' OR lag > 400) AS l USING (strategy)
  GROUP BY s.strategy""")

# --- timelines ---------------------------------------------------------------------------------------------

_PARTS["runs"] = f"""runs AS (
  SELECT {K}, CASE WHEN round(seconds) > 0 THEN round(seconds)::INTEGER ELSE 300 END AS duration_s, generated_events, profile FROM gen)"""
_PARTS["origin"] = f"origin AS (SELECT {K}, min(produced_at) AS start_at FROM samples GROUP BY {K})"
_PARTS["seconds"] = f"""seconds AS (
  SELECT {K}, (visible_at - start_at) // 1000 AS elapsed_s, count(*) AS events
  FROM samples JOIN origin USING ({K}) GROUP BY ALL)"""
_PARTS["visible"] = f"""visible AS (
  SELECT {K}, elapsed_s, coalesce(events, 0) AS n,
         sum(coalesce(events, 0)) OVER (PARTITION BY {K} ORDER BY elapsed_s)::BIGINT AS cumulative_visible
  FROM (SELECT {K}, unnest(range(0, greatest(max(elapsed_s), any_value(duration_s)) + 1)) AS elapsed_s
        FROM seconds JOIN runs USING ({K}) GROUP BY {K}) LEFT JOIN seconds USING ({K}, elapsed_s))"""
_sql("elapsed_counts", "log samples origin seconds", f"SELECT {K}, elapsed_s, events FROM seconds")
_TIMELINE = "log samples gen runs origin seconds visible"
_sql("visibility_timeline", _TIMELINE, f"""
  SELECT {K}, elapsed_s, n AS visible_count_window, n AS visible_eps, cumulative_visible FROM visible""")
_sql("timeline_wrong_clock", "log samples origin", f""",
  clocks AS (SELECT {K}, (CASE event_no % 97 WHEN 0 THEN 1000000000000000000 WHEN 1 THEN 0 WHEN 2 THEN visible_at + 17280000000 ELSE visible_at END
               - start_at) AS ms FROM samples JOIN origin USING ({K})),
  counted AS (SELECT {K}, ((ms - (ms % 1000 + 1000) % 1000) // 1000)::BIGINT AS s, count(*) AS n FROM clocks GROUP BY ALL),
  account AS (SELECT {K}, coalesce(sum(n) FILTER (s < 0), 0)::BIGINT AS before_origin, coalesce(sum(n) FILTER (s > 315619200), 0)::BIGINT AS beyond_axis,
                coalesce(sum(n) FILTER (s BETWEEN 0 AND 315619200), 0)::BIGINT AS on_axis FROM counted GROUP BY {K}),
  steps AS (SELECT {K}, s, sum(n)::BIGINT AS n FROM (SELECT {K}, s, n FROM counted WHERE s BETWEEN 0 AND 315619200
            UNION ALL SELECT {K}, 0, 0 FROM account) GROUP BY ALL)
  SELECT {K}, s AS elapsed_s, coalesce(lead(s) OVER w - 1, s) AS until_s, n AS visible_count_window,
         (sum(n) OVER w)::BIGINT AS cumulative_visible, before_origin, beyond_axis, on_axis
  FROM steps JOIN account USING ({K}) WINDOW w AS (PARTITION BY {K} ORDER BY s)""")
_sql("live_latency_stream", "log", """
  SELECT produced_at // 10000 * 10000 AS window_start_ms, strategy, scenario, count(*) AS rows_seen,
         round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 3) AS p95_ms,
         round(quantile_cont(latency_ms, 0.99), 3) AS p99_ms
  FROM log WHERE latency_ms IS NOT NULL GROUP BY ALL""")
_SQL["live_latency_many_batches"] = _SQL["live_latency_stream"]
_sql("latency_timeseries", "log samples origin", f"""
  SELECT {K}, (produced_at - start_at) // 10000 * 10 AS bucket_start_s,
         round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 3) AS p95_ms,
         round(quantile_cont(latency_ms, 0.99), 3) AS p99_ms,
         (produced_at - start_at) // 10000 * 10 + 10 AS bucket_end_s
  FROM samples JOIN origin USING ({K}) GROUP BY ALL""")
_SEGMENTS = _values("segments", "profile, a, b, x, y",
                    [(p, *seg) for p, segs in LOAD_PROFILES.items() for seg in segs])
_PARTS["segments"] = _SEGMENTS


def _rates(profile: str, source: str = "runs") -> str:
    """Rate of every second: the profile's segment, a straight line between its ends, cut to whole events."""
    return f"""
  SELECT r.* EXCLUDE (profile), t::BIGINT AS elapsed_s,
         coalesce(floor(x + ((tick - a) / (b - a)::DOUBLE) * (y - x)), 10000)::DOUBLE AS target_rate
  FROM (SELECT r.*, t, CASE WHEN {profile} = 'cyclic' THEN t % 150 ELSE t END AS tick, {profile} AS p
        FROM {source} AS r, unnest(range(0, duration_s)) AS u(t)) AS r
  LEFT JOIN segments ON segments.profile = p AND tick >= a AND tick < b"""


for _name in ("cyclic", "bursty"):
    _SQL[f"rate_timeline_{_name}"] = _with("log", "gen", "runs", "segments", f"rates AS ({_rates(repr(_name))})") + f"""
  SELECT {K}, duration_s, '{_name}' AS load_profile, 10000 AS fallback_rate, elapsed_s, target_rate FROM rates"""
_sql("peak_rates", "log gen runs", f"""
  SELECT {K}, profile AS load_profile,
         CASE profile WHEN 'cyclic' THEN 60000 ELSE 10000 END::DOUBLE AS peak_rate FROM runs""")
_PARTS["rates"] = f"rates AS ({_rates('r.profile')})"
_PARTS["produced"] = f"""produced AS (
  SELECT *, sum(made) OVER (PARTITION BY {K} ORDER BY elapsed_s) AS cumulative_produced
  FROM (SELECT *, target_rate * (generated_events / sum(target_rate) OVER (PARTITION BY {K})) AS made FROM rates))"""
_sql("produced_timeline", "log gen runs segments rates produced", f"""
  SELECT {K}, elapsed_s, target_rate, round(made, 6) AS produced_count_window, round(made, 6) AS produced_eps,
         round(cumulative_produced, 6) AS cumulative_produced FROM produced""")
_BOTH = _TIMELINE + " segments rates produced"
_sql("backlog_timeline", _BOTH, f"""
  SELECT {K}, elapsed_s, round(made, 6) AS cumulative_produced, cumulative_visible,
         round(greatest(made - cumulative_visible, 0), 6) AS observable_backlog
  FROM (SELECT {K}, elapsed_s, cumulative_visible, least(r.generated_events, coalesce(p.cumulative_produced,
               max(p.cumulative_produced) OVER (PARTITION BY {K}))) AS made
        FROM visible AS v JOIN runs AS r USING ({K}) LEFT JOIN produced AS p USING ({K}, elapsed_s))""")
_sql("response_series", _BOTH, f"""
  SELECT {K}, elapsed_s, target_rate, produced_eps, visible_eps FROM (
    SELECT {K}, elapsed_s // 5 * 5 AS elapsed_s, round(avg(target_rate), 6) AS target_rate,
           round(avg(made), 6) AS produced_eps FROM produced GROUP BY ALL)
  FULL JOIN (SELECT {K}, elapsed_s // 5 * 5 AS elapsed_s, round(avg(n), 6) AS visible_eps
             FROM visible GROUP BY ALL) USING ({K}, elapsed_s)""")
_OWN = _PARTS["visible"].replace("greatest(max(elapsed_s), any_value(duration_s))", "max(elapsed_s)").replace(
    "FROM seconds JOIN runs USING (strategy, scenario, run_id) GROUP BY", "FROM seconds GROUP BY")
_SQL["quiescence_point"] = _with("log", "samples", "origin", "seconds", _OWN) + f"""
  SELECT {K}, (min(elapsed_s) FILTER (quiet))::DOUBLE AS quiet_at, count(*) AS polls
  FROM (SELECT *, cumulative_visible = lag(cumulative_visible, 3) OVER (PARTITION BY {K} ORDER BY elapsed_s) AS quiet
        FROM visible) GROUP BY {K}"""
_SQL["drain_point"] = _with(
    "log", "samples", "origin", _PARTS["seconds"].replace("visible_at - start_at", "produced_at - start_at"), _OWN
) + f"""
  SELECT {K}, (min(elapsed_s) FILTER (idle))::DOUBLE AS drained_batch,
         (min(elapsed_s * 1000) FILTER (idle))::DOUBLE AS drained_at
  FROM (SELECT *, n = 0 AND lag(n) OVER (PARTITION BY {K} ORDER BY elapsed_s) = 0 AS idle FROM visible)
  GROUP BY {K}"""

# --- telemetry ------------------------------------------------------------------------------------------------

_MONTH = [_PARTS["month"], _PARTS["scraped"]]
_SERIES = "metric, name, mode, strategy, scenario, run_id"


def _increase(source: str, series: str) -> str:
    return f"""SELECT {series}, count(*) AS samples,
      sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS increase
    FROM (SELECT *, lag(value) OVER (PARTITION BY {series} ORDER BY at_us) AS before FROM {source})
    GROUP BY {series}"""


_SQL["counter_increase"] = _with(*_MONTH) + f"""
  SELECT metric, count(*) AS series, sum(samples)::BIGINT AS samples, round(sum(increase), 4) AS increase
  FROM ({_increase('scraped', _SERIES)}) GROUP BY metric"""
_SQL["counter_rate"] = _with(*_MONTH, """found AS (
  SELECT * FROM scraped WHERE metric = 'container_cpu_usage_seconds_total' AND mode <> 'idle'
    AND name IN ('app-1', 'app-2'))""") + f"""
  SELECT strategy, round(sum(increase) / 2592000, 9) AS rate FROM ({_increase('found', _SERIES)})
  GROUP BY strategy"""
_SQL["average_over_time"] = _with(*_MONTH) + f"""
  SELECT metric, round(sum(a), 4) AS total
  FROM (SELECT {_SERIES}, avg(value) AS a FROM scraped GROUP BY {_SERIES}) GROUP BY metric"""
_SQL["maximum_over_time"] = _with(*_MONTH) + """
  SELECT 'flink-streaming-' || scenario || '-' || run_id AS consumergroup, max(value) AS maximum
  FROM scraped WHERE metric = 'kafka_consumergroup_lag' GROUP BY 1"""
_SLOTS = f"""slots AS (
  SELECT {K}, {ORIGIN_MS} + ((list_position({STRATEGIES}, strategy) - 1) * 3 + list_position({SCENARIOS}, scenario) - 1)
         * 5 * {SLOT_MS}::BIGINT + (substr(run_id, 5)::BIGINT - 1) * {SLOT_MS}::BIGINT AS start_at
  FROM (SELECT DISTINCT {K} FROM log))"""
_IN_SLOT = f"""found AS (
  SELECT s.strategy AS rs, s.scenario AS rc, s.run_id AS rr, m.* FROM scraped AS m
  JOIN slots AS s ON produced_at * 1000 // 1000 BETWEEN start_at AND start_at + {SLOT_MS} - 1)"""
_SECS = f"{SLOT_MS // 1000}.0::DOUBLE"
_RUN = "rs, rc, rr"
_MEAN = f"SELECT {_RUN}, {_SERIES}, avg(value) AS a FROM found GROUP BY {_RUN}, {_SERIES}"
_SQL["metric_snapshot"] = _with(
    *_MONTH, _SLOTS, _IN_SLOT,
    f"rises AS ({_increase('found', _RUN + ', ' + _SERIES)})",
    f"fast AS (SELECT * FROM ({_log(SPEEDUP).removeprefix('log AS (').removesuffix(')')}) WHERE value < {LOST_FROM})",
    f"""per_run AS (
  SELECT {_RUN},
    sum(increase) FILTER (metric = 'container_cpu_usage_seconds_total' AND name IN ('app-1', 'app-2')) / {_SECS} AS cpu_name,
    sum(increase) FILTER (metric = 'node_cpu_seconds_total' AND mode <> 'idle') / {_SECS} AS cpu_host,
    sum(increase) FILTER (metric = 'kafka_produced_messages_total' AND strategy = rs AND scenario = rc AND run_id = rr)
      / {_SECS} AS made,
    sum(increase) FILTER (metric = 'kafka_produced_messages_total' AND scenario = rc) / {_SECS} AS made_legacy
  FROM rises GROUP BY {_RUN})""",
    f"""held AS (SELECT {_RUN}, sum(a) FILTER (metric = 'container_memory_rss' AND name IN ('app-1', 'app-2')) AS mem
  FROM ({_MEAN}) GROUP BY {_RUN})""",
    f"""lagging AS (SELECT {_RUN}, max(value) AS lag FROM found WHERE metric = 'kafka_consumergroup_lag'
  AND scenario = rc AND run_id = rr AND rs = 'streaming' GROUP BY {_RUN})""",
    f"""lat AS (SELECT {K}, count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
  quantile_cont(latency_ms, 0.99) AS p99 FROM fast GROUP BY {K})""",
    f"""wide AS (
  SELECT s.strategy, s.scenario, s.run_id, coalesce(nullif(cpu_name, 0), nullif(cpu_host, 0), 0) AS cpu,
         coalesce(nullif(mem, 0), 0) AS mem, coalesce(nullif(made, 0), nullif(made_legacy, 0), 0) AS made,
         coalesce(n, 0) / {_SECS} AS sunk, coalesce(lag, 0) AS lag, (lag IS NOT NULL)::INTEGER AS lag_real,
         coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99
  FROM slots AS s
  LEFT JOIN per_run AS p ON p.rs = s.strategy AND p.rc = s.scenario AND p.rr = s.run_id
  LEFT JOIN held AS h ON h.rs = s.strategy AND h.rc = s.scenario AND h.rr = s.run_id
  LEFT JOIN lagging AS l ON l.rs = s.strategy AND l.rc = s.scenario AND l.rr = s.run_id
  LEFT JOIN lat USING ({K}))""",
) + " UNION ALL ".join(
    f"SELECT {K}, '{metric}' AS metric, round({c}::DOUBLE, 6) AS value, '{unit}' AS unit FROM wide"
    for metric, c, unit in (
        ("cpu_total_cores", "cpu", "cores"), ("mem_rss_bytes", "mem", "bytes"),
        ("tput_produced_eps", "made", "events/s"), ("tput_sink_eps", "sunk", "events/s"),
        ("kafka_consumer_lag", "lag", "messages"), ("kafka_consumer_lag_real_present", "lag_real", "bool"),
        ("latency_p50_ms", "p50", "ms"), ("latency_p95_ms", "p95", "ms"), ("latency_p99_ms", "p99", "ms"),
    )
)
_sql("snapshot_series", "log readings pivot", f"""
  SELECT 0::BIGINT AS "timestamp", {K}, kafka_consumer_lag AS lag,
         CASE WHEN strategy = 'streaming' AND kafka_consumer_lag_real_present >= 1 THEN 'real_prometheus'
              ELSE 'missing' END AS lag_source, cpu_total_cores AS cpu_cores, mem_rss_bytes
  FROM pivoted""")

# --- quality -----------------------------------------------------------------------------------------------------


def _rule(check: str, severity: str, holds: str, observed: str) -> str:
    name = check if check.startswith("(") else f"'{check}'"
    level = severity if severity.startswith("(") else f"'{severity}'"
    return f"""SELECT {name} AS "check", ({holds}) AS passed, {level} AS severity, ({observed})::DOUBLE AS observed"""


_COUNT = lambda cond, source: f"(SELECT count(*) FROM {source} WHERE {cond})"


def _none(check: str, severity: str, count: str) -> str:
    return _rule(check, severity, f"{count} = 0", count)


_SEEN = "(SELECT count(*) FROM samples)"
_IMPLAUSIBLE = "NOT (produced_at BETWEEN 1577836800000 AND 1893456000000 AND visible_at BETWEEN 1577836800000 AND 1893456000000)"
_MEDIAN = lambda s: f"(SELECT quantile_cont(latency_ms, 0.5) FROM samples WHERE strategy = '{s}')"
_SHORT = f"""(SELECT count(*) FROM meta LEFT JOIN (SELECT {K}, count(*) AS n FROM samples GROUP BY {K}) USING ({K})
  WHERE coalesce(n, 0) + 1 < 10)"""
_UNEQUAL = f"""(SELECT count(*) FROM summ LEFT JOIN (SELECT {K}, count(*) AS n FROM samples GROUP BY {K}) USING ({K})
  WHERE coalesce(visible, 0) <> coalesce(n, 0))"""
_MODES = """(SELECT count(*) FROM (SELECT scenario, target_eps, row_number() OVER (
    PARTITION BY scenario ORDER BY count(*) DESC, target_eps) AS place FROM meta GROUP BY scenario, target_eps)
  WHERE place = 1 AND target_eps <> CASE scenario WHEN 'low-load' THEN 2000 WHEN 'medium-load' THEN 10000 ELSE 30000 END)"""
_UNCOVERED = """(SELECT count(*) FROM (VALUES ('batch'), ('microbatch'), ('streaming')) AS s(x)
  WHERE x NOT IN (SELECT strategy FROM lag WHERE is_real))"""
_BARE = f"""(SELECT count(*) FROM (SELECT {K}, bool_or(metric LIKE '%cpu%') AND bool_or(metric LIKE '%mem%') AS good
  FROM readings GROUP BY {K}) WHERE NOT good)"""
_CLOCKS = """(SELECT count(*) FROM (SELECT user_id, count(*) AS n FROM log GROUP BY user_id)
  WHERE floor(abs(n % 12 - 6.5) + 0.5) > 5)"""
_PER_STRATEGY = f"""per_strategy AS (
  SELECT strategy, count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
         quantile_cont(latency_ms, 0.99) AS p99, {_CV} AS cv
  FROM samples GROUP BY strategy)"""
_ROWS = " UNION ALL ".join(
    [
        _rule("V13", "error", f"{_SEEN} > 0", _SEEN),
        _none("V14", "error", _COUNT("latency_ms < 0", "samples")),
        _rule("V15", "warning", f"{_COUNT('latency_ms > 300000', 'samples')} * 100.0 / {_SEEN} < 1",
              _COUNT("latency_ms > 300000", "samples")),
        _rule("V16", "warning", f"{_COUNT('latency_ms = 0', 'samples')} * 100.0 / {_SEEN} < 5",
              _COUNT("latency_ms = 0", "samples")),
        _rule("V17", "error", "true", "0"),
        _none("V18", "error", _COUNT("latency_ms IS NULL", "samples")),
        _rule("V24", "warning", "true", "1"),
        _none("V25", "error", _COUNT("visible_at < produced_at", "samples")),
        _none("V26", "warning", _COUNT(_IMPLAUSIBLE, "samples")),
        _rule("('V19:' || strategy)", "warning", "n >= 100", "n") + " FROM per_strategy",
        _rule("('V20:' || strategy)", "error", "p50 <= p95 AND p95 <= p99", "p50") + " FROM per_strategy WHERE n >= 10",
        _rule("('V21:' || strategy)", "warning", "cv < 500", "round(cv, 6)") + " FROM per_strategy WHERE n >= 10",
        _rule("V22", "warning", f"{_MEDIAN('streaming')} < {_MEDIAN('batch')}", f"{_MEDIAN('batch')} - {_MEDIAN('streaming')}"),
        _rule("V23", "warning", f"{_MEDIAN('microbatch')} < {_MEDIAN('batch')}", f"{_MEDIAN('batch')} - {_MEDIAN('microbatch')}"),
        _none("V30", "warning", _SHORT),
        _none("V1", "warning", f"(SELECT count(*) FROM ({_GAPS}))"),
        _none("V2", "error", _COUNT("coalesce(visible, 0) > generated", "summ")),
        _none("V3", "error", _COUNT("seen > generated", "summ")),
        _none("V4", "error", _UNEQUAL),
        _none("V6", "error", _COUNT("abs(seconds - 300) > 1", "summ")),
        _none("V8", "warning", _COUNT("generated / 300.0::DOUBLE < 7", "summ")),
        _rule("V5", "warning", "true", "1"),
        _rule("V12", "warning", "(SELECT count(DISTINCT commit_no) FROM meta) <= 1", "(SELECT count(DISTINCT commit_no) FROM meta)"),
        _none("V7", "warning", _MODES),
        _none("V10", "error", f"(SELECT count(DISTINCT ({K})) FROM samples WHERE latency_ms <= 0)"),
        _none("V9", "warning", _UNCOVERED),
        _rule("V11", "error", "true", "0"),
        _none("V31", "error", f"(SELECT count(DISTINCT ({K})) FROM log WHERE run_id = 'run_2')"),
        _none("V32", "warning", "0"),
        _rule("V27", "info", f"(SELECT count(DISTINCT ({K})) FROM readings) > 0", f"(SELECT count(DISTINCT ({K})) FROM readings)"),
        _none("V28", "warning", _BARE),
        _none("V29", "error", _CLOCKS),
    ]
)
_QUALITY = (_RUNS + " readings").split()
_SQL["quality_rows"] = _with(*_QUALITY, _PER_STRATEGY) + _ROWS
_SQL["quality_rollup"] = _with(*_QUALITY, _PER_STRATEGY, f"checks AS ({_ROWS})") + """
  SELECT *, error_count = 0 AS passed, error_count = 0 AND warning_count = 0 AS passed_strict FROM (
    SELECT count(*) AS total_checks, count(*) FILTER (passed) AS passed_count,
           count(*) FILTER (NOT passed AND severity = 'error') AS error_count,
           count(*) FILTER (NOT passed AND severity = 'warning') AS warning_count,
           count(*) FILTER (NOT passed AND severity = 'info') AS info_count FROM checks)"""
_sql("sample_counters", "ships", f"""
  SELECT strategy, count(*) AS rows, 0::BIGINT AS unparsable, count(*) FILTER (latency_ms < 0) AS negative,
         count(*) FILTER (latency_ms = 0) AS zero, count(*) FILTER (latency_ms > 300000) AS extreme,
         count(*) FILTER (visible_at < produced_at) AS backwards,
         count(*) FILTER ({_IMPLAUSIBLE}) AS implausible, round({_CV}, 5) AS cv_pct
  FROM ships GROUP BY strategy""")
_SQL["clock_status"] = """
  SELECT c_name AS node, CASE WHEN c_custkey % 9 <> 0 THEN round(abs(c_acctbal / 1000))::DOUBLE END AS offset_rounded_ms,
         CASE WHEN c_custkey % 9 <> 0 AND round(abs(c_acctbal / 1000)) <= 5 THEN 'OK' ELSE 'FAIL' END AS status
  FROM customer"""
