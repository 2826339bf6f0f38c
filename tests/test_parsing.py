import json

from pulse.functions import parsing

ID = "00000000-0000-0000-0000-00000000000"
LOG = "value BINARY, partition INT, offset LONG"


def record(n, **changes):
    event = {
        "event_id": f"{ID}{n}", "produced_at": 12, "payload": "p", "strategy": "batch",
        "scenario": "low-load", "run_id": "run_1",
    }
    event |= changes
    return json.dumps({k: v for k, v in event.items() if v is not ...}).encode()


def test_accepts_and_rejects_with_reasons(frame, rows):
    texts = [
        record(0), b"not json", b"[]", None, record(1, run_id=...), record(2, event_id="1-1-1-1-1"),
        record(3, produced_at="12"), record(4, payload=None), record(5, event_id=f"{ID.upper()}A", extra=[1]),
    ]
    parsed = parsing.parse_events(frame([(t, 0, i) for i, t in enumerate(texts)], LOG))
    good = parsing.accepted(parsed)
    assert rows(good, "offset", "payload") == [(0, "p"), (7, ""), (8, "p")]
    assert rows(good, "event_id")[2][0] == f"{ID}a"
    bad = {r["offset"]: r["reject_reasons"] for r in parsing.rejected(parsed).collect()}
    assert bad == {
        1: ["malformed_json"], 2: ["malformed_json"], 3: ["null_value"], 4: ["missing_run_id"],
        5: ["invalid_event_id"], 6: ["malformed_json"],
    }
    assert rows(parsing.reject_counts(parsed)) == [
        ("accepted", 3), ("invalid_event_id", 1), ("malformed_json", 3), ("missing_run_id", 1), ("null_value", 1),
    ]


def test_every_missing_field_is_named(frame):
    empty = parsing.parse_events(frame([(b"{}", 0, 0)], LOG)).first()
    assert empty["reject_reasons"] == [
        "missing_event_id", "missing_produced_at", "missing_strategy", "missing_scenario", "missing_run_id",
    ]
    assert empty["accepted"] is False


def test_accept_rule_and_reasons_agree(frame):
    texts = [record(0), b"", b"null", b"{", b"5", b'"x"', record(1, strategy=None), record(2, produced_at=1.5)]
    parsed = parsing.parse_events(frame([(t, 0, i) for i, t in enumerate(texts)], LOG))
    for row in parsed.collect():
        assert row["accepted"] == (row["reject_reasons"] == []), row


def test_empty_log_keeps_its_schema(frame):
    parsed = parsing.parse_events(frame([], LOG))
    assert parsing.accepted(parsed).columns == [
        "partition", "offset", "event_id", "produced_at", "payload", "strategy", "scenario", "run_id",
    ]
    assert parsed.count() == 0


def test_json_is_parsed_once(frame):
    parsed = parsing.accepted(parsing.parse_events(frame([(record(0), 0, 0)], LOG)))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_domain_fields_by_kind(frame, rows):
    texts = [
        record(0, schema="iot_sensor", temperature_c=61.0, humidity_pct=50.0, price=3.0),
        record(1, schema="financial_tick", symbol="AAPL", price=10.0, bid=11.0, ask=12.0),
        record(2, schema="health_monitor", heart_rate_bpm=44, alert=False, steps_delta=3),
        record(3, schema="health_monitor", heart_rate_bpm=151, alert=True, steps_delta=21),
        record(4, schema="mystery", temperature_c=5.0),
    ]
    parsed = parsing.parse_domain(frame([(t,) for t in texts], "value BINARY"))
    iot = parsing.domain_view(parsed, "iot_sensor")
    assert rows(iot, "event_id", "temperature_c") == [(f"{ID}0", 61.0), (f"{ID}4", 5.0)]
    assert "price" not in iot.columns
    report = {(r["schema"], r["rule"]): r["violations"] for r in parsing.domain_report(parsed).collect()}
    assert report["iot_sensor", "temperature_range"] == 1
    assert report["iot_sensor", "price_range"] == 0
    assert report["financial_tick", "quote_disorder"] == 1
    assert report["health_monitor", "alert_mismatch"] == 1
    assert report["health_monitor", "steps_range"] == 1
