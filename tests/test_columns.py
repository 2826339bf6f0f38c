import math

import pytest
from pyspark.sql import functions as F

from pulse.functions import columns as col
from pulse.sources.sink_scan import latency_samples, next_page, run_samples
from pulse.schemas import SCENARIOS


def value(frame, expression, x=None, kind="STRING"):
    return frame([(x,)], f"x {kind}").select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, expected",
    [("1.5", 1.5), ("abc", None), ("", None), (None, None), ("NaN", None), ("-3", -3.0), (" 7 ", 7.0)],
)
def test_lenient_double(frame, text, expected):
    assert value(frame, col.lenient_double("x"), text) == expected
    assert value(frame, col.is_unparsable("x"), text) == (expected is None)


def test_guarded_ratios(frame):
    for d, null, zero in ((0, None, 0.0), (-1, None, 0.0), (4, 0.5, 0.5), (None, None, 0.0)):
        assert value(frame, col.ratio_or_null(F.lit(2), "x"), d, "INT") == null
        assert value(frame, col.ratio_or_zero(F.lit(2), "x"), d, "INT") == zero


def test_clamps_keep_null(frame):
    assert value(frame, col.at_least("x", 0), None, "DOUBLE") is None
    assert value(frame, col.at_least("x", 0), -2.0, "DOUBLE") == 0
    assert value(frame, col.at_most("x", F.lit(5.0)), 7.0, "DOUBLE") == 5
    assert value(frame, col.at_most("x", F.lit(None).cast("double")), 7.0, "DOUBLE") == 7


def test_names(frame):
    assert value(frame, col.safe_name("x"), "Run 1/É") == "run_1__"
    assert value(frame, col.run_topic("x", F.lit("low-load"), F.lit("Run 1"), F.lit(9)), "Batch") == (
        "events_batch_low-load_run_1_9"
    )


def test_iso_text_ignores_the_session_zone(spark, frame):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
        assert value(frame, col.iso_utc("x"), 1704067200, "LONG") == "2024-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_elapsed_and_buckets(frame):
    seconds = [value(frame, col.elapsed_s("x", F.lit(1000)), t, "LONG") for t in (1000, 1999, 10000, 11000, 999)]
    assert seconds == [0, 0, 9, 10, -1]
    assert [value(frame, col.bucket("x", 10), s, "LONG") for s in (0, 9, 10)] == [0, 0, 10]


def test_preferred_order(frame):
    names = frame([(n,) for n in ("high-load", "zeta", "low-load", "alpha")], "x STRING")
    ordered = names.orderBy(col.preferred_rank("x", SCENARIOS), "x").collect()
    assert [r["x"] for r in ordered] == ["low-load", "high-load", "alpha", "zeta"]


def test_labels_and_sizes(frame):
    assert value(frame, col.label_or("x", "unknown"), "  ") == "unknown"
    assert value(frame, col.label_or("x", "unknown"), None) == "unknown"
    assert value(frame, col.label_or("x", "unknown"), " a ") == "a"
    assert value(frame, col.display_label("x", {"a": "A"}), "b") == "b"
    assert value(frame, col.display_label("x", {"a": "A"}), "a") == "A"
    assert value(frame, col.payload_bytes("x"), 10, "INT") == 1500
    assert value(frame, col.is_plausible_ms("x"), 1577836800000, "LONG") is True
    assert value(frame, col.is_plausible_ms("x"), 1577836799999, "LONG") is False
    assert value(frame, col.is_advanced("x"), "cyclic-load") is True
    assert value(frame, col.is_advanced("x"), None) is False
    assert math.isclose(value(frame, col.bytes_to_mib("x"), 1048576.0, "DOUBLE"), 1)


SINK = "event_id STRING, produced_at LONG, visible_at LONG, strategy STRING, scenario STRING, run_id STRING"


def test_page_after_cursor(frame, rows):
    sink = frame(
        [(i, 0, t, "batch", "low-load", "run_1") for i, t in (("a", 100), ("c", 100), ("a2", 101), ("z", 99))], SINK
    )
    page = next_page(sink, ("batch", "low-load", "run_1"), (100, "b"), rows=5000)
    assert [(r["visible_at"], r["event_id"]) for r in page.collect()] == [(100, "c"), (101, "a2")]
    assert [r["event_id"] for r in next_page(sink, None, (0, ""), rows=2).collect()] == ["z", "a"]


def test_pages_cover_the_sink(frame):
    sink = frame([(f"{i:03d}", 0, i // 7, "s", "c", "r") for i in range(50)], SINK)
    cursor, seen = (-1, ""), []
    while page := next_page(sink, None, cursor, rows=8).collect():
        seen += [r["event_id"] for r in page]
        cursor = (page[-1]["visible_at"], page[-1]["event_id"])
    assert seen == [f"{i:03d}" for i in range(50)]


def test_samples_default_labels_and_match_whole_run_names(frame, rows):
    sink = frame([("a", 5, 9, None, "c", "run_1"), ("b", 5, 3, "s", " ", "run_10")], SINK)
    samples = latency_samples(sink)
    assert rows(samples, "event_id", "strategy", "scenario", "latency_ms") == [
        ("a", "unknown", "c", 4.0), ("b", "s", "unknown", -2.0),
    ]
    assert rows(run_samples(samples, "unknown", "c", "run_1"), "event_id") == [("a",)]
    assert run_samples(samples, "s", "unknown", "run_1").count() == 0
