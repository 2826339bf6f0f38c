import random
import re

import pytest
from pyspark.sql import functions as F

from pulse.operators import scan, timeline
from pulse.schemas import KEY

RUN = ("s", "c", "r")
SAMPLE = "event_id STRING, strategy STRING, scenario STRING, run_id STRING, produced_at LONG, visible_at LONG"


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_running_sums_and_fills_over_blocks(frame, width):
    rng = random.Random(width)
    rows = [(g, at, rng.randrange(100), rng.choice([None, None, at * 10])) for g in ("a", "b", None) for at in sorted(rng.sample(range(-20, 60), 30))]
    df = frame(rows, "g STRING, at LONG, n LONG, v LONG").fillna({"g": "none"}).repartition(5)
    got = scan.running(df, ["g"], "at", width, sums={"total": "n"}, fills={"v": "v"})
    assert set(got.columns) == {"g", "at", "n", "total", "v"}
    want, total, last = {}, {}, {}
    for g, at, n, v in sorted(rows, key=lambda r: r[1]):
        g = g or "none"
        total[g] = total.get(g, 0) + n
        last[g] = v if v is not None else last.get(g)
        want[g, at] = (total[g], last[g])
    assert {(r["g"], r["at"]): (r["total"], r["v"]) for r in got.collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_takes_a_run_second_by_second(frame):
    runs = frame([(*RUN, 5, 10, "constant", 2)], "strategy STRING, scenario STRING, run_id STRING, duration_s INT, generated_events LONG, load_profile STRING, fallback_rate INT")
    samples = frame([("e", *RUN, 0, 1500)], SAMPLE)
    produced, visible = timeline.produced_timeline(runs), timeline.visibility_timeline(samples, runs)
    for df in (produced, visible, timeline.backlog_timeline(visible, produced, runs)):
        windows = [line for line in plan(df).split("\n") if re.search(r"\bWindow \[", line)]
        by_second = [line for line in windows if re.search(r"\], \[elapsed_s", line)]
        assert by_second and all("_block" in re.search(r"\], \[(strategy[^\]]*)\], \[elapsed_s", line)[1] for line in by_second)


def test_times_beyond_reason_are_counted_apart(frame, rows):
    seen = [(f"e{k}", *RUN, 1_700_000_000_000, 1_700_000_000_000 + ms) for k, ms in enumerate((0, 500, 3_000, 4_000_000, -1, 10**18 - 1_700_000_000_000))]
    # A produced time of 0 does not move the origin either.
    seen.append(("old", *RUN, 0, None))
    samples = frame(seen, SAMPLE)
    counts = timeline.elapsed_counts(samples)
    assert rows(timeline.off_axis(counts), "before_origin", "beyond_axis", "on_axis") == [(1, 1, 4)]
    assert rows(timeline.visible_intervals(counts), "elapsed_s", "until_s", "visible_count_window", "cumulative_visible") == [
        (0, 2, 2, 2), (3, 3999, 1, 3), (4000, 4000, 1, 4)
    ]
    assert timeline.visibility_timeline(samples).count() == 4001


def test_a_gap_of_months_is_one_interval(frame):
    far = 200 * 86_400
    samples = frame([("a", *RUN, 0, 0), ("b", *RUN, 0, far * 1000), ("c", *RUN, 0, far * 1000 + 7_200_000)], SAMPLE)
    got = {r["elapsed_s"]: r["until_s"] for r in timeline.visible_intervals(timeline.elapsed_counts(samples)).collect()}
    assert got == {0: far - 1, far: far + 7199, far + 7200: far + 7200}
    dense = timeline.visibility_timeline(samples)
    assert dense.agg(F.count("*"), F.sum("visible_count_window"), F.max("cumulative_visible")).first() == (far + 7201, 3, 3)


def test_a_run_seen_off_its_axis_alone_keeps_its_origin(frame, rows):
    samples = frame([("a", *RUN, 1000, 0)], SAMPLE)
    assert rows(timeline.visibility_timeline(samples), *KEY, "elapsed_s", "cumulative_visible") == [(*RUN, 0, 0)]
    none = samples.where("false")
    assert timeline.visibility_timeline(none).collect() == [] and timeline.off_axis(timeline.elapsed_counts(none)).collect() == []
