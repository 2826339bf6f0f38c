import pytest

from pulse.operators import timeline
from pulse.schemas import KEY

RUN = "strategy STRING, scenario STRING, run_id STRING"
R = ("s", "c", "r")


def by_second(df, name):
    return {r["elapsed_s"]: r[name] for r in df.collect()}


@pytest.mark.parametrize(
    "profile, rates",
    [
        ("bursty", {90: 6000, 195: 5500, 300: 77, 0: 2000, 299: 5000, 203: 3099}),
        ("cyclic", {160: 5000, 125: 60000, 149: 5000, 150: 5000, 195: 15000}),
        ("constant", {0: 77, 200: 77}),
    ],
)
def test_target_rates(frame, profile, rates):
    runs = frame([(*R, 301, profile, 77)], RUN + ", duration_s INT, load_profile STRING, fallback_rate INT")
    got = by_second(timeline.rate_timeline(runs), "target_rate")
    assert len(got) == 301
    assert {t: got[t] for t in rates} == rates


def test_peaks(frame):
    runs = frame([(*R, p, 77) for p in ("bursty", "cyclic", "constant")], RUN + ", load_profile STRING, fallback_rate INT")
    got = {r["load_profile"]: r["peak_rate"] for r in timeline.peak_rates(runs).collect()}
    assert got == {"bursty": 10000, "cyclic": 60000, "constant": 77}


def test_produced_adds_up_to_the_generated_events(frame):
    runs = frame([(*R, 300, 1234, "bursty", 1)], RUN + ", duration_s INT, generated_events LONG, load_profile STRING, fallback_rate INT")
    got = timeline.produced_timeline(runs).orderBy("elapsed_s").collect()
    assert got[-1]["cumulative_produced"] == pytest.approx(1234)
    assert got[0]["produced_eps"] / got[150]["produced_eps"] == pytest.approx(0.2)


SAMPLES = RUN + ", produced_at LONG, visible_at LONG, latency_ms LONG"


def samples(frame, *times):
    return frame([(*R, p, v, v - p) for p, v in times], SAMPLES)


def test_visibility_has_every_second(frame):
    df = samples(frame, (1000, 1500), (1200, 1999), (1300, 4000))
    got = timeline.visibility_timeline(df).orderBy("elapsed_s").collect()
    assert [(r["elapsed_s"], r["visible_count_window"], r["cumulative_visible"]) for r in got] == [
        (0, 2, 2), (1, 0, 2), (2, 0, 2), (3, 1, 3),
    ]
    runs = frame([(*R, 6)], RUN + ", duration_s INT")
    assert timeline.visibility_timeline(df, runs).count() == 7


def test_long_axis_is_whole(frame):
    df = samples(frame, (0, 0), (0, 3 * 3600 * 1000 + 500))
    got = by_second(timeline.visibility_timeline(df), "cumulative_visible")
    assert sorted(got) == list(range(3 * 3600 + 1)) and got[3 * 3600 - 1] == 1 and got[3 * 3600] == 2


def test_latency_by_bucket_of_production_time(frame):
    df = samples(frame, (5000, 5010), (14999, 15030), (15000, 15100))
    got = {r["bucket_start_s"]: (r["p50_ms"], r["bucket_end_s"]) for r in timeline.latency_timeseries(df).collect()}
    assert got == {0: (20.5, 10), 10: (100.0, 20)}


def test_backlog_carries_the_produced_total_on(frame):
    visible = frame([(*R, t, n) for t, n in ((0, 0), (1, 4), (2, 10))], RUN + ", elapsed_s LONG, cumulative_visible LONG")
    produced = frame([(*R, 0, 5.0), (*R, 1, 10.0)], RUN + ", elapsed_s LONG, cumulative_produced DOUBLE")
    runs = frame([(*R, 10)], RUN + ", generated_events LONG")
    got = by_second(timeline.backlog_timeline(visible, produced, runs), "observable_backlog")
    assert got == {0: 5.0, 1: 6.0, 2: 0.0}


def test_backlog_is_never_negative_nor_above_the_total(frame):
    visible = frame([(*R, 0, 3), (*R, 1, 3)], RUN + ", elapsed_s LONG, cumulative_visible LONG")
    produced = frame([(*R, 1, 99.0)], RUN + ", elapsed_s LONG, cumulative_produced DOUBLE")
    runs = frame([(*R, 10)], RUN + ", generated_events LONG")
    got = by_second(timeline.backlog_timeline(visible, produced, runs), "observable_backlog")
    assert got == {0: 0.0, 1: 7.0}


def test_window_means(frame):
    df = frame([(*R, t, float(t)) for t in range(7)], RUN + ", elapsed_s LONG, x DOUBLE")
    assert by_second(timeline.window_means(df, ["x"]), "x") == {0: 2.0, 5: 5.5}


def polls(frame, counts):
    return frame([(*R, 2 * i, n) for i, n in enumerate(counts)], RUN + ", t LONG, visible_events LONG")


@pytest.mark.parametrize(
    "counts, n, quiet",
    [([0, 5, 9, 9, 9, 9], 3, 10), ([0, 5, 9, 9, 9], 3, None), ([1, 1, 2, 2, 2], 2, 8), ([4, 4, 4, 4], 3, 6), ([7], 1, None)],
)
def test_quiescence(frame, counts, n, quiet):
    assert timeline.quiescence(polls(frame, counts), n).first()["quiet_at"] == quiet


def test_drain_counts_a_repeated_batch_once(frame):
    rows = [(0, 10), (1, 0), (1, 0), (1, 0), (2, 0), (3, 4), (4, 0), (5, 0), (6, 0)]
    df = frame([(*R, b, n, 100 * i) for i, (b, n) in enumerate(rows)], RUN + ", batch_id LONG, num_input_rows LONG, ts LONG")
    assert timeline.drain_point(df, 3).first()["drained_batch"] == 6
    assert timeline.drain_point(df, 2).first()["drained_batch"] == 2
    assert timeline.drain_point(df, 4).first()["drained_batch"] is None


def test_profile_runs_and_their_series(frame):
    generators = frame(
        [("s", "cyclic-load", "r", 2.4, 30, "cyclic"), ("s", "cyclic-load", "q", 0.0, 8, None), ("s", "low-load", "r", 5.0, 1, None)],
        RUN + ", generation_duration_seconds DOUBLE, generated_events LONG, load_profile STRING",
    )
    metadata = frame([("s", "cyclic-load", "q", 4.0, 7)], RUN + ", official_duration_seconds DOUBLE, target_eps LONG")
    runs = timeline.profile_runs(generators, metadata, advanced_only=True)
    got = {r["run_id"]: (r["duration_s"], r["fallback_rate"]) for r in runs.collect()}
    assert got == {"r": (2, 0), "q": (4, 7)}
    seen = frame([("s", "cyclic-load", "r", 0, 1500, 1500), ("s", "low-load", "r", 0, 10, 10)], SAMPLES)
    series = timeline.run_timelines(seen, runs)
    assert by_second(series["produced"].where("run_id = 'r'"), "produced_eps") == {0: 15.0, 1: 15.0}
    assert by_second(series["visible"], "cumulative_visible") == {0: 0, 1: 1, 2: 1}
    assert by_second(series["backlog"], "observable_backlog") == {0: 15.0, 1: 29.0, 2: 29.0}
    assert series["latency"].first()["p50_ms"] == 1500.0
