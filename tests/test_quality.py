import pytest

from pulse.plans import quality
from pulse.schemas import REQUIRED_ARTIFACTS, STRATEGIES

RUN = "strategy STRING, scenario STRING, run_id STRING"
R = ("batch", "low-load", "run_1")
T0 = 1704067200000


def results(df):
    assert df.columns == quality.COLUMNS
    return {r["check"]: (r["passed"], r["severity"], r["observed"]) for r in df.collect()}


def samples(frame, *latencies, strategy="batch", produced=T0):
    ddl = RUN + ", produced_at STRING, visible_at STRING, latency_ms STRING"
    rows = []
    for x in latencies:
        seen = str(produced + int(x)) if x not in (None, "bad") else None
        rows.append((strategy, "low-load", "run_1", str(produced), seen, None if x is None else str(x)))
    return frame(rows, ddl)


def test_counters(frame):
    row = quality.sample_counters(samples(frame, -5, 0, 7, "bad", 300001)).first()
    got = {n: row[n] for n in ("rows", "unparsable", "negative", "zero", "extreme", "backwards", "implausible")}
    assert got == {"rows": 4, "unparsable": 1, "negative": 1, "zero": 1, "extreme": 1, "backwards": 1, "implausible": 0}


def test_sample_rules(frame):
    got = results(quality.sample_checks(samples(frame, -5, 0, 7, None, 300001)))
    assert got["V13"] == (True, "error", 4.0)
    assert got["V14"] == (False, "error", 1.0)
    assert got["V15"] == (False, "warning", 1.0)
    assert got["V16"] == (False, "warning", 1.0)
    assert got["V17"][0] and got["V24"][0]
    assert got["V18"] == (False, "error", 1.0)
    assert got["V25"] == (False, "error", 1.0)
    assert got["V26"] == (True, "warning", 0.0)


def test_shares_are_below_their_bounds(frame):
    fine = [10] * 199 + [300001]
    assert results(quality.sample_checks(samples(frame, *fine)))["V15"][0] is True
    edge = [10] * 99 + [300001]
    assert results(quality.sample_checks(samples(frame, *edge)))["V15"][0] is False
    zeros = [10] * 95 + [0] * 5
    assert results(quality.sample_checks(samples(frame, *zeros)))["V16"][0] is False


def test_no_samples(frame):
    assert results(quality.sample_checks(samples(frame))) == {"V13": (False, "error", 0.0)}
    assert results(quality.strategy_checks(samples(frame))) == {}
    assert results(quality.expectation_checks(samples(frame))) == {}


def test_missing_columns(frame):
    got = results(quality.sample_checks(samples(frame, 5).drop("produced_at", "scenario")))
    assert got["V17"] == (False, "error", 1.0)
    assert got["V24"] == (False, "warning", 0.0)
    assert "V25" not in got


def test_times_out_of_range(frame):
    early = samples(frame, 5, 6, produced=1577836800000 - 1000)
    assert results(quality.sample_checks(early))["V26"] == (False, "warning", 2.0)


def test_strategy_rules(frame):
    df = samples(frame, *range(1, 101)).union(samples(frame, *([1] * 99 + [100000]), strategy="streaming"))
    df = df.union(samples(frame, 1, 2, strategy="few"))
    got = results(quality.strategy_checks(df))
    assert got["V19:batch"] == (True, "warning", 100.0) and got["V19:few"] == (False, "warning", 2.0)
    assert got["V20:batch"][0] and got["V21:batch"][0]
    assert got["V21:streaming"][0] is False
    assert "V20:few" not in got and "V21:few" not in got


def test_expectations(frame):
    df = samples(frame, 100).union(samples(frame, 5, strategy="streaming"))
    got = results(quality.expectation_checks(df))
    assert got == {"V22": (True, "warning", 95.0)}
    df = df.union(samples(frame, 100, strategy="microbatch"))
    assert results(quality.expectation_checks(df))["V23"] == (False, "warning", 0.0)


def test_lines_per_run(frame):
    runs = frame([R], RUN)
    assert results(quality.sample_count_checks(samples(frame, *range(9)), runs))["V30"][0] is True
    assert results(quality.sample_count_checks(samples(frame, *range(8)), runs))["V30"][0] is False
    assert results(quality.sample_count_checks(samples(frame), runs))["V30"] == (False, "warning", 1.0)


def test_artifacts_and_generators(frame):
    runs = frame([R, R], RUN)
    files = frame([(*R, a) for a in REQUIRED_ARTIFACTS], RUN + ", artifact STRING")
    assert results(quality.artifact_checks(runs, files))["V1"] == (True, "warning", 0.0)
    assert results(quality.artifact_checks(runs, files.where("artifact LIKE '%.csv'")))["V1"] == (False, "warning", 3.0)
    assert results(quality.generator_checks(runs, runs))["V31"][0] is True
    assert results(quality.generator_checks(runs, runs.limit(0)))["V31"] == (False, "error", 1.0)


SUMMARY = (
    RUN + ", generated_events LONG, visible_events LONG, delivery_ratio_pct DOUBLE, generation_duration_seconds DOUBLE,"
    " official_duration_seconds DOUBLE, target_eps LONG, generated_eps_real DOUBLE"
)


@pytest.mark.parametrize(
    "row, failed",
    [
        ((10, 10, 100.0, 300.9, 300.0, 10, 7.0), set()),
        ((10, 11, 110.0, 300.0, 300.0, 10, 9.0), {"V2", "V3", "V4"}),
        ((None, None, None, None, None, None, None), {"V4"}),
        ((10, 10, -1.0, 298.5, 300.0, 10, 6.9), {"V3", "V6", "V8"}),
        ((20, 10, 50.0, 300.0, 300.0, 0, 0.0), set()),
    ],
)
def test_summary_rules(frame, row, failed):
    stats = frame([(*R, 10)], RUN + ", latency_rows LONG")
    got = results(quality.summary_checks(frame([(*R, *row)], SUMMARY), stats))
    assert {c for c, r in got.items() if not r[0]} == failed
    assert "V4" not in results(quality.summary_checks(frame([(*R, *row)], SUMMARY)))


META = RUN + ", official_duration_seconds DOUBLE, git_commit STRING, target_eps LONG"


@pytest.mark.parametrize(
    "durations, want", [([300.0], (True, "warning")), ([200.0], (False, "warning")), ([300.0, 200.0], (False, "error"))]
)
def test_durations(frame, durations, want):
    df = frame([(*R, d, "abc", 2000) for d in durations], META)
    assert results(quality.metadata_checks(df))["V5"][:2] == want


def test_commits_and_targets(frame):
    rows = [(*R, 300.0, "a", 2000), (*R, 300.0, "b", 2000), (*R, 300.0, None, 1500)]
    got = results(quality.metadata_checks(frame(rows, META)))
    assert got["V12"] == (False, "warning", 2.0) and got["V7"] == (True, "warning", 0.0)
    wrong = frame([("batch", "high-load", "r", 300.0, "a", 3), ("batch", "other", "r", 300.0, "a", 3)], META)
    assert results(quality.metadata_checks(wrong))["V7"] == (False, "warning", 1.0)
    assert set(results(quality.metadata_checks(wrong.limit(0)))) == {"V7"}


def test_lag_signs_run_ids_scope(frame):
    lag = frame([(s, "real_prometheus") for s in STRATEGIES[:2]], "strategy STRING, lag_source STRING")
    assert results(quality.lag_checks(lag))["V9"] == (False, "warning", 1.0)
    stats = frame([(*R, 0), (*R, 3)], RUN + ", latency_non_positive_count LONG")
    assert results(quality.latency_sign_checks(stats))["V10"] == (False, "error", 1.0)
    runs = frame([R, ("batch", "cyclic", "r")], RUN)
    assert results(quality.run_id_checks({"a": runs, "b": runs.limit(0)}))["V11"] == (False, "error", 1.0)
    assert results(quality.run_id_checks({"a": runs, "b": runs.drop("run_id")}))["V11"][0] is False
    assert results(quality.run_id_checks({"a": runs}))["V11"][0] is True
    assert results(quality.scope_checks(runs))["V32"] == (False, "warning", 1.0)
    assert results(quality.scope_checks(runs, "all"))["V32"][0] is True


def test_snapshots(frame):
    ddl = RUN + ", metric STRING"
    df = frame([(*R, "CPU_total"), (*R, "mem_rss"), ("batch", "low-load", "run_2", "cpu")], ddl)
    got = results(quality.snapshot_checks(df))
    assert got["V27"] == (True, "info", 2.0) and got["V28"] == (False, "warning", 1.0)
    assert results(quality.snapshot_checks(df.limit(0))) == {"V27": (False, "info", 0.0)}


def test_clocks(frame, rows):
    offsets = frame([("a", "5.4"), ("b", "-5.5"), ("c", "N/A")], "node STRING, offset_ms STRING")
    assert [r["status"] for r in quality.clock_status(offsets).orderBy("node").collect()] == ["OK", "FAIL", "FAIL"]
    assert results(quality.clock_checks(offsets))["V29"] == (False, "error", 2.0)
    assert results(quality.clock_checks(offsets.limit(1)))["V29"][0] is True


def test_rollup(frame):
    rows = frame(
        [("a", True, "error", "", 0.0), ("b", False, "warning", "", 1.0), ("c", False, "info", "", 1.0)],
        "check STRING, passed BOOLEAN, severity STRING, message STRING, observed DOUBLE",
    )
    got = quality.quality_rollup(rows).first().asDict()
    assert got == {
        "total_checks": 3, "passed_count": 1, "error_count": 0, "warning_count": 1, "info_count": 1,
        "passed": True, "passed_strict": False,
    }
