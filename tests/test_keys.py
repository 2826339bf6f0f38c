import random

import pytest
from pyspark.sql import functions as F

from pulse.operators import keys, matrix
from pulse.schemas import KEY

ROW = "event_id STRING, partition INT, offset LONG, payload STRING"
RUN = "strategy STRING, scenario STRING, run_id STRING"


def test_first_offset_wins_in_any_input_order(frame, rows):
    copies = [("a", 1, 7, "late"), ("a", 1, 3, "early"), ("b", 0, 1, "b"), ("a", 1, 9, "later")]
    for seed in range(3):
        random.Random(seed).shuffle(copies)
        assert rows(keys.first_wins(frame(copies, ROW)), "event_id", "payload") == [("a", "early"), ("b", "b")]


def test_hot_key_is_reduced_before_the_shuffle(frame):
    plan = keys.first_wins(frame([("a", 0, 0, "x")], ROW))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


@pytest.mark.parametrize("small", [False, True])
def test_insert_if_absent(frame, rows, small):
    batch = frame([("a", 1), ("b", 2), ("c", 3)], "event_id STRING, v INT")
    stored = frame([("b",), ("b",), ("z",)], "event_id STRING")
    assert rows(keys.insert_if_absent(batch, stored, small_batch=small)) == [("a", 1), ("c", 3)]
    assert keys.insert_if_absent(batch, stored.limit(0), small_batch=small).count() == 3


def test_salted_join_equals_plain_join(frame, rows):
    random.seed(5)
    # One run holds most of the rows, many of them alike.
    many = frame(
        [("s", "c", random.choice(["hot"] * 8 + ["r1", "r2", "none"]), random.randint(0, 3)) for _ in range(400)],
        RUN + ", v INT",
    )
    runs = frame([("s", "c", r, i) for i, r in enumerate(("hot", "r1", "r2", "unused"))], RUN + ", w INT")
    for how in ("inner", "left"):
        plain = rows(many.join(runs, KEY, how).fillna(-1), *KEY, "v", "w")
        assert rows(keys.attach_per_run(many, runs, how=how, salts=8).fillna(-1), *KEY, "v", "w") == plain


def test_bounded_sample_is_the_lowest_hashes(frame, rows):
    import hashlib

    ids = [(("s", "c", "big"), f"e{i}") for i in range(500)] + [(("s", "c", "tiny"), f"t{i}") for i in range(3)]
    df = frame([(*run, i) for run, i in ids], RUN + ", event_id STRING")
    sample = keys.bounded_sample(df, rows=20)
    mark = lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()
    expected = sorted(sorted((i for run, i in ids if run[2] == "big"), key=mark)[:20]) + ["t0", "t1", "t2"]
    assert sorted(r["event_id"] for r in sample.collect()) == sorted(expected)
    again = keys.bounded_sample(df.repartition(7).orderBy(F.rand(1)), rows=20)
    assert rows(again) == rows(sample)


def test_bounded_sample_of_one_repeated_id(frame):
    df = frame([("s", "c", "r", "same")] * 300 + [("s", "c", "r", "other")], RUN + ", event_id STRING").repartition(6)
    assert keys.bounded_sample(df, rows=10).count() == 10


def test_bounded_sample_gathers_no_run_to_find_its_end(spark, frame):
    df = frame([("s", "c", "r", f"e{i}") for i in range(50)], RUN + ", event_id STRING")
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        plan = keys.bounded_sample(df, rows=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_modal_value_takes_the_smallest_of_equals(frame, rows):
    df = frame([("a", 2000), ("a", 2000), ("a", 1500), ("b", 1500), ("b", 2000), ("b", None)], "scenario STRING, t INT")
    assert rows(matrix.modal_value(df, ["scenario"], "t")) == [("a", 2000), ("b", 1500)]


def test_missing_pairs_and_runs(spark, frame, rows):
    pairs = matrix.expected_pairs(spark)
    there = pairs.where("NOT (strategy = 'batch' AND scenario = 'high-load')")
    assert rows(matrix.missing(pairs, there, ["strategy", "scenario"])) == [("batch", "high-load")]
    runs = matrix.expected_runs(spark, 2, ["batch"], ["low-load"])
    actual = frame([("batch", "low-load", "run_1")], RUN)
    assert rows(matrix.missing(runs, actual, KEY)) == [("batch", "low-load", "run_2")]


def test_mean_and_error(frame, rows):
    df = frame(
        [("a", 2.0), ("a", 4.0), ("a", 6.0), ("b", 5.0), ("c", None)], "strategy STRING, x DOUBLE"
    )
    got = rows(matrix.mean_sem(df, ["x"], ["strategy"]))
    assert got[0][:2] == ("a", 4.0) and got[0][2] == pytest.approx(2 / 3**0.5)
    assert got[1:] == [("b", 5.0, 0.0), ("c", None, 0.0)]


def test_lag_per_run_and_coverage(spark, frame, rows):
    lag = frame(
        [("streaming", "c", "r", 5.0, "real_prometheus"), ("streaming", "c", "r", 9.0, "missing"), ("batch", "c", "r", 3.0, None)],
        RUN + ", lag DOUBLE, lag_source STRING",
    )
    assert rows(matrix.lag_per_run(lag), "strategy", "kafka_lag_real_available") == [("batch", False), ("streaming", True)]
    assert matrix.lag_per_run(lag).where("strategy = 'streaming'").first()["kafka_lag_max"] == 5.0
    assert rows(matrix.lag_coverage(spark, lag)) == [("batch", False), ("microbatch", False), ("streaming", True)]


def test_union_of_different_columns(frame, rows):
    union = matrix.union_all(frame([(1, "a")], "x INT, y STRING"), frame([(2, 0.5)], "x INT, z DOUBLE"))
    assert [(r["x"], r["y"], r["z"]) for r in union.orderBy("x").collect()] == [(1, "a", None), (2, None, 0.5)]


def test_reductions_and_volume(frame, rows):
    df = frame([("a", "x", 1.0), ("a", "x", 3.0)], "strategy STRING, scenario STRING, v DOUBLE")
    assert rows(matrix.reduce_by(df, {"v": "mean"})) == [("a", "x", 2.0)]
    sent = frame([("low-load", "é"), ("low-load", "ab"), ("other", "a")], "scenario STRING, payload STRING")
    budget = frame([("low-load", 2, 3)], "scenario STRING, budget_events LONG, budget_bytes LONG")
    got = {r["scenario"]: r for r in matrix.payload_volume(sent, budget).collect()}
    assert (got["low-load"]["bytes"], got["low-load"]["within_budget"]) == (4, False)
    assert got["other"]["within_budget"] is None


def test_budget(spark, rows):
    assert rows(matrix.volume_budget(spark))[0] == ("high-load", 9_000_000, 9_000_000 * 1900)


def test_runs_are_kept_whole(frame, rows):
    df = frame([("s", "c", "a", 1)] * 5 + [("s", "c", "b", 1)], RUN + ", v INT")
    runs = frame([("s", "c", "a"), ("s", "c", "a"), ("s", "c", "z")], RUN)
    assert keys.keep_runs(df, runs).count() == 5
