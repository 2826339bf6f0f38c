import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators import order_stats
from pulse.plans import reports

PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def test_interpolated_quantiles(frame):
    got = order_stats.exact_quantiles(frame([("g", v) for v in (10, 20, 30, 40)], "g STRING, x LONG"), ["g"], "x", PROBS)
    assert got.first().asDict() == {"g": "g", "p50": 25.0, "p95": pytest.approx(38.5), "p99": pytest.approx(39.7)}


@pytest.mark.parametrize("width", [None, 1, 7, 1e9])
def test_quantiles_against_numpy(frame, width):
    rng = random.Random(3)
    groups = {
        "wide": [rng.randint(-5000, 900000) for _ in range(700)],
        "tied": [rng.choice([5, 5, 5, 6, 1000]) for _ in range(301)],
        "hot": [7] * 900 + [rng.randint(0, 50) for _ in range(50)],
        "one": [42],
        "two": [-3, 8],
    }
    df = frame([(g, v) for g, values in groups.items() for v in values], "g STRING, x LONG").repartition(5)
    probs = PROBS | {"low": 0.0, "high": 1.0, "q1": 0.25}
    for row in order_stats.exact_quantiles(df, ["g"], "x", probs, width=width).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(groups[row["g"]], p)), (row["g"], name)


def test_quantiles_do_not_depend_on_partitions(spark, frame, rows):
    df = frame([(i % 3, (i * 7919) % 4001) for i in range(900)], "g INT, x LONG")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(rows(order_stats.exact_quantiles(df.repartition(int(n)), ["g"], "x", PROBS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_two_stage_form_equals_builtin_percentile(frame, rows):
    df = frame([(i % 4, (i * 31) % 257) for i in range(1000)], "g INT, x LONG")
    builtin = df.groupBy("g").agg(*[F.percentile("x", p).alias(n) for n, p in PROBS.items()])
    assert rows(order_stats.exact_quantiles(df, ["g"], "x", PROBS)) == rows(builtin)


def test_input_is_read_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id % 3 AS g", "id AS x").write.parquet(path)
    got = order_stats.exact_quantiles(spark.read.parquet(path), ["g"], "x", PROBS)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


SHAPES = {
    "fractions": [k / 9973 for k in range(6000)],
    "moments": [1_700_000_000_000 + 37 * k for k in range(6000)],
    "up to 10^15": [(k * k * k * 7919) % 10**15 for k in range(6000)],
    "both signs": [(-1) ** k * 1.01**k for k in range(3000)],
    "far apart": [0, 1e-300, 1e15, -1e15, 1e300] + [0.5] * 100,
    "all alike": [7.5] * 3000,
}


def test_buckets_follow_the_values(frame):
    df = frame([(g, float(v)) for g, values in SHAPES.items() for v in values], "g STRING, x DOUBLE").repartition(4)
    fine = order_stats.bucketed(order_stats.value_counts(df, ["g"], "x"), ["g"], "x")
    sizes = fine.groupBy("g", "_bucket").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
    for g, values in SHAPES.items():
        own = sorted((r for r in sizes if r["g"] == g), key=lambda r: tuple(r["_bucket"]))
        distinct = len(set(values))
        assert sum(r["n"] for r in own) == distinct
        # Buckets are in order, none holds much more than its share, and they are few.
        assert all(left["b"] < right["a"] for left, right in zip(own, own[1:]))
        assert max(r["n"] for r in own) <= 2 * order_stats.BUCKET_VALUES
        digits = len({r["_bucket"]["digit"] for r in own})
        assert len(own) <= digits + distinct / order_stats.BUCKET_VALUES + 1
    for row in order_stats.exact_quantiles(df, ["g"], "x", PROBS).collect():
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.quantile(np.array(SHAPES[row["g"]], float), p), rel=1e-9), (row["g"], name)


def test_buckets_of_one_width_are_few_far_away(frame):
    values = sorted({*range(-3000, 3000, 7), *(10**k for k in range(3, 16)), *(-(10**k) for k in range(3, 16)), *(2**30 + k for k in range(-3000, 3000, 500))})
    counts = frame([("g", v, 1) for v in values], "g STRING, x LONG, n LONG")
    got = {r["x"]: r["_bucket"] for r in order_stats.bucketed(counts, ["g"], "x", order_stats.MS_WIDTH).collect()}
    buckets = [got[v] for v in values]
    assert buckets == sorted(buckets) and got[3] == 0 and got[-4] == -1 and abs(got[10**15]) < 2**21
    assert {r["x"]: r["before"] for r in order_stats.running_counts(counts, ["g"], "x", width=order_stats.MS_WIDTH).collect()} == {v: k for k, v in enumerate(values)}


def test_empty_group_gives_no_row(frame):
    df = frame([("a", None)], "g STRING, x LONG")
    assert order_stats.exact_quantiles(df, ["g"], "x", PROBS).count() == 0


def test_five_numbers_and_box(frame):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = frame([("g", v) for v in values], "g STRING, x LONG")
    five = order_stats.five_numbers(df, ["g"], "x").first()
    assert [five[n] for n in ("rows", "minimum", "q1", "median", "q3", "maximum")] == [9, 1, 3.0, 5.0, 7.0, 100]
    box = order_stats.box_stats(df, ["g"], "x").first()
    assert (box["whisker_low"], box["whisker_high"], box["rows_inside"]) == (1, 8, 8)


def test_distribution_leaves_out_non_positive(frame):
    df = frame([("s", "c", v) for v in (-9, 0, 5)], "strategy STRING, scenario STRING, latency_ms LONG")
    assert reports.latency_distribution(df).first()["rows"] == 1


def test_histogram(frame):
    df = frame([("g", v) for v in (1, 3, 20000, None)], "g STRING, x LONG")
    got = {r["le"]: r for r in order_stats.histogram(df, ["g"], "x").collect()}
    assert [got[b]["cumulative"] for b in ("1", "2", "5", "10000", "+Inf")] == [1, 1, 2, 2, 3]
    assert got["1"]["value_sum"] == 20004


def test_sketch_is_near(frame):
    df = frame([("g", v) for v in range(1001)], "g STRING, x LONG")
    got = order_stats.approx_quantiles(df, ["g"], "x", {"p50": 0.5}).first()
    assert abs(got["p50"] - 500) <= 2


def test_running_counts(frame, rows):
    counts = frame([("g", 10, 2), ("g", 5000, 1), ("g", -3, 4)], "g STRING, x LONG, n LONG")
    got = order_stats.running_counts(counts, ["g"], "x", width=16)
    assert rows(got, "x", "before", "total") == [(-3, 0, 7), (10, 4, 7), (5000, 6, 7)]
