import math
import random

import pytest
from pyspark.sql import functions as F

from pulse.operators import ranks
from pulse.plans import reports

DDL = "scenario STRING, strategy STRING, latency_ms LONG"


def sample(frame, **groups):
    return frame([("s", g, v) for g, values in groups.items() for v in values], DDL)


def brute_ranks(values):
    ordered = sorted(values)
    return {v: (2 * ordered.index(v) + ordered.count(v) + 1) / 2 for v in set(values)}


def test_kruskal_wallis_without_ties(frame):
    got = ranks.kruskal_wallis(sample(frame, batch=[7, 8, 9], microbatch=[4, 5, 6], streaming=[1, 2, 3])).first()
    assert got["kruskal_h"] == pytest.approx(7.2)
    assert got["kruskal_p"] == pytest.approx(math.exp(-3.6))


def test_kruskal_wallis_against_brute_force(frame):
    rng = random.Random(1)
    groups = {g: [rng.randint(0, 30) + i for _ in range(60 + 7 * i)] for i, g in enumerate(("batch", "microbatch", "streaming"))}
    everything = [v for values in groups.values() for v in values]
    r, n = brute_ranks(everything), len(everything)
    spread = sum(sum(r[v] for v in values) ** 2 / len(values) for values in groups.values())
    ties = sum(everything.count(v) ** 3 - everything.count(v) for v in set(everything))
    h = (12 / (n * (n + 1)) * spread - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    for width in (4, 1024):
        got = ranks.kruskal_wallis(sample(frame, **groups), width=width).first()
        assert got["kruskal_h"] == pytest.approx(h)


def test_two_groups_or_one_value_have_no_h(frame):
    two = ranks.kruskal_wallis(sample(frame, batch=[1, 2], streaming=[3])).first()
    assert two["kruskal_h"] is None and two["groups"] == 2
    same = ranks.kruskal_wallis(sample(frame, batch=[5], microbatch=[5], streaming=[5])).first()
    assert same["kruskal_h"] is None


def test_mann_whitney_counts(frame):
    got = ranks.mann_whitney(sample(frame, batch=[1, 2, 2], microbatch=[2, 3, 4])).first()
    assert (got["pair"], got["u1"], got["u"]) == ("batch_vs_microbatch", 1.0, 8.0)
    # n = 6, one tie of three: variance 9/12 * (7 - 24/30); z = (8 - 4.5 - 0.5) / its root
    z = 3.0 / math.sqrt(9 / 12 * (7 - 24 / 30))
    assert got["z"] == pytest.approx(z)
    assert got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got["p_adj"] == pytest.approx(min(1.0, 3 * got["p"]))


def test_small_groups_have_a_p_too(frame):
    got = ranks.mann_whitney(sample(frame, batch=[1, 2], streaming=[3, 4])).first()
    z = (4 - 2 - 0.5) / math.sqrt(4 / 12 * 5)
    assert got["z"] == pytest.approx(z) and got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    few = ranks.mann_whitney(sample(frame, batch=list(range(8)), streaming=list(range(100, 150)))).first()
    assert few["z"] > 4 and 0 < few["p"] < 1e-4


def test_tails_of_the_normal_distribution(frame):
    zs = [-0.4, 0.0, 0.01, 0.5, 1.0, 1.96, 3.0, 5.0, 7.5, 7.999, 8.0, 40.0, None]
    got = frame([(z,) for z in zs], "z DOUBLE").select("z", ranks.two_sided_p(F.col("z")).alias("p")).collect()
    for z, p in got:
        assert p is None if z is None else p == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), abs=4e-15)


def test_pairs_use_their_own_ranks(frame):
    rng = random.Random(2)
    groups = {g: [rng.randint(0, 40) for _ in range(50)] for g in ("batch", "microbatch", "streaming")}
    got = {r["pair"]: r for r in ranks.mann_whitney(sample(frame, **groups)).collect()}
    assert len(got) == 3
    for pair, row in got.items():
        a, b = pair.split("_vs_")
        r = brute_ranks(groups[a] + groups[b])
        u1 = sum(r[v] for v in groups[a]) - 50 * 51 / 2
        assert row["u1"] == pytest.approx(u1) and row["u"] == pytest.approx(max(u1, 2500 - u1))


def test_report_needs_two_groups(frame):
    alone = frame([("only", "batch", 1)], DDL)
    both = sample(frame, batch=list(range(20)), streaming=list(range(5, 30)))
    got = reports.statistical_tests(alone.union(both)).collect()
    assert [r["scenario"] for r in got] == ["s"]
    assert got[0]["significant"] == "no" and got[0]["kruskal_h"] is None
    assert got[0]["batch_vs_streaming_p_adj"] is not None and got[0]["batch_vs_microbatch_p_adj"] is None
