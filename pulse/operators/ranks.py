"""Rank tests between strategies, from value counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.order_stats import MS_WIDTH, running_counts, value_counts
from pulse.schemas import STRATEGIES

#: From here on both tails of the normal distribution together are below 2e-15, and taken as 0.
FAR = 8.0
TERMS = 150
PAIRS = [("batch", "microbatch"), ("batch", "streaming"), ("microbatch", "streaming")]


def two_sided_p(z: Column) -> Column:
    """2·(1 − Φ(z)), at most 1, by the series erf x = 2/√π · e^(−x²) · Σ 2ⁿ x^(2n+1) / (2n+1)!!."""
    x = z / math.sqrt(2.0)
    first = F.struct(x.alias("term"), x.alias("sum"))

    def step(state: Column, n: Column) -> Column:
        term = state["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda state: state["sum"])
    p = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    return F.when(z.isNull(), None).when(z >= FAR, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def _ranked(counts: DataFrame, block: list[str], group: str, value: str, width: float | None) -> DataFrame:
    """Counts by block, group and value with ``rank``, the average rank of the value in its block,
    and ``tied``, how many rows of the block share the value."""
    ties = counts.groupBy(*block, value).agg(F.sum("n").alias("tied"))
    ranks = running_counts(ties, block, value, "tied", width).withColumn(
        "rank", F.col("before") + (F.col("tied") + 1) / 2.0
    )
    return counts.join(ranks.select(*block, value, "rank", "tied"), [*block, value])


def _tie_term() -> Column:
    t = F.col("tied").cast("double")
    # One row per group and value: each group's share of the tie adds up to the whole.
    return F.sum(F.col("n") / t * (t * t * t - t))


def kruskal_wallis(
    df: DataFrame, block: str = "scenario", group: str = "strategy", value: str = "latency_ms",
    groups: list[str] = STRATEGIES, width: float | None = MS_WIDTH,
) -> DataFrame:
    """H and p of each block that has every one of the three groups; null H where all values tie.

    With three groups the chi-square has two degrees of freedom, so p is exp(-H/2).
    """
    counts = value_counts(df.where(F.col(group).isin(groups)), [block, group], value)
    ranked = _ranked(counts, [block], group, value, width)
    sums = ranked.groupBy(block, group).agg(
        F.sum("n").cast("double").alias("size"),
        F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        _tie_term().alias("ties"),
    )
    n = F.col("rows")
    spread = 12.0 / (n * (n + 1)) * F.col("squares") - 3.0 * (n + 1)
    correction = 1.0 - F.col("ties") / (n * n * n - n)
    return (
        sums.groupBy(block)
        .agg(
            F.sum("size").alias("rows"),
            F.count("*").alias("groups"),
            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")).alias("squares"),
            F.sum("ties").alias("ties"),
        )
        .withColumn(
            "kruskal_h",
            F.when((F.col("groups") == len(groups)) & (n > 1) & (correction > 0), spread / correction),
        )
        .withColumn("kruskal_p", F.exp(-F.col("kruskal_h") / 2))
        .select(block, "rows", "groups", "kruskal_h", "kruskal_p")
    )


def mann_whitney(
    df: DataFrame, block: str = "scenario", group: str = "strategy", value: str = "latency_ms",
    pairs: list[tuple[str, str]] = PAIRS, width: float | None = MS_WIDTH,
) -> DataFrame:
    """U, z and two-sided p of each pair in each block, on the pair's own ranks.

    p uses the normal approximation with tie and continuity correction, for groups of any size (n1
    and n2 tell how far to trust it), and ``p_adj`` is p times the number of pairs, at most 1.
    """
    counts = value_counts(df, [block, group], value)
    # The pairs are a fixed short list: each count is repeated once per pair it takes part in.
    sides = F.array(
        *[
            F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"))
            for a, b in pairs
        ]
    )
    own = F.filter(sides, lambda s: (s["a"] == F.col(group)) | (s["b"] == F.col(group)))
    paired = counts.select(block, group, value, "n", F.inline(own)).withColumn(
        "left", F.col("a") == F.col(group)
    )
    ranked = _ranked(paired, [block, "pair"], group, value, width)
    left = F.col("left")
    sums = ranked.groupBy(block, "pair").agg(
        F.sum(F.when(left, F.col("n")).otherwise(0)).cast("double").alias("n1"),
        F.sum(F.when(~left, F.col("n")).otherwise(0)).cast("double").alias("n2"),
        F.sum(F.when(left, F.col("n") * F.col("rank")).otherwise(0.0)).alias("r1"),
        _tie_term().alias("ties"),
    ).where((F.col("n1") > 0) & (F.col("n2") > 0))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return (
        sums.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2)
        .withColumn("u", F.greatest(F.col("u1"), n1 * n2 - F.col("u1")))
        .withColumn("z", F.when(variance > 0, (F.col("u") - n1 * n2 / 2 - 0.5) / F.sqrt(variance)))
        .withColumn("p", two_sided_p(F.col("z")))
        .withColumn("p_adj", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.col("p") * len(pairs))))
        .select(block, "pair", "n1", "n2", "u1", "u", "z", "p", "p_adj")
    )
