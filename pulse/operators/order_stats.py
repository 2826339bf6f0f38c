"""Exact order statistics from value counts: running counts, quantiles, box plots, histograms.

Rows are first counted by value. Latencies are whole milliseconds, so the counts are far fewer than
the rows and each task reduces its own before the shuffle. What follows works on the counts, in
buckets of neighbouring values: no task holds all values of a group.

The buckets follow the values. A first pass counts the values by a digit of their logarithm; a digit with very many is cut
again, evenly between its own least and greatest value, into as many buckets as its count asks for. So fractions
below 1, times around one moment and numbers up to 10^15 all have buckets of some ``BUCKET_VALUES`` values, and a group has
one bucket for as many values and for each digit at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.schemas import LATENCY_BOUNDS

BUCKET_VALUES = 1024
#: Digits for each doubling of a value.
_DIGITS = 16
#: For latencies in whole milliseconds, whose range is known: buckets of so many, which cost no first pass.
MS_WIDTH = 1024
#: Buckets of one width on either side of 0; beyond them they grow with the value, so that there are few more.
_EVEN_BUCKETS = 1 << 20
LATENCY_QUANTILES = {"latency_p50_ms": 0.50, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}


def value_counts(df: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """Rows by key and value; nulls are left out."""
    kept = df.where(F.col(value).isNotNull())
    return kept.groupBy(*keys, value).agg(F.count("*").alias(count))


def value_digit(value: Column) -> Column:
    """A whole number that grows with the value, by its logarithm: at most some 2 000 times ``_DIGITS`` of them, of either sign."""
    x = value.cast("double")
    return (F.signum(x) * F.floor(_DIGITS * F.log2(1 + F.abs(x)))).cast("int")


def bucketed(
    counts: DataFrame, keys: Sequence[str], value: str, width: float | None = None, count: str = "n", carry: Sequence[str] = ()
) -> DataFrame:
    """The counts with ``_bucket``: buckets of a group are in the order of its values. With ``width`` they are of that width,
    and without a first pass; far from 0 they are wider, so that even values of 10^15 do not make more than some millions."""
    if width is not None:
        place = F.col(value).cast("double") / width
        far = F.floor(1024 * F.log2(F.abs(place) / _EVEN_BUCKETS)) + _EVEN_BUCKETS
        bucket = F.when(F.abs(place) < _EVEN_BUCKETS, F.floor(place)).otherwise(F.signum(place).cast("bigint") * far)
        # Never null, so the join of the totals adds no null filter to one side only.
        return counts.withColumn("_bucket", F.coalesce(bucket, F.lit(0).cast("bigint")))
    digits = counts.withColumn("_digit", F.coalesce(value_digit(F.col(value)), F.lit(0)))
    x = F.col(value).cast("double")
    sizes = digits.groupBy(*keys, "_digit").agg(
        F.count("*").alias("_values"), F.min(x).alias("_least"), F.max(x).alias("_most"), *_all_columns(count, carry)
    )
    sizes = _same_columns(sizes)
    cuts = F.ceil(F.col("_values") / BUCKET_VALUES)
    part = F.floor((x - F.col("_least")) / (F.col("_most") - F.col("_least")) * cuts)
    # The digit's greatest value belongs to its last part.
    within_digit = F.when(cuts > 1, F.least(part, cuts - 1)).otherwise(F.lit(0))
    place = F.struct(F.col("_digit").alias("digit"), within_digit.cast("bigint").alias("part"))
    return digits.join(sizes, [*keys, "_digit"]).withColumn("_bucket", place).select(*counts.columns, "_bucket")


def _all_columns(count: str, carry: Sequence[str]) -> list[Column]:
    return [F.sum(count).alias("_rows"), F.max(F.struct(F.lit(True), *carry)).alias("_carried")]


def _same_columns(totals: DataFrame) -> DataFrame:
    """All totals; the condition always holds. It needs every column of the counts, so that no side of a join of the counts with
    their own totals is pruned to fewer: the sides then share the shuffle of the counts, and what lies under it is read once."""
    return totals.where("_rows >= 0 OR _carried IS NOT NULL").drop("_carried")


def running_counts(
    counts: DataFrame, keys: Sequence[str], value: str, count: str = "n", width: float | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Counts with ``before``, how many rows of the group have a lower value, and ``total``.

    Two levels: a running sum over bucket totals in each group, and one over values in each bucket. ``carry`` names further
    columns of the counts that the caller goes on to use.
    """
    keys = list(keys)
    fine = bucketed(counts, keys, value, width, count, carry)
    within = Window.partitionBy(*keys, "_bucket").orderBy(value)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = (Window.unboundedPreceding, -1)
    offsets = (
        _same_columns(fine.groupBy(*keys, "_bucket").agg(*_all_columns(count, carry)))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(across.rowsBetween(*earlier)), F.lit(0)))
        .withColumn("total", F.sum("_rows").over(Window.partitionBy(*keys)))
        .drop("_rows")
    )
    inside = fine.withColumn(
        "_inside", F.coalesce(F.sum(count).over(within.rowsBetween(*earlier)), F.lit(0))
    )
    return (
        inside.join(offsets, [*keys, "_bucket"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    count: str = "n",
    width: float | None = None,
    extra: Sequence[Column] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles of each group, one column per entry of ``probs``.

    ``extra`` are further aggregates over the counts, taken in the same step; ``carry`` names the columns that they use besides
    the value and the count.
    """
    ranked = running_counts(counts, keys, value, count, width, carry)
    position = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in probs.items()}

    def value_at(rank: Column) -> Column:
        here = (F.col("before") <= rank) & (rank < F.col("before") + F.col(count))
        return F.max(F.when(here, F.col(value)))

    picks = []
    for name, at in position.items():
        picks += [
            value_at(F.floor(at)).alias(f"_lo_{name}"),
            value_at(F.ceil(at)).alias(f"_hi_{name}"),
        ]
    picked = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *picks, *extra)
    kept = [c for c in picked.columns if not c.startswith(("_lo_", "_hi_")) and c != "total"]

    def interpolated(name: str) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = position[name] - F.floor(position[name])
        return (lo + (hi - lo) * part).cast("double").alias(name)

    return picked.select(*kept, *[interpolated(name) for name in probs])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], width: float | None = None
) -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs, width=width)


def approx_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int = 10000
) -> DataFrame:
    """Opt-in sketch with a fixed memory bound; the reports use the exact form."""
    sketch = F.percentile_approx(value, list(probs.values()), accuracy)
    picked = df.groupBy(*keys).agg(sketch.alias("_q"))
    return picked.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def five_numbers(df: DataFrame, keys: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """Rows, minimum, quartiles and maximum."""
    counts = value_counts(df, keys, value)
    extra = [F.sum("n").alias("rows"), F.min(value).alias("minimum"), F.max(value).alias("maximum")]
    probs = {"q1": 0.25, "median": 0.50, "q3": 0.75}
    return quantiles_of_counts(counts, keys, value, probs, width=width, extra=extra)


def box_stats(df: DataFrame, keys: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """Box-plot numbers: quartiles, and the last values within 1.5 quartile distances of the box."""
    keys = list(keys)
    counts = value_counts(df, keys, value)
    extra = [F.sum("n").alias("rows")]
    probs = {"q1": 0.25, "median": 0.50, "q3": 0.75}
    boxes = quantiles_of_counts(counts, keys, value, probs, width=width, extra=extra)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = boxes.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)
    inside = counts.join(fenced.select(*keys, "_low", "_high"), keys).where(
        F.col(value).between(F.col("_low"), F.col("_high"))
    )
    whiskers = inside.groupBy(*keys).agg(
        F.min(value).alias("whisker_low"),
        F.max(value).alias("whisker_high"),
        F.sum("n").alias("rows_inside"),
    )
    return boxes.join(whiskers, keys)


def histogram(
    df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Cumulative counts by upper bound, with ``+Inf``, and the sum and count of the values."""
    x = F.col(value)
    names = [f"_le_{i}" for i in range(len(bounds))]
    wide = df.where(x.isNotNull()).groupBy(*keys).agg(
        *[F.count_if(x <= bound).alias(name) for name, bound in zip(names, bounds)],
        F.count("*").alias("observations"),
        F.sum(x).alias("value_sum"),
    )
    pairs = [f"'{bound}', {name}" for name, bound in zip(names, bounds)] + ["'+Inf', observations"]
    stack = f"stack({len(pairs)}, {', '.join(pairs)}) AS (le, cumulative)"
    return wide.selectExpr(*keys, stack, "value_sum", "observations")
