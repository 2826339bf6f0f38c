"""Operators on event and run keys: first copy wins, absent rows, run-level look-ups, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.columns import preferred_rank
from pulse.schemas import KEY, SAMPLE_ROWS_PER_RUN, SCENARIOS, STRATEGIES


def first_wins(df: DataFrame, key: str = "event_id", order: Sequence[str] = ("partition", "offset")):
    """The first row of each key. ``order`` must be total among rows that differ.

    Every task keeps only its own first row of a key before the shuffle (the rank filter is pushed
    below the exchange), so a key with very many copies sends one row per task.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def first_per_run(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def insert_if_absent(
    batch: DataFrame, existing: DataFrame, key: str = "event_id", small_batch: bool = False
) -> DataFrame:
    """Rows of the batch whose key is not in the existing rows.

    An anti join shuffles both sides' keys. With ``small_batch`` the existing keys are first cut
    down to those the batch holds, a join in which the batch can be broadcast if it turns out small
    enough, so a grown table is scanned but not shuffled; the batch is read twice for it.
    """
    keys = existing.select(key)
    if small_batch:
        keys = keys.join(batch.select(key), key, "left_semi").distinct()
    return batch.join(keys, key, "left_anti")


def keep_runs(df: DataFrame, runs: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Rows of the selected runs. A plain semi join would bring all rows of a run into one task."""
    return attach_per_run(df, runs.select(*on).distinct(), on)


def attach_per_run(
    rows: DataFrame, per_run: DataFrame, on: Sequence[str] = KEY, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join many rows with a table of one row per run.

    A run may hold a large share of the rows. Each run's one row is repeated ``salts`` times, by default once for
    each shuffle partition, and the rows are dealt over the copies, so that no run is joined in one task, nor
    grouped in one by whatever follows: rows spread on the salted key satisfy no grouping by run. Rows are dealt by
    their event id, or by their content if they have none, and the task they come from, all the same if a task runs
    again; so even rows that are all alike are spread as far as they came from different tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One column is enough to deal by; hashing all would make every one of them part of the scan.
    others = ["event_id"] if "event_id" in rows.columns else [c for c, kind in rows.dtypes if c not in on and "map<" not in kind]
    place = F.pmod(F.xxhash64(*others), F.lit(salts)) + F.spark_partition_id()
    dealt = rows.withColumn("_salt", F.pmod(place, F.lit(salts)).cast("int"))
    copies = per_run.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def in_display_order(df: DataFrame, *, scenario="scenario", strategy="strategy", then: Sequence[str] = ()):
    """Known scenarios and strategies in their usual order, others after them by name."""
    order = []
    for name, known in ((scenario, SCENARIOS), (strategy, STRATEGIES)):
        if name in df.columns:
            order += [preferred_rank(name, known), F.col(name)]
    return df.orderBy(*order, *then)


def bounded_sample(
    df: DataFrame,
    rows: int = SAMPLE_ROWS_PER_RUN,
    keys: Sequence[str] = KEY,
    id_col: str = "event_id",
    seed: int = 42,
) -> DataFrame:
    """At most ``rows`` rows of each run: those whose hashed id comes first.

    The same input gives the same rows in any order and on any cluster. Counts of rows by the hash's first 12 bits
    show per run in which prefix the sample ends; counts by the next 12 bits, of that prefix alone, show where in
    it. So a run of 10¹² rows has some ten thousand more candidates than its sample. Only candidates are shuffled; they are
    ranked per input partition first, so that even a run made of copies of one id, which share one hash, is never
    ranked in one task whole.
    """
    keys = list(keys)
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col)))
    digits = lambda first: F.conv(F.substring("_mark", first, 3), 16, 10).cast("int")
    tagged = df.withColumn("_mark", mark).withColumns({"_high": digits(1), "_low": digits(4)})

    def last(counted: DataFrame, digit: str, wanted: Column, *more: str) -> DataFrame:
        """Per run the digit in which the sample ends, and how many rows it still takes of it."""
        by_digit = counted.groupBy(*keys, digit, *more).agg(F.count("*").alias("_n"))
        up_to = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        reached = by_digit.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).where(F.col("_before") < wanted)
        end = F.max(F.struct(F.col(digit), (wanted - F.col("_before")).alias("left")))
        return reached.groupBy(*keys, *more).agg(end.alias("_end"))

    high = last(tagged, "_high", F.lit(rows)).select(*keys, F.col("_end._high").alias("_last_high"), F.col("_end.left").alias("_left"))
    # One row for each run, sent to the rows: a join by run would gather each run's rows in one task.
    inside = tagged.select(*keys, "_high", "_low").join(F.broadcast(high), keys).where(F.col("_high") == F.col("_last_high"))
    low = last(inside, "_low", F.col("_left"), "_left", "_last_high")
    limits = low.select(*keys, "_last_high", F.col("_end._low").alias("_last_low"))
    high_digit, low_digit = F.col("_high"), F.col("_low")
    within = (high_digit < F.col("_last_high")) | ((high_digit == F.col("_last_high")) & (low_digit <= F.col("_last_low")))
    ties = sorted(c for c in df.columns if c not in keys)
    ranked = tagged.join(F.broadcast(limits), keys).where(within).withColumn("_task", F.spark_partition_id())
    for spread in (["_task"], []):
        order = Window.partitionBy(*keys, *spread).orderBy("_mark", *ties)
        ranked = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
    return ranked.select(*df.columns)
