"""Running sums, last values and next places of long ordered groups, in blocks.

A window over a whole group puts it into one task. Here a group is cut into blocks of its order column: sums and last values are
taken within each block, the blocks' own are scanned, which is one row for each block, and what comes before a block is
carried back to its rows. Sums of whole numbers are the same as over the group; those of doubles add in the same order within a
block, so they differ by rounding at most, and not at all in a group of one block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The column that scans leave with their rows while they work.
BLOCK = "_block"


def with_block(rows: DataFrame, at: str, width: int) -> DataFrame:
    return rows.withColumn(BLOCK, F.coalesce(F.floor(F.col(at) / width), F.lit(0)))


def within(keys: Sequence[str], at: str):
    return Window.partitionBy(*keys, BLOCK).orderBy(at)


def block_carry(
    blocked: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Mapping[str, Column] = {},
    fills: Mapping[str, Column] = {},
    nexts: Mapping[str, Column] = {},
) -> DataFrame:
    """keys, block, and for each name what other blocks carry into it: the sum over all earlier ones (and ``name_total``, of all), the
    last value that is not null in an earlier one, or the first value of the next block."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, BLOCK).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()],
        *[F.max(F.when(c.isNotNull(), F.struct(F.col(at), c.alias("value")))).alias(name) for name, c in fills.items()],
        *[F.min(c).alias(name) for name, c in nexts.items()],
    )
    carried = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums]
    carried += [F.sum(name).over(Window.partitionBy(*keys)).alias(f"{name}_total") for name in sums]
    carried += [F.last(F.col(name)["value"], ignorenulls=True).over(earlier).alias(name) for name in fills]
    carried += [F.lead(name).over(order).alias(name) for name in nexts]
    return totals.select(*keys, BLOCK, *carried)


def running(
    rows: DataFrame, keys: Sequence[str], at: str, width: int, sums: Mapping[str, str] = {}, fills: Mapping[str, str] = {}
) -> DataFrame:
    """The rows with running sums up to and with each (name: column), and with nulls filled by the last value before them."""
    keys = list(keys)
    blocked = with_block(rows, at, width)
    carried = block_carry(
        blocked, keys, at, {f"_{n}": F.col(c) for n, c in sums.items()}, {f"_{n}": F.col(c) for n, c in fills.items()}
    )
    here = within(keys, at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {f"_in_{n}": F.sum(c).over(here) for n, c in sums.items()}
    inside |= {f"_in_{n}": F.last(c, ignorenulls=True).over(here) for n, c in fills.items()}
    joined = blocked.withColumns(inside).join(carried, [*keys, BLOCK])
    results = {n: F.col(f"_{n}") + F.col(f"_in_{n}") for n in sums} | {n: F.coalesce(f"_in_{n}", f"_{n}") for n in fills}
    kept = [c for c in rows.columns if c not in results]
    return joined.select(*kept, *[c.alias(n) for n, c in results.items()])
