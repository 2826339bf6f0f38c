"""Sharding (2) by a look-up table filled from permutations; DataFrame and SQL functions only.

Each shard has an order of preference over all slots of a table of prime size: slot (offset + j * step) mod size
for j = 0, 1, ..., with offset and step from a hash of its name. The shards take turns; each claims the first
free slot of its order, until the table is full. So all have the same number of slots but one, and when
a shard goes, few keys move that were not its own. A row's slot is its key's hash modulo the size, and the table,
whose size is fixed by the number of shards and not by the data, is broadcast.

A key that holds very many rows would fill its shard. ``split_above`` deals the rows of such keys over as many
slots as they need, by a hash of the row, so a row goes to the same shard however the table is partitioned.

Defined cases: null keys are placed together, as a key of its own. Repeated rows are placed alike. An empty table gives
no rows. A null is no shard; without any shard, rows have slot 0 and a null shard. Long keys are hashed whole. All columns are kept; ``slot`` and ``shard`` come after them, and a table that
has columns of these names gives them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.shared import kept

#: Slots of the table for each shard, at least; the shards' shares differ by less than one in so many.
SLOTS_PER_SHARD = 100


def table_size(shards: int) -> int:
    """The least prime that gives each shard its slots."""
    size = max(3, shards * SLOTS_PER_SHARD + 1)
    while any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        size += 1
    return size


def hashed(key: F.Column) -> F.Column:
    """60 bits of the key's MD5, as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


#: Slots in a piece of the table while it is filled; a turn writes one piece anew.
_PIECE = 512
#: Bytes of a slot's entry: the number of its shard, from 1; 0 is free.
_ENTRY = 3


def slot_table(spark: SparkSession, names: DataFrame) -> DataFrame:
    """slot and shard of every slot, for a table of shard names (column ``shard``, some thousand).

    A fold over the rounds, in each of which every shard has one turn: a fold over the shards. Its state is the table, as
    pieces of bytes, and how far every shard has come in its order. With f slots free of s, a turn looks at the next
    3 s / f places of its order, if none is free at 30 s / f, and only then at all; so the whole takes about 5 s ln s looks.
    """
    shards = names.select("shard").where(F.col("shard").isNotNull()).distinct()
    n = shards.count()
    if not n:
        return spark.createDataFrame([], "slot long, shard string")
    size = table_size(n)
    orders = shards.select(
        "shard",
        F.pmod(hashed(F.concat("shard", F.lit("/offset"))), F.lit(size)).alias("offset"),
        (F.pmod(hashed(F.concat("shard", F.lit("/step"))), F.lit(size - 1)) + 1).alias("step"),
    )
    whole = orders.agg(F.array_sort(F.collect_list(F.struct("shard", "offset", "step"))).alias("shards"))
    pieces = -(-size // _PIECE)
    free = "X'" + "00" * _ENTRY + "'"
    at = f"cast((shards[i].offset + j * shards[i].step) % {size} AS int)"
    is_free = f"transform(array({at}), k -> substring(t.pieces[k div {_PIECE}], k % {_PIECE} * {_ENTRY} + 1, {_ENTRY}) = {free})[0]"

    def first_free(last: str) -> str:
        return f"get(filter(sequence(s.next[i], {last}), j -> {is_free}), 0)"

    # The first free place of shard i's order in its turn, given the table t and the order's places up to s.next[i].
    some = [f"least(s.next[i] + cast({k}L * {size} div ({size} - r * {n} - i) AS bigint), {size - 1}L)" for k in (3, 30)]
    place = f"coalesce({', '.join(map(first_free, [*some, f'{size - 1}L']))})"
    entry = f"unhex(lpad(hex(i + 1), {2 * _ENTRY}, '0'))"
    claimed = f"""struct(
        transform(t.pieces, (p, c) -> if(c = k div {_PIECE}, overlay(p PLACING {entry} FROM k % {_PIECE} * {_ENTRY} + 1 FOR {_ENTRY}), p)) AS pieces,
        concat(t.next, array(j + 1)) AS next)"""
    turn = f"transform(array({place}), j -> transform(array({at}), k -> {claimed})[0])[0]"
    filled = whole.selectExpr(
        "shards",
        f"""aggregate(
            sequence(0, {(size - 1) // n}),
            struct(array_repeat(unhex(repeat('00', {_PIECE * _ENTRY})), {pieces}) AS pieces, array_repeat(0L, {n}) AS next),
            (s, r) -> aggregate(
                sequence(0, least({n}, {size} - r * {n}) - 1),
                struct(s.pieces AS pieces, cast(array() AS array<bigint>) AS next),
                (t, i) -> {turn})
        ).pieces AS pieces""",
    )
    bytes_of = filled.select("shards", F.posexplode("pieces").alias("piece", "bytes"))
    places = bytes_of.select("shards", "piece", "bytes", F.explode(F.sequence(F.lit(0), F.lit(_PIECE - 1))).alias("k"))
    slots = places.select(
        (F.col("piece") * _PIECE + F.col("k")).cast("long").alias("slot"),
        F.expr(f"get(shards, cast(conv(hex(substring(bytes, k * {_ENTRY} + 1, {_ENTRY})), 16, 10) AS int) - 1).shard").alias("shard"),
    ).where(F.col("slot") < size)
    # Written once, so that the fold does not run again for every use of the table.
    return kept(slots, "slots")


def _key(columns: list[str]) -> F.Column:
    """The key columns as one text; a null differs from every text."""
    if len(columns) == 1:
        return F.coalesce(F.col(columns[0]).cast("string"), F.lit("\u0000"))
    return F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))


def placed(
    rows: DataFrame, columns: list[str], table: DataFrame, split_above: float | None = None, split_by: list[str] | None = None
) -> DataFrame:
    """The rows with ``slot`` and ``shard``.

    split_above: a key with more than this share of all rows is dealt over as many parts as keep each part below it. There
    are at most 1 / split_above such keys, so that their table, too, is broadcast. split_by: the columns whose values deal the
    rows, all if none are given; rows that are equal in them stay together.
    """
    rows = rows.drop("slot", "shard")
    size = max(1, table.count())
    key, names = _key(columns), rows.columns
    if split_above is not None:
        counts = rows.groupBy(key.alias("_shard_key")).agg(F.count("*").alias("_shard_n"))
        most = F.ceil(F.lit(rows.count() * split_above))
        hot = counts.where(F.col("_shard_n") > most).select(
            F.col("_shard_key").alias("_shard_hot"), F.ceil(F.col("_shard_n") / most).alias("_shard_parts")
        )
        rows = rows.join(F.broadcast(hot), key == F.col("_shard_hot"), "left")
        part = F.pmod(hashed(_key(split_by or names)), F.coalesce("_shard_parts", F.lit(1)))
        key = F.when(part > 0, F.concat(key, F.lit("\u001f"), part)).otherwise(key)
    slots = rows.withColumn("slot", F.pmod(hashed(key), F.lit(size).cast("long")))
    return slots.join(F.broadcast(table), "slot", "left").select(*names, "slot", "shard")
