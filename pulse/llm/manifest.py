"""Merkle dataset manifest (12): a tree of hashes over all rows, grouped by source, whose proofs come out of a butterfly exchange.

Rows are leaves in the order of their ids within their source. Aligned blocks of ``block`` leaves, a power of the fanout, are put
together by one task each, which hashes the block's own subtree. Blocks then exchange roots: in round r the blocks whose numbers
differ in digit r alone (to the base of the fanout) form a group, swap the roots that they know, and each hashes
the common ancestor for itself. As every block of a subtree knows its root after the round, all its siblings' roots come to
every block by what the partners bring; after the last round each block has its whole upper proof and the
top, and nothing is passed down again. A round is one shuffle of one small row for each block, in groups of at most ``fanout``
rows. Where the last subtree is not full, its missing blocks take part without a hash of their own, so that every block finds its
partners; they are never more than the blocks themselves. Sources exchange their subroots in the same way.

A block's rows then meet its upper proof and are proved in a stream: no task holds more than one block.

Defined cases: a null in any column is a leaf's ``-``. A null source is a group of its own, before all others; rows without an
id come first in theirs. Rows that share an id are ordered by their leaves; fully equal rows are leaves each. Very long
texts are hashed whole. An empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.shared import kept, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    order: str = "doc_id"
    group: str = "source"
    fanout: int = 16
    #: Leaves of a block: a power of the fanout.
    block: int = 4096
    #: Copies of a source's proof, over which its blocks are dealt.
    salts: int = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: dict[str, Column]) -> Column:
    """The hash of a row: each value with its length in bytes before it, or ``-`` for a null."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# --- positions ---------------------------------------------------------------------------


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows of a written table with ``pos``, their place within their ``g``, and ``n``, the rows of their ``g``.

    The rows are ordered by ranges, which split a large g; each range numbers its rows, and the ranges' counts are added up.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, now, nth = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for g in batch.column("g").to_pylist():
                if g != now:
                    now, nth = g, 0
                places.append(nth)
                nth += 1
            more = [pa.array([piece] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "piece", "nth"])

    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "g", *order).sortWithinPartitions("g", *order)
    kinds = ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, ("piece", "int"), ("nth", "long")])
    numbered = kept(ranged.mapInArrow(number, kinds), "manifest-order")
    counts = numbered.groupBy("g", "piece").agg(F.count("*").alias("c"))
    of_g = Window.partitionBy("g")
    before = F.sum("c").over(of_g.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    ranges = counts.select(F.col("g").alias("g_"), F.col("piece").alias("piece_"), F.coalesce(before, F.lit(0)).alias("first"), F.sum("c").over(of_g).alias("n"))
    # The table of ranges is written, so that Spark knows its size and sends it to the tasks only if it is small.
    same = F.col("g").eqNullSafe(F.col("g_")) & (F.col("piece") == F.col("piece_"))
    joined = numbered.join(kept(ranges, "manifest-ranges"), same)
    return joined.select(*rows.columns, (F.col("first") + F.col("nth")).alias("pos"), "n")


# --- trees -------------------------------------------------------------------------------


def parents(level: list[str], fanout: int) -> list[str]:
    return [digest("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]


def block_levels(leaves: list[str], single: bool, settings: Settings) -> list[list[str]]:
    """All levels of a block from its leaves to its root. A block that is not alone in its tree is raised to full height."""
    levels, height = [leaves], 1
    while height < settings.block if not single else len(levels[-1]) > 1:
        levels.append(parents(levels[-1], settings.fanout))
        height *= settings.fanout
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (g, block), which come one after the other."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["g"], row["block"])
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def _block_roots(placed: DataFrame, settings: Settings) -> DataFrame:
    """g, p (the block's number), n (blocks of the g) and h (the block's root)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, number), rows in _blocks(batches):
            count = -(-rows[0]["n"] // settings.block)
            root = block_levels([row["leaf"] for row in rows], count == 1, settings)[-1][0]
            yield pa.RecordBatch.from_pylist([{"g": g, "p": number, "n": count, "h": root}], pa.schema([("g", pa.string()), ("p", pa.int64()), ("n", pa.int64()), ("h", pa.string())]))

    rows = placed.select("g", "block", "pos", "leaf", "n")
    ordered = rows.repartition(partitions(placed.sparkSession), "g", "block").sortWithinPartitions("g", "block", "pos")
    return kept(ordered.mapInArrow(fold, "g string, p long, n long, h string"), "manifest-blocks")


PATH = "array<struct<at:int,others:array<string>>>"


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """g, p, top and path of the nodes of one level: each g's nodes are numbered by p from 0 to n - 1 and have a hash h.

    ``path`` has for each level above the node's place in its run, and the run's other hashes from left to right.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    rounds = 0
    while fanout**rounds < most:
        rounds += 1
    # The widest subtrees below a g's top: with the missing nodes of the last one, each is full.
    width = F.lit(1)
    for r in range(1, rounds):
        width = F.when(F.col("n") > fanout**r, F.lit(fanout**r)).otherwise(width)
    missing = F.ceil(F.col("n") / width) * width - F.col("n")
    absent = F.when(F.col("p") < missing, F.struct((F.col("n") + F.col("p")).alias("p"), F.lit(None).cast("string").alias("h")))
    both = F.array_compact(F.array(F.struct(F.col("p").alias("p"), F.col("h").alias("h")), absent))
    state = nodes.select("g", "n", F.inline(both)).withColumn("path", F.expr(f"cast(array() as {PATH})"))
    for r in range(rounds):
        step = fanout**r
        going = F.col("n") > step
        digit = F.floor(F.col("p") / step) % fanout
        # All members of a group have the same number but for this round's digit; a g that is done stays as it is.
        group = F.when(going, F.col("p") - digit * step).otherwise(F.col("p"))
        swapped = state.groupBy("g", "n", group.alias("low")).agg(F.sort_array(F.collect_list(F.struct("p", "h", "path"))).alias("members"))
        known = swapped.withColumn("known", F.filter("members", lambda m: m["h"].isNotNull()))
        root = F.when(F.size("known") > 0, F.sha2(F.array_join(F.col("known.h"), ""), 256))
        met = known.withColumn("root", root).select("g", "n", "root", "known", F.inline("members"))
        others = F.transform(F.filter("known", lambda m: m["p"] != F.col("p")), lambda m: m["h"])
        at = F.size(F.filter("known", lambda m: m["p"] < F.col("p"))).cast("int")
        longer = F.concat("path", F.array(F.struct(at.alias("at"), others.alias("others"))))
        real = F.col("p") < F.col("n")
        state = met.select(
            "g",
            "n",
            "p",
            F.when(going, F.col("root")).otherwise(F.col("h")).alias("h"),
            F.when(going & real, longer).otherwise(F.col("path")).alias("path"),
        )
    return state.where("p < n").select("g", "p", F.col("h").alias("top"), "path")


# --- the manifest ------------------------------------------------------------------------

SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "pos long, path array<int>, siblings array<array<string>>"
)


def folded(start: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to; ``path`` has the hashes before and after at each level."""
    for before, after in path:
        start = digest(before + start + after)
    return start


def proved(docs: DataFrame, settings: Settings = Settings(), now: dict[str, Column] | None = None, changed: Column | None = None, with_siblings: bool = True) -> DataFrame:
    """Every row with its leaf, its tree's and the whole root, and its proof, held against the row as it is ``now``.

    ``now`` gives columns that have changed since, in rows where ``changed`` holds (all, if it is not given): the root is
    folded from the leaf of the row as it is now and the proof, and ``verified`` says whether it is still the root. ``path`` and
    ``siblings`` are the proof itself, left out on demand.
    """
    spark = docs.sparkSession
    values = {name: F.col(name) for name in settings.fields}
    other = F.lit(None).cast("string")
    if now:
        other = leaf(values | now)
        other = other if changed is None else F.when(changed, other)
    own = docs.select(
        F.col(settings.group).cast("string").alias("g"),
        F.col(settings.order).cast("long").alias("k"),
        leaf(values).alias("leaf"),
        other.alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = kept(own, "manifest-leaves")
    placed = _positions(leaves, ["k", "leaf", "tie"]).withColumn("block", F.expr(f"pos div {settings.block}"))
    blocks = kept(butterfly(_block_roots(placed, settings), settings.fanout), "manifest-proofs")
    tops = kept(blocks.where("p = 0").select(F.lit("all").alias("g"), F.col("g").alias("source"), F.col("top").alias("h")), "manifest-subroots")
    groups = kept(_positions(tops, ["source"]).withColumnRenamed("pos", "p"), "manifest-groups")
    ends = butterfly(groups, settings.fanout).join(groups.select("g", "p", "source", "h"), ["g", "p"])
    upper = kept(ends.select("source", F.col("h").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("upper")), "manifest-upper")

    dealt = upper.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
    met = F.col("g").eqNullSafe(F.col("source")) & (F.pmod("p", F.lit(settings.salts)) == F.col("salt"))
    heads = blocks.join(dealt, met).select(
        "g", F.col("p").alias("block"), F.lit(-1).cast("long").alias("pos"), F.struct("subroot", "root", F.concat("path", "upper").alias("path")).alias("head")
    )
    rows = placed.select("g", "block", "pos", "k", "leaf", "other", "n").unionByName(heads, allowMissingColumns=True)
    ordered = rows.repartition(partitions(spark), "g", "block").sortWithinPartitions("g", "block", "pos")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fanout = [part.split()[0] for part in SCHEMA.split(", ")], settings.fanout
        for _, (first, *found) in _blocks(batches):
            head = first["head"]
            levels = block_levels([row["leaf"] for row in found], found[0]["n"] <= settings.block, settings)[:-1]
            above = [("".join(x["others"][: x["at"]]), "".join(x["others"][x["at"] :])) for x in head["path"]]
            above_joined = "".join(before + after for before, after in above)
            rows = []
            for place, row in enumerate(found):
                path, at = [], place
                for level in levels:
                    run = at - at % fanout
                    path.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
                    at //= fanout
                proof = digest("".join(before + after for before, after in path) + above_joined)
                root = folded(row["other"] or row["leaf"], path + above)
                siblings = places = None
                if with_siblings:
                    places, siblings, at = [], [], place
                    for level in levels:
                        run = at - at % fanout
                        places.append(at - run)
                        siblings.append(level[run:at] + level[at + 1 : run + fanout])
                        at //= fanout
                    places += [x["at"] for x in head["path"]]
                    siblings += [x["others"] for x in head["path"]]
                rows.append((row["k"], row["leaf"], head["subroot"], head["root"], proof, root, root == head["root"], row["pos"], places, siblings))
                if len(rows) == 512 or place + 1 == len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names=names)
                    rows = []

    return ordered.mapInArrow(prove, SCHEMA)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
TYPES = [_ARROW[part.split()[1]] for part in SCHEMA.split(", ")]


def lowered_text() -> tuple[dict[str, Column], Column]:
    """A trial of the manifest: rows whose id's checksum five divides have the letters A-Z of their text made small."""
    return {"text": F.translate("text", UPPER, LOWER)}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
